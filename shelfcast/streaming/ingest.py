"""Continuous ingest of raw daily rows with the same validation as in batch."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfcast import schema
from shelfcast.functions.rows import checked

#: Where rows were written from: the stream (by its checkpoint) and its batch.
ORIGIN = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]


def read_stream(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema.RAW).format(kind).load(path)


def read_panel(spark: SparkSession, panel_path: str) -> DataFrame:
    """The panel that ingest has written so far; empty before its first batch."""
    return _written(spark, panel_path).select(*schema.PANEL.names)


def _written(spark: SparkSession, path: str) -> DataFrame:
    fields = T.StructType([*schema.PANEL.fields, *ORIGIN])
    try:
        return spark.read.schema(fields).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)


def ingest(raw: DataFrame, revision: str, panel_path: str, bad_path: str, checkpoint: str, repeat_path: str | None = None) -> StreamingQuery:
    """Writes every row of raw to just one of three places, whenever it comes.

    A good row with a new key goes to panel_path; one whose product and day are in the panel already, or come twice in
    a batch, to repeat_path (bad_path with _repeats behind it, unless given); a row that breaks a rule to bad_path, with the
    name of its error, also if it has no readable day or is the same as another. Nothing is dropped for coming late: keys
    are looked up in the panel itself, on the days of the batch alone, and not in a state that expires.

    Each batch has a folder of its own under each path, by the checkpoint's name and the batch's number, and overwrites
    it, so a batch that is tried again leaves its rows once. A stream that starts anew needs a checkpoint of another name.
    """
    repeat_path = repeat_path or f"{bad_path.rstrip('/')}_repeats"
    run = f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            good = batch.where("error is null")
            days = good.agg(F.min("dt").alias("first"), F.max("dt").alias("last")).first()
            before = _written(spark, panel_path).where(~((F.col("run") == run) & (F.col("batch") == number)))
            known = before.where(F.col("dt").between(F.lit(days["first"]), F.lit(days["last"]))).select("product_id", "dt").distinct().withColumn("known", F.lit(True))
            # Of rows of one key in a batch the least by content is the first, so that a second try decides alike.
            rest = [c for c in schema.PANEL.names if c not in ("product_id", "dt")]
            place = F.row_number().over(Window.partitionBy("product_id", "dt").orderBy(*rest))
            placed = good.withColumn("place", place).join(known, ["product_id", "dt"], "left")
            new = F.col("known").isNull() & (F.col("place") == 1)
            own = f"run={run}/batch={number}"
            placed.where(~new).select(*schema.PANEL.names).write.mode("overwrite").parquet(f"{repeat_path}/{own}")
            batch.where("error is not null").write.mode("overwrite").parquet(f"{bad_path}/{own}")
            placed.where(new).select(*schema.PANEL.names).write.mode("overwrite").parquet(f"{panel_path}/{own}")
        finally:
            batch.unpersist()

    return checked(raw, revision).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
