"""Sources of daily rows: files, injected loaders, bounded reads, and a panel made of the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import errors, schema
from shelfcast.functions.rows import parse_daily_rows, validate_revision, window_sum

RawRowLoader = Callable[[SparkSession, str], DataFrame]
StreamRowLoader = Callable[[SparkSession, str, str], DataFrame]


def read_raw(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw daily rows from Parquet or JSON lines; the schema is fixed, nothing is inferred."""
    reader = spark.read.schema(schema.RAW)
    return reader.json(path) if kind == "json" else reader.format(kind).load(path)


def acquire(spark: SparkSession, revision: str, loader: RawRowLoader | None = None) -> DataFrame:
    """All rows of the loader as a panel. Without a loader it fails: nothing is fetched by default."""
    revision = validate_revision(revision)
    if loader is None:
        raise errors.FreshRetailDomainError("a loader must be given")
    return parse_daily_rows(loader(spark, revision), revision)


def validate_stream_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= schema.MAX_STREAM_ROWS:
        raise errors.InvalidStreamLimitError(f"limit must be 1 to {schema.MAX_STREAM_ROWS}, not {limit!r}")
    return limit


def validate_stream_revision(revision: str, pinned: str = schema.PINNED_REVISION) -> str:
    revision = validate_revision(revision)
    if revision != pinned:
        raise errors.NonPinnedRevisionError(f"revision {revision!r} is not the pinned one")
    return revision


def hub_loader(dataset: str) -> StreamRowLoader:
    """A loader that reads a public dataset hub through the optional package `datasets`."""

    def load(spark: SparkSession, revision: str, split: str) -> DataFrame:
        try:
            from datasets import load_dataset
        except ImportError as e:
            raise errors.FreshRetailDomainError("the optional package 'datasets' is not installed") from e
        rows = load_dataset(dataset, split=split, revision=revision, streaming=True).take(schema.MAX_STREAM_ROWS)
        return spark.createDataFrame([(i, *(r.get(c) for c in schema.RAW.names)) for i, r in enumerate(rows)], "ordinal long, " + ", ".join(f.simpleString().replace(":", " ", 1) for f in schema.RAW.fields))

    return load


def bounded(raw: DataFrame, limit: int, ordinal: str) -> DataFrame:
    """The first limit rows by an explicit ordinal; rows past them are never validated."""
    return raw.orderBy(ordinal).limit(validate_stream_limit(limit))


def stream_daily(spark: SparkSession, limit: int, loader: StreamRowLoader, split: str = "train", revision: str = schema.PINNED_REVISION, ordinal: str = "ordinal") -> DataFrame:
    """A bounded prefix of a source as a panel. Arguments are checked before anything is read."""
    limit, revision = validate_stream_limit(limit), validate_stream_revision(revision)
    return parse_daily_rows(bounded(loader(spark, revision, split), limit, ordinal), revision, ordinal)


def panel_from_events(events: DataFrame, revision: str = "events") -> DataFrame:
    """The panel of an events table: a user is a product, a day's value its sales, an hour with an error a stockout hour.

    Values are summed as decimals, so totals don't depend on the order of rows.
    """
    value = F.coalesce(F.col("value"), F.lit(0)).cast("decimal(18,2)")
    hours = events.groupBy(F.col("user_id"), F.to_date("ts").alias("dt"), F.hour("ts").alias("h")).agg(F.sum(value).alias("v"), F.max((F.col("event_type") == "error").cast("int")).alias("s"))
    days = hours.groupBy("user_id", "dt").agg(F.sum("v").cast("double").alias("sale_amount"), F.map_from_entries(F.collect_list(F.struct("h", F.struct(F.col("v").cast("double").alias("v"), "s")))).alias("m"))
    each = F.sequence(F.lit(0), F.lit(schema.HOURS_PER_DAY - 1))
    out = days.select(
        F.col("user_id").cast("string").alias("product_id"), F.lit(True).alias("product_is_int"), "dt", "sale_amount",
        F.transform(each, lambda h: F.coalesce(F.try_element_at("m", h)["v"], F.lit(0.0))).alias("hours_sale"),
        F.transform(each, lambda h: F.coalesce(F.try_element_at("m", h)["s"], F.lit(0))).alias("hours_stock_status"),
    )
    stockouts = window_sum(F.col("hours_stock_status")).cast("int")
    return out.select("*", stockouts.alias("stock_hour6_22_cnt"), stockouts.alias("stockout_hours_6_22"), F.lit(revision).alias("revision"))


def panel_from_lineitem(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """A long daily series for each brand: quantity shipped. It has no hourly vectors."""
    rows = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"])
    days = rows.groupBy(F.col("p_brand").alias("product_id"), F.to_date("l_shipdate").alias("dt")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sale_amount"))
    return days.select("product_id", F.lit(False).alias("product_is_int"), "dt", "sale_amount", F.lit(0).alias("stockout_hours_6_22"))
