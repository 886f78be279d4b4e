"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sharding:
    """buckets: ranges of the seeded key (and of the fractional rank) that are counted first and ranked apart. They only divide the work; the shards don't depend on them."""

    shards: int = 40
    seed: int = 42
    buckets: int = 4096


def _ranked(df: DataFrame, group: list[Column], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the rank (from 0) of each row within its group by order, along which bucket must rise.

    Rows are counted by bucket, the counts are summed up in bucket order, and only rows of one bucket are ranked
    together. So a group of any size is spread over as many tasks as it has buckets.
    """
    keyed = df.withColumn("_b", bucket)
    keys = [f"_g{i}" for i in range(len(group))]
    for k, g in zip(keys, group, strict=True):
        keyed = keyed.withColumn(k, g)
    counts = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_total"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    left = keyed.withColumn("_in", inside).alias("l")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    return left.join(offsets.alias("r"), same).select("l.*", (F.col("_before") + F.col("_in")).alias(name), F.col(f"r.{name}_total")).drop("_in", "_b", *keys)


def interleave(docs: DataFrame, how: Sharding = Sharding()) -> DataFrame:
    """Deals all rows into shards that each hold the mixture of sources.

    Rows of each source are put in a seeded random order; a row at place r of n has the fractional rank
    (2 r + 1) / 2 n. All rows are sorted by it and cut into how.shards runs whose counts differ by one at most.

    docs needs doc_id, text and source; other columns are ignored. A null source is a source of its own. A null text
    has 0 bytes and the checksum of nothing. Rows with equal doc_id, text and source are interchangeable: each gets a
    place of its own. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_key", F.shiftrightunsigned(F.xxhash64(F.lit(how.seed), "doc_id", "text_crc32", "size"), 1))
    tie = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    by_source = _ranked(rows, [F.col("source")], F.shiftright(F.shiftright("_key", 32) * how.buckets, 31).cast("int"), [F.col("_key"), *tie], "_r")
    share = (2 * F.col("_r") + 1).cast("double") / (2 * F.col("_r_total")).cast("double")
    spread = by_source.withColumn("_share", share)
    bucket = F.least(F.floor(F.col("_share") * how.buckets), F.lit(how.buckets - 1)).cast("int")
    placed = _ranked(spread, [], bucket, [F.col("_share"), F.col("source"), F.col("_key"), *tie], "_p")
    shard = F.expr(f"(_p * {how.shards}) div _p_total")
    # The first place of shard s is the least p with p * shards >= s * total.
    first = F.expr(f"(_s * _p_total + {how.shards - 1}) div {how.shards}")
    return placed.withColumn("_s", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s").cast("int").alias("shard"), (F.col("_p") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
