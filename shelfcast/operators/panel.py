"""Whole-panel checks and projections."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import errors, schema

#: Offenders that an error names.
SHOWN = 20


class SnapshotContext(Enum):
    COMPLETE = "complete"
    BOUNDED = "bounded"


def product_order() -> list[Column]:
    """Whole numbers first, then text; both by their characters, so 379 comes before 38 and 38 before 4."""
    return [F.col("product_is_int").desc(), F.col("product_id").asc()]


def product_places(products: DataFrame) -> DataFrame:
    """product_id and its place, from 1, in product_order() among products (product_id, product_is_int), which are distinct.

    Ids are counted by the ranges that their first characters make, the counts are summed up in order, and only the ids
    of one range are ranked together.
    """
    ranges = products.withColumn("kind", (~F.col("product_is_int")).cast("int")).withColumn("start", F.substring("product_id", 1, 4))
    counts = ranges.groupBy("kind", "start").agg(F.count(F.lit(1)).alias("n"))
    # A row for each range: each kind's starts are summed up apart, whole numbers first.
    before = counts.select("kind", "start", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    whole = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("whole"))
    inside = ranges.withColumn("inside", F.row_number().over(Window.partitionBy("kind", "start").orderBy("product_id")))
    place = F.col("inside") + F.col("before") + F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.lit(0))
    return inside.join(before, ["kind", "start"]).join(F.broadcast(whole)).select("product_id", place.cast("int").alias("place"))


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """product_id, dt and n of keys that stand more than once."""
    return panel.groupBy("product_id", "dt").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(panel: DataFrame) -> DataFrame:
    found = duplicate_keys(panel).orderBy("product_id", "dt").limit(SHOWN + 1).collect()
    if found:
        more = " and more; duplicate_keys() has all" if len(found) > SHOWN else ""
        raise errors.DuplicateKeyError(f"keys that repeat: {[(r['product_id'], str(r['dt'])) for r in found[:SHOWN]]}{more}")
    return panel


def validate_unique_and_sort(panel: DataFrame) -> DataFrame:
    return require_unique(panel).orderBy(*product_order(), "dt")


def snapshot_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("product_id").alias("unique_products"))


def validate_global_snapshot(panel: DataFrame, *, context: SnapshotContext, expected_unique_products: int = schema.EXPECTED_UNIQUE_PRODUCTS) -> dict[str, int]:
    """Row and product counts; a complete snapshot must hold exactly the expected products, an empty one is an error."""
    if not isinstance(context, SnapshotContext):
        raise TypeError(f"context must be a SnapshotContext, not {context!r}")
    got = snapshot_summary(panel).first().asDict()
    if not got["total_rows"]:
        raise errors.GlobalSnapshotError("the snapshot is empty")
    if context is SnapshotContext.COMPLETE and got["unique_products"] != expected_unique_products:
        raise errors.GlobalSnapshotError(f"{got['unique_products']} products, not {expected_unique_products}")
    return got


def state(flag: Column) -> Column:
    return F.when(flag, schema.STATE_CENSORED).otherwise(schema.STATE_OBSERVED)


def expand_to_hourly(panel: DataFrame) -> DataFrame:
    """24 records a row. Sales of stockout hours stay as observed; the flag marks them. Demand is never estimated."""
    hours = panel.select("*", F.posexplode(F.arrays_zip("hours_sale", "hours_stock_status")).alias("hour", "x"))
    out_of_stock = F.col("x.hours_stock_status") == 1
    return hours.select(
        "product_id", "product_is_int", "dt", "hour", F.col("x.hours_sale").alias("sales_qty_observed"), out_of_stock.alias("stockout_flag"), "hours_sale", "hours_stock_status",
        "stock_hour6_22_cnt", "stockout_hours_6_22", state(out_of_stock).alias("sales_observation_state"), F.lit(None).cast("double").alias("latent_demand_estimate"), "revision",
    )


def project_targets(panel: DataFrame) -> DataFrame:
    """observed_sales by row; a stockout in any hour of the day, inside the window or not, censors the row."""
    return panel.select(
        "product_id", "product_is_int", "dt", F.col("sale_amount").alias(schema.TARGET), "stockout_hours_6_22", state(F.exists("hours_stock_status", lambda x: x == 1)).alias("observation_state"),
        "revision", F.lit(None).cast("double").alias("latent_demand_estimate"),
    )


def revisions(panel: DataFrame) -> list[str]:
    return sorted(r["revision"] for r in panel.select("revision").distinct().limit(10).collect())
