"""Validation of raw daily rows, as columns: the first rule that a row breaks names its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import errors, schema
from shelfcast.functions.exact import total as exact_total

#: What counts as white space at the ends of an id.
WHITE = r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def window_sum(status: Column) -> Column:
    """Stockout hours from hour 6 up to, not with, hour 22."""
    hours = schema.WINDOW_END_HOUR - schema.WINDOW_FIRST_HOUR
    return F.aggregate(F.slice(status, schema.WINDOW_FIRST_HOUR + 1, hours), F.lit(0), lambda a, x: a + x)


def is_close(a: Column, b: Column) -> Column:
    """Equal, or within the relative or the absolute tolerance; false for NaN."""
    near = F.abs(a - b) <= F.greatest(F.lit(schema.SUM_REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(schema.SUM_ABS_TOL))
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (finite & near))


def stripped(text: Column) -> Column:
    """text without white space at its ends, tabs, line ends and Unicode spaces included."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def product_key(raw: Column) -> tuple[Column, Column]:
    """Canonical id, and whether it is an integer: text that reads as a whole number is that number, without sign or zeros in front."""
    text = stripped(raw)
    is_int = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    digits = F.regexp_replace(F.regexp_replace(text, "_", ""), r"^[+-]?0*(?=[0-9])", "")
    number = F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(is_int, number).otherwise(text), is_int


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def checked(raw: DataFrame, revision: str) -> DataFrame:
    """raw as panel columns plus error (name of the error class, or null) and reason.

    raw has the columns of schema.RAW; a column `date` stands in for a missing `dt`, row by row.
    """
    revision = validate_revision(revision)
    kinds = dict(raw.dtypes)
    dt = F.col("dt").cast("string") if "dt" in kinds else F.lit(None).cast("string")
    dt = F.coalesce(dt, F.col("date").cast("string")) if "date" in kinds else dt
    id_fits = kinds.get("product_id") in ("string", "int", "bigint", "smallint", "tinyint")
    key, is_int = product_key(F.col("product_id").cast("string"))
    sales, status, total = F.col("hours_sale"), F.col("hours_stock_status"), F.col("sale_amount").cast("double")
    counter = F.col("stock_hour6_22_cnt")
    hour_sum = exact_total(sales.cast("array<double>"))
    number_kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    is_number = F.lit(kinds.get("sale_amount") in number_kinds or kinds.get("sale_amount", "").startswith("decimal"))
    row, length = "RowValidationError", "HourlyVectorLengthError"
    rules = [
        (F.col("product_id").isNull() | total.isNull() | sales.isNull() | status.isNull() | counter.isNull(), row, "missing field"),
        (F.lit(not id_fits) | (stripped(F.col("product_id").cast("string")) == ""), row, "product_id"),
        (dt.isNull(), row, "no dt and no date"),
        (iso_date(dt).isNull(), row, "dt is not an ISO date"),
        (~is_number, row, "sale_amount"),
        (F.size(sales) != schema.HOURS_PER_DAY, length, "hours_sale"),
        (~F.forall(sales, lambda x: x.isNotNull()), row, "hours_sale holds a non-number"),
        (F.size(status) != schema.HOURS_PER_DAY, length, "hours_stock_status"),
        (~F.coalesce(F.forall(status, lambda x: x.isNotNull() & x.isin(0, 1)), F.lit(False)), "StockStatusValueError", "hours_stock_status"),
        (counter < 0, row, "stock_hour6_22_cnt"),
        (counter != window_sum(status), "StockCounterError", "stock_hour6_22_cnt differs from its hours"),
        (~is_close(hour_sum, total), "DailySumMismatchError", "hours_sale don't add up to sale_amount"),
    ]
    error, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for broken, name, why in reversed(rules):
        error, reason = F.when(broken, name).otherwise(error), F.when(broken, why).otherwise(reason)
    kept = [c for c in raw.columns if c not in schema.PANEL.names and c != "date"]
    return raw.select(
        key.alias("product_id"), is_int.alias("product_is_int"), iso_date(dt).alias("dt"), total.alias("sale_amount"),
        sales.cast("array<double>").alias("hours_sale"), status.cast("array<int>").alias("hours_stock_status"), counter.cast("int").alias("stock_hour6_22_cnt"),
        window_sum(status).cast("int").alias("stockout_hours_6_22"), F.lit(revision).alias("revision"), error.alias("error"), reason.alias("reason"),
        *[F.col(f"`{c}`") for c in kept if c not in ("error", "reason")],
    )


def parse_daily_rows(raw: DataFrame, revision: str, ordinal: str | None = None) -> DataFrame:
    """The panel of raw. The first bad row (by ordinal, if given) raises its error."""
    rows = checked(raw, revision)
    bad = rows.where("error is not null")
    found = (bad.orderBy(ordinal) if ordinal else bad).limit(1).collect()
    if found:
        raise errors.ROW_ERRORS[found[0]["error"]](f"{found[0]['reason']}: product {found[0]['product_id']!r} on {found[0]['dt']}")
    return rows.select(*schema.PANEL.names)


def quarantine(raw: DataFrame, revision: str) -> tuple[DataFrame, DataFrame]:
    """The panel of the good rows, and the bad rows with error and reason."""
    rows = checked(raw, revision)
    return rows.where("error is null").select(*schema.PANEL.names), rows.where("error is not null")


def validate_revision(revision: str) -> str:
    if not isinstance(revision, str) or not revision.strip():
        raise errors.UnpinnedRevisionError(f"a revision must be given, not {revision!r}")
    return revision.strip()
