"""Accuracy of forecasts, by group, in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema
from shelfcast.functions.exact import digit_sums, finished

MEASURES = ("requested", "available", "unavailable", "evaluated", "coverage", "stockout_rows", "mae", "rmse", "wmape", "bias", "wmape_status")


def evaluate_metrics(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Counts, coverage, MAE, RMSE, WMAPE and bias of each group, from sums that don't depend on the order of rows. A pair counts if both its numbers are there; zero is there."""
    pred, real = F.col("prediction"), F.col(schema.TARGET)
    pair = pred.isNotNull() & real.isNotNull()
    error = F.when(pair, pred - real)
    out = forecasts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requested"), F.count(pred).alias("available"), F.count(error).alias("evaluated"),
        F.count_if(pair & (F.col("stockout_hours_6_22") > 0)).alias("stockout_rows"),
        *digit_sums(F.abs(error), "_errors"), *digit_sums(error * error, "_squares"), *digit_sums(error, "_signed"), *digit_sums(F.when(pair, F.abs(real)), "_actuals"),
    )
    return finish(finished(out, "_errors", "_squares", "_signed", "_actuals")).select(*by, *MEASURES)


def finish(sums: DataFrame) -> DataFrame:
    """The measures that follow from the sums; also for groups without any row, whose sums are null."""
    zero = F.lit(0).cast("long")
    out = sums.withColumns({c: F.coalesce(c, zero) for c in ("requested", "available", "evaluated", "stockout_rows")})
    n = F.col("evaluated").cast("double")
    return out.withColumns({
        "mae": F.try_divide("_errors", n), "rmse": F.sqrt(F.try_divide("_squares", n)), "bias": F.try_divide("_signed", n),
        "unavailable": F.col("requested") - F.col("available"),
        "coverage": F.coalesce(F.try_divide(F.col("available").cast("double"), F.col("requested").cast("double")), F.lit(0.0)),
        "wmape": F.when(F.col("_actuals") != 0, F.try_divide("_errors", "_actuals")),
        "wmape_status": F.when(F.col("evaluated") == 0, schema.WMAPE_NO_EVALUABLE).when(F.col("_actuals") == 0, schema.WMAPE_ZERO_ACTUALS).otherwise(schema.WMAPE_CALCULABLE),
    })


def on_grid(metrics: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """A row for each cell of the grid; a cell without forecasts has zero counts, null measures and its status."""
    out = grid.join(metrics, by, "left")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requested", "available", "unavailable", "evaluated", "stockout_rows")}
    return out.withColumns(filled | {"coverage": F.coalesce("coverage", F.lit(0.0)), "wmape_status": F.coalesce("wmape_status", F.lit(schema.WMAPE_NO_EVALUABLE))})
