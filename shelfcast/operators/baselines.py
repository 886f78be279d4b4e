"""Four fixed forecasting models, all computed from one array of each product's history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schema
from shelfcast.errors import BaselineError, TargetNotInFutureError
from shelfcast.functions.exact import total

#: A model takes the history (array of (dt, y) by day, never empty), the target's day and the parameters.
Model = Callable[[Column, Column, dict], Column]


def _values(history: Column) -> Column:
    return F.transform(history, lambda x: x["y"])


def naive(history: Column, dt: Column, params: dict) -> Column:
    """The last observed sale."""
    return F.try_element_at(history, F.lit(-1))["y"]


def seasonal_naive(history: Column, dt: Column, params: dict) -> Column:
    """The sale on the very day one season before; without it, none."""
    lag = F.date_sub(dt, schema.SEASON_DAYS)
    return F.get(F.filter(history, lambda x: x["dt"] == lag), F.lit(0))["y"]


def moving_average(history: Column, dt: Column, params: dict) -> Column:
    """Mean of the last rows (not days); a shorter history gives all it has."""
    w = params.get("window", schema.MOVING_AVERAGE_WINDOW)
    last = F.slice(_values(history), F.greatest(F.size(history) - (w - 1), F.lit(1)), F.lit(w))
    return total(last) / F.size(last)


def ses(history: Column, dt: Column, params: dict) -> Column:
    """The final level of simple exponential smoothing, flat for all days ahead."""
    alpha = float(params.get("alpha", schema.SES_ALPHA))
    y = _values(history)
    return F.aggregate(F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0))), F.get(y, F.lit(0)), lambda level, x: F.lit(alpha) * x + F.lit(1 - alpha) * level)


BASELINES: dict[str, Model] = {"naive": naive, "seasonal_naive": seasonal_naive, "moving_average": moving_average, "ses": ses}


def check_params(window: int, alpha: float) -> None:
    if isinstance(window, bool) or not isinstance(window, int) or window < 1:
        raise ValueError(f"window must be a whole number of 1 or more, not {window!r}")
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)) or not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be a number from 0 to 1, not {alpha!r}")


def forecast(rows: DataFrame, *, window: int = schema.MOVING_AVERAGE_WINDOW, alpha: float = schema.SES_ALPHA, models: dict[str, Model] | None = None, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """One row for each target and model.

    rows: keys, dt, observed_sales, stockout_hours_6_22, observation_state, revision and role ('fit' or 'target').
    Fit and target rows of a product meet in one aggregate, so all models of all folds cost one shuffle. A product
    holds a row a day at most, which bounds the arrays.
    """
    check_params(window, alpha)
    models = models or BASELINES
    params = {"window": window, "alpha": alpha}
    fit, target = F.col("role") == "fit", F.col("role") == "target"
    held = F.struct("dt", schema.TARGET, "stockout_hours_6_22", "observation_state", "revision")
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(fit, F.struct("dt", F.col(schema.TARGET).alias("y"))))).alias("history"), F.collect_list(F.when(target, held)).alias("targets"))
    targets = by.select(*keys, "history", F.explode("targets").alias("t"))
    has = F.size("history") > 0
    cells = [F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_rank"), F.when(has, make(F.col("history"), F.col("t.dt"), params)).alias("prediction")) for i, (name, make) in enumerate(models.items())]
    out = targets.select(*keys, "t.*", has.alias("_has"), F.explode(F.array(*cells)).alias("m")).select("*", "m.*").drop("m")
    missing = F.col("prediction").isNull()
    return out.select(
        "model", "model_rank", *keys, "dt", schema.TARGET, "prediction",
        F.when(missing, schema.PREDICTION_UNAVAILABLE).otherwise(schema.PREDICTION_AVAILABLE).alias("prediction_state"),
        F.when(missing, F.when(F.col("_has"), schema.REASON_NO_SEASONAL_LAG).otherwise(schema.REASON_NO_HISTORY)).alias("unavailable_reason"),
        "stockout_hours_6_22", "observation_state", "revision",
    )


def past_targets(train: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets on or before the last training day of their product; products without history are exempt."""
    last = train.groupBy("product_id").agg(F.max("dt").alias("last_dt"))
    return targets.join(last, "product_id").where("dt <= last_dt")


def fit_baseline(name: str, train: DataFrame, targets: DataFrame, **params) -> DataFrame:
    """Forecast rows of one model for targets (as project_targets gives them) from the panel rows in train."""
    if name not in BASELINES:
        raise ValueError(f"unknown model {name!r}; known: {sorted(BASELINES)}")
    found = past_targets(train, targets).orderBy("product_id", "dt").limit(5).collect()
    if found:
        raise TargetNotInFutureError(f"targets not after training: {[(r['product_id'], r['dt'].isoformat()) for r in found]}")
    columns = ["product_id", "dt", schema.TARGET, "stockout_hours_6_22", "observation_state", "revision"]
    past = train.select("product_id", "dt", F.col("sale_amount").alias(schema.TARGET), "stockout_hours_6_22", F.lit(None).cast("string").alias("observation_state"), "revision", F.lit("fit").alias("role"))
    rows = past.unionByName(targets.select(*columns, F.lit("target").alias("role")))
    return forecast(rows, models={name: BASELINES[name]}, **params).withColumn("model_rank", F.lit(list(BASELINES).index(name)))


def fit_naive(train: DataFrame, targets: DataFrame) -> DataFrame:
    return fit_baseline("naive", train, targets)


def fit_seasonal_naive(train: DataFrame, targets: DataFrame) -> DataFrame:
    return fit_baseline("seasonal_naive", train, targets)


def fit_moving_average(train: DataFrame, targets: DataFrame, *, window: int = schema.MOVING_AVERAGE_WINDOW) -> DataFrame:
    return fit_baseline("moving_average", train, targets, window=window)


def fit_ses(train: DataFrame, targets: DataFrame, *, alpha: float = schema.SES_ALPHA) -> DataFrame:
    return fit_baseline("ses", train, targets, alpha=alpha)


def register(name: str, model: Model) -> None:
    """Adds a model of one's own."""
    if name in BASELINES:
        raise BaselineError(f"{name!r} is taken")
    BASELINES[name] = model
