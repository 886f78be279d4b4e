"""Registered queries: each applies one operator to the panel that the events table makes, or to its own table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schema
from shelfcast.functions.rows import checked, is_close, window_sum
from shelfcast.operators import metrics, panel, splits
from shelfcast.plans import evaluation, report
from shelfcast.sources.daily import bounded, panel_from_events, panel_from_lineitem

#: The events span 30 days from here at every size.
FOLDS = splits.derive_folds(date(2024, 1, 1), 30)
#: A fold with a gap between its ranges, for what the parts leave out, and with higher needs.
GAPPED = [splits.Fold("gapped", date(2024, 1, 3), date(2024, 1, 15), date(2024, 1, 18), date(2024, 1, 20), date(2024, 1, 24), date(2024, 1, 28), min_history_days=12, min_history_span_days=13)]
EXPANDING = splits.expanding_window_folds(start=date(2024, 1, 1), initial_train_days=10, validation_days=3, folds=4, step_days=3, test_start=date(2024, 1, 25), test_days=4)

#: A fold that begins before the events and ends after them, and one whose test range lies in its training, for the guards to find.
EDGE = splits.Fold("edge", date(2023, 12, 28), date(2024, 1, 20), date(2024, 1, 21), date(2024, 1, 25), date(2024, 1, 26), date(2024, 2, 5))
OVERLAP = splits.Fold("overlap", date(2024, 1, 1), date(2024, 1, 20), date(2024, 1, 21), date(2024, 1, 22), date(2024, 1, 15), date(2024, 1, 25))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_events(events(spark, d))


def cells(spark: SparkSession, d: str, partition: str = "test") -> DataFrame:
    return evaluation.evaluation_grid(rows(spark, d), FOLDS, partition)


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Measures to six decimals: sums of doubles depend on the order of rows beyond that."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def measures(df: DataFrame) -> DataFrame:
    return six(df.select("fold", "model", *metrics.MEASURES), "coverage", "mae", "rmse", "wmape", "bias")


@query
def daily_panel(spark, d):
    return rows(spark, d).select("product_id", "dt", "sale_amount", "stock_hour6_22_cnt", "stockout_hours_6_22")


@query
def hourly_expansion(spark, d):
    return panel.expand_to_hourly(rows(spark, d)).select("product_id", "dt", F.col("hour").cast("int").alias("hour"), "sales_qty_observed", "stockout_flag", "sales_observation_state")


@query
def hourly_stockout_window(spark, d):
    return rows(spark, d).groupBy(window_sum(F.col("hours_stock_status")).cast("int").alias("stockout_hours_6_22")).agg(F.count(F.lit(1)).alias("n"))


@query
def target_projection(spark, d):
    return panel.project_targets(rows(spark, d)).select("product_id", "dt", "observed_sales", "stockout_hours_6_22", "observation_state")


@query
def observation_state_counts(spark, d):
    return panel.project_targets(rows(spark, d)).groupBy("observation_state").agg(F.count(F.lit(1)).alias("n"))


@query
def snapshot_summary(spark, d):
    return panel.snapshot_summary(rows(spark, d))


@query
def duplicate_keys(spark, d):
    """Events as if each were a daily row: keys that repeat."""
    return panel.duplicate_keys(events(spark, d).select(F.col("user_id").cast("string").alias("product_id"), F.to_date("ts").alias("dt")))


@query
def distinct_revisions(spark, d):
    return rows(spark, d).groupBy("revision").agg(F.count(F.lit(1)).alias("n"))


def _broken(spark, d):
    """The panel as raw rows, some broken in ways that follow from the key."""
    p = rows(spark, d).withColumn("k", F.pmod(F.col("product_id").cast("int") + F.dayofmonth("dt"), F.lit(11)))
    return p.select(
        F.when(F.col("k") == 1, " ").otherwise(F.concat(F.lit(" "), "product_id")).alias("product_id"), F.when(F.col("k") == 2, F.date_format("dt", "yyyy/MM/dd")).otherwise(F.col("dt").cast("string")).alias("dt"),
        (F.col("sale_amount") + F.when(F.col("k") == 3, 1.0).otherwise(0.0)).alias("sale_amount"), F.when(F.col("k") == 4, F.slice("hours_sale", 1, 23)).otherwise(F.col("hours_sale")).alias("hours_sale"),
        F.when(F.col("k") == 5, F.transform("hours_stock_status", lambda x: x + 2)).otherwise(F.col("hours_stock_status")).alias("hours_stock_status"), (F.col("stock_hour6_22_cnt") + F.when(F.col("k") == 6, 1).otherwise(0)).alias("stock_hour6_22_cnt"),
        F.col("product_id").alias("true_id"), F.col("dt").alias("true_dt"),
    )


@query
def row_validation(spark, d):
    """The error class of each raw row, null for a good one."""
    return checked(_broken(spark, d), "events").select("true_id", "true_dt", "error")


@query
def quarantine_counts(spark, d):
    return checked(_broken(spark, d), "events").where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def daily_sum_check(spark, d):
    p = rows(spark, d).withColumn("hour_sum", F.aggregate("hours_sale", F.lit(0.0), lambda a, x: a + x))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_close(F.col("hour_sum"), F.col("sale_amount"))).alias("n_close"))


@query
def stock_counter_check(spark, d):
    return rows(spark, d).agg(F.count_if(F.col("stock_hour6_22_cnt") == window_sum(F.col("hours_stock_status"))).alias("n_equal"), F.sum("stock_hour6_22_cnt").alias("hours"))


@query
def partition_rows(spark, d):
    return splits.row_counts(rows(spark, d), FOLDS)


@query
def excluded_rows(spark, d):
    return splits.row_counts(rows(spark, d), GAPPED).select("fold", "excluded_out_of_range")


@query
def split_assignment(spark, d):
    return splits.assign(rows(spark, d), GAPPED).select("product_id", "dt", "fold", "part")


@query
def missing_dates_global(spark, d):
    """Of folds that reach past the panel's first and last day."""
    return splits.missing_dates(rows(spark, d), [*FOLDS, EDGE])


@query
def missing_dates_per_product(spark, d):
    return splits.missing_per_product(rows(spark, d), GAPPED).select("fold", "product_id", F.explode("dates").alias("dt"))


@query
def insufficient_history(spark, d):
    return splits.insufficient_history(rows(spark, d), GAPPED)


@query
def insufficient_fit_history(spark, d):
    return splits.insufficient_fit_history(rows(spark, d), GAPPED, "test")


@query
def fit_bounds(spark, d):
    return splits.fit_bounds(rows(spark, d), FOLDS, "test")


@query
def expanding_folds_counts(spark, d):
    return splits.row_counts(rows(spark, d), EXPANDING)


@query
def future_target_guard(spark, d):
    """Offenders of each fold; only the overlapping one has any."""
    return evaluation.future_violations(rows(spark, d), [*FOLDS, OVERLAP], "test").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def fit_test_overlap(spark, d):
    """Keys of each fold that stand on both sides; only the overlapping one has any."""
    return evaluation.overlap(rows(spark, d), [*FOLDS, OVERLAP], "test").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def _forecasts(spark, d, model=None, partition="test"):
    out = evaluation.forecasts(rows(spark, d), FOLDS, partition)
    out = out.where(F.col("model") == model) if model else out
    return six(out.select("model", "fold", "product_id", "dt", "observed_sales", "prediction", "unavailable_reason"), "prediction")


@query
def naive_forecast(spark, d):
    return _forecasts(spark, d, "naive")


@query
def seasonal_naive_forecast(spark, d):
    return _forecasts(spark, d, "seasonal_naive")


@query
def moving_average_forecast(spark, d):
    return _forecasts(spark, d, "moving_average")


@query
def ses_forecast(spark, d):
    return _forecasts(spark, d, "ses")


@query
def forecast_all_long(spark, d):
    return _forecasts(spark, d)


@query
def unavailable_reasons(spark, d):
    out = evaluation.forecasts(rows(spark, d), GAPPED, "test").where("prediction_state = 'unavailable'")
    return out.groupBy("model", "unavailable_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def metrics_validation(spark, d):
    return measures(cells(spark, d, "validation"))


@query
def metrics_test(spark, d):
    return measures(cells(spark, d))


@query
def evaluation_grid(spark, d):
    return measures(cells(spark, d)).withColumn("protocol", F.lit(schema.PROTOCOL_VERSION))


@query
def wmape_status(spark, d):
    """Statuses where sales of one product in three are zero and the season is out of reach."""
    p = rows(spark, d).withColumn("sale_amount", F.when(F.col("product_id").cast("int") % 3 == 0, 0.0).otherwise(F.col("sale_amount")))
    out = evaluation.forecasts(p, FOLDS, "test").withColumn("third", F.pmod(F.col("product_id").cast("int"), F.lit(3)))
    return metrics.evaluate_metrics(out, ["fold", "model", "third"]).select("fold", "model", "third", "evaluated", "wmape_status")


@query
def coverage_facts(spark, d):
    return evaluation.coverage_facts(rows(spark, d)).withColumn("missing_dates", F.size("missing_dates"))


@query
def missing_dates_by_product(spark, d):
    return evaluation.missing_dates_by_product(rows(spark, d)).select("product_id", F.explode("dates").alias("dt"))


@query
def seasonal_naive_by_fold(spark, d):
    return six(report.seasonal_naive_by_fold(cells(spark, d)), "coverage")


@query
def coverage_complete(spark, d):
    return report.coverage_complete(cells(spark, d))


@query
def results_table(spark, d):
    return six(report.results_table(cells(spark, d), "fold-2"), "mae", "rmse", "wmape", "bias", "coverage")


@query
def argmin_by_fold_metric(spark, d):
    return six(report.smallest(cells(spark, d)).select("fold", "metric", "model", "value"), "value")


@query
def universal_winner(spark, d):
    return report.universal_winner(cells(spark, d))


@query
def stockout_facts(spark, d):
    return report.stockout_facts(cells(spark, d))


@query
def comparison_data(spark, d):
    return six(report.comparison_data(cells(spark, d)), "value")


@query
def comparison_min_values(spark, d):
    return report.comparison_min_values(cells(spark, d))


@query
def comparison_equivalent_rows(spark, d):
    return report.comparison_data(cells(spark, d)).select("fold_label", "metric", "model", "formatted", F.when(F.col("is_min"), "smallest value").otherwise("").alias("minimum"))


@query
def bar_widths(spark, d):
    return six(report.bar_widths(cells(spark, d)), "width")


@query
def conclusion_summary(spark, d):
    return six(report.conclusion_summary(cells(spark, d)), "mae_value", "rmse_value", "wmape_value")


@query
def observations(spark, d):
    return report.observations(cells(spark, d)).select("text")


@query
def localized_observations(spark, d):
    return report.localized_observations(cells(spark, d)).select("text")


@query
def fold_labels(spark, d):
    return report.fold_labels(cells(spark, d))


@query
def report_table_rows(spark, d):
    return report.table_rows(cells(spark, d))


@query
def protocol_segments(spark, d):
    return report.protocol_segments(spark, FOLDS)


@query
def stockout_share(spark, d):
    return six(report.stockout_share(evaluation.coverage_facts(rows(spark, d))), "stockout_percent")


@query
def bounded_prefix(spark, d):
    return bounded(events(spark, d), 100, "event_id").select("event_id", "user_id", "value")


@query
def product_sort_order(spark, d):
    """The place of each product in panel order."""
    return panel.product_places(rows(spark, d).select("product_id", "product_is_int").distinct())


@query
def brand_daily_panel(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return panel_from_lineitem(read("lineitem"), read("part")).select("product_id", "dt", "sale_amount")
