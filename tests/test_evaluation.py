import json
import math
from datetime import date, timedelta

import pytest
from helpers import day, evaluation_rows, panel
from pyspark.sql import functions as F

from shelfcast import errors
from shelfcast.operators import baselines, metrics, splits
from shelfcast.operators import panel as panels
from shelfcast.operators.splits import Fold
from shelfcast.plans import evaluation

D = lambda d: date(2024, 1, d)
FOLDS = (Fold("fold-1", D(1), D(10), D(11), D(13), D(14), D(16)), Fold("fold-2", D(1), D(13), D(14), D(16), D(17), D(19)))
# model: requested, available, stockout rows, MAE, RMSE, WMAPE, bias
EXPECTED = {
    ("test", "fold-1", "naive"): (6, 3, 1, 2.0, 2.160246899469287, 0.13333333333333333, -2.0),
    ("test", "fold-1", "seasonal_naive"): (6, 3, 1, 7.0, 7.0, 0.4666666666666667, -7.0),
    ("test", "fold-1", "moving_average"): (6, 3, 1, 5.0, 5.066228051190222, 0.3333333333333333, -5.0),
    ("test", "fold-1", "ses"): (6, 3, 1, 4.301036996531003, 4.377851746255817, 0.28673579976873353, -4.301036996531003),
    ("test", "fold-2", "naive"): (6, 6, 2, 1.0, 1.5275252316519468, 0.08695652173913043, -1.0),
    ("test", "fold-2", "seasonal_naive"): (6, 3, 1, 7.0, 7.0, 0.3888888888888889, -7.0),
    ("test", "fold-2", "moving_average"): (6, 6, 2, 2.5, 3.582364210034113, 0.21739130434782608, -2.5),
    ("test", "fold-2", "ses"): (6, 6, 2, 2.161127844905069, 3.1103505360941863, 0.18792416042652774, -2.161127844905069),
    ("validation", "fold-1", "naive"): (3, 3, 1, 2.0, 2.160246899469287, 0.16666666666666666, -2.0),
    ("validation", "fold-1", "seasonal_naive"): (3, 3, 1, 7.0, 7.0, 0.5833333333333334, -7.0),
    ("validation", "fold-1", "ses"): (3, 3, 1, 4.2391749170000015, 4.317090529927376, 0.3532645764166668, -4.2391749170000015),
    ("validation", "fold-2", "naive"): (6, 3, 1, 2.0, 2.160246899469287, 0.13333333333333333, -2.0),
}


def config(partition="test", folds=FOLDS, **how):
    return evaluation.EvaluationConfig("e1", "s1", "test-rev", evaluation.SplitConfig(folds, partition), evaluation.BaselineConfig(**how))


@pytest.fixture(scope="module")
def rows(spark):
    return panel(spark, evaluation_rows())


def test_measures_by_hand(rows):
    for partition in ("test", "validation"):
        got = {(partition, r["fold"], r["model"]): r for r in evaluation.evaluation_grid(rows, FOLDS, partition).collect()}
        assert len(got) == 8
        for k, want in EXPECTED.items():
            if k[0] == partition:
                r = got[k]
                assert (r["requested"], r["available"], r["stockout_rows"]) == want[:3], k
                assert [r[m] for m in ("mae", "rmse", "wmape", "bias")] == pytest.approx(want[3:], rel=1e-12), k


def test_counts_and_fit_facts(rows):
    got = {r["fold"]: tuple(r)[1:] for r in splits.row_counts(rows, FOLDS).collect()}
    assert got == {"fold-1": (10, 3, 6, 7), "fold-2": (13, 6, 6, 1)}
    test = {r["fold"]: (r["fit_row_count"], r["fit_history_end"]) for r in splits.fit_bounds(rows, FOLDS, "test").collect()}
    assert test == {"fold-1": (13, D(13)), "fold-2": (19, D(16))}
    assert [r["fit_row_count"] for r in splits.fit_bounds(rows, FOLDS, "validation").orderBy("fold").collect()] == [10, 13]


def test_later_rows_never_change_a_forecast(rows):
    def seen(df):
        return sorted(map(tuple, evaluation.forecasts(df, FOLDS[:1], "test").select("model", "product_id", "dt", "prediction").collect()), key=str)

    changed = rows.withColumn("sale_amount", F.when(F.col("dt") >= F.lit(D(14)), 999.0).otherwise(F.col("sale_amount")))
    assert seen(rows) == seen(changed)
    earlier = rows.withColumn("sale_amount", F.when(F.col("dt") == F.lit(D(13)), 999.0).otherwise(F.col("sale_amount")))
    assert seen(rows) != seen(earlier)


def test_season_needs_the_exact_day(rows):
    got = evaluation.evaluation_grid(rows.where(F.col("dt") != F.lit(D(8))), FOLDS[:1], "test").where("model = 'seasonal_naive'").first()
    assert got["available"] == 2 and got["mae"] == 7.0
    reasons = {(r["product_id"], r["unavailable_reason"]) for r in evaluation.forecasts(rows, FOLDS, "test").where("prediction is null").collect()}
    assert reasons == {("C", "no training history for product"), ("C", "no seasonal lag observation in training")}


def test_empty_input_gives_every_cell(spark):
    report = evaluation.run_baseline_evaluation(panel(spark, []), config())
    assert len(report.results) == 8 and {r["wmape_status"] for r in report.results} == {"no_evaluable_predictions"} and all(r["mae"] is None and r["coverage"] == 0.0 for r in report.results)
    assert not any(s["evaluable"] for s in report.fold_statuses)


def test_zero_actuals(spark):
    rows = panel(spark, [day("A", D(1) + timedelta(i), 0) for i in range(16)])
    assert {(r["wmape"], r["wmape_status"], r["mae"]) for r in evaluation.evaluation_grid(rows, FOLDS[:1], "test").collect()} == {(None, "not_calculable_zero_actuals", 0.0)}


def test_parameters(rows):
    got = {r["model"]: r["mae"] for r in evaluation.evaluation_grid(rows, FOLDS[:1], "test", evaluation.BaselineConfig(moving_average_window=2, ses_alpha=1.0)).collect()}
    assert got["moving_average"] == 2.5 and got["ses"] == got["naive"]


def test_report_is_stable_and_whole(rows):
    a, b = (evaluation.run_baseline_evaluation(x, config()).to_json() for x in (rows, rows.orderBy(F.rand(1))))
    assert a == b
    data = json.loads(a)
    assert [(r["fold"], r["model"]) for r in data["results"]][:5] == [("fold-1", m) for m in ("naive", "seasonal_naive", "moving_average", "ses")] + [("fold-2", "naive")]
    status = data["fold_statuses"][0]
    assert status["excluded_out_of_range"] == 7 and status["fit_row_count"] == 13 and data["protocol"]["fit_partition"] == "train+validation"
    assert status["missing_per_product"][1] == {"product_id": "C", "dates": [D(d).isoformat() for d in range(1, 14)]}


def test_short_history(spark, rows):
    more = rows.union(panel(spark, [day("D", D(d), 1) for d in range(11, 17)]))
    folds = [Fold("fold-1", D(1), D(10), D(11), D(13), D(14), D(16), min_history_days=5, min_history_span_days=5)]
    got = {r["product_id"]: (r["observed_days"], r["observed_span_days"]) for r in splits.insufficient_fit_history(more, folds, "test").collect()}
    assert got == {"C": (0, 0), "D": (3, 3)}
    assert {r["product_id"]: r["observed_days"] for r in splits.insufficient_history(more, folds).collect()} == {"C": 0, "D": 0}


def test_gaps_between_parts_are_missing_and_excluded(spark):
    rows = panel(spark, [day("A", D(d), 1) for d in (1, 2, 4, 5, 7)])
    fold = Fold("f", D(1), D(4), D(6), D(7))
    assert [r["dt"] for r in splits.missing_dates(rows, [fold]).orderBy("dt").collect()] == [D(3), D(6)]
    assert splits.missing_per_product(rows, [fold]).first()["dates"] == [D(3), D(5), D(6)]
    assert splits.row_counts(rows, [fold]).first()["excluded_out_of_range"] == 1


def test_fold_rules():
    with pytest.raises(errors.InvalidBoundaryOrderError):
        Fold("f", D(5), D(4)).check_order()
    with pytest.raises(errors.InvalidBoundaryOrderError):
        Fold("f", D(1), D(4), D(4), D(6)).check_order()
    for bad in ({"fold": " "}, {"fold": True}, {"validation_start": D(9)}, {"min_history_days": 0}, {"min_history_span_days": True}):
        with pytest.raises(ValueError):
            Fold(**({"fold": "f", "train_start": D(1), "train_end": D(4)} | bad))
    made = splits.expanding_window_folds(start=D(1), initial_train_days=4, validation_days=2, folds=2, step_days=2, test_start=D(9), test_days=3)
    assert [(f.train_end, f.validation_start, f.validation_end, f.test_end) for f in made] == [(D(4), D(5), D(6), D(11)), (D(6), D(7), D(8), D(11))]
    with pytest.raises(errors.InvalidBoundaryOrderError):
        splits.expanding_window_folds(start=D(1), initial_train_days=4, validation_days=2, folds=2, step_days=2, test_start=D(8), test_days=3)
    long = splits.derive_folds(date(2024, 3, 28), 90)
    assert (long[0].train_end, long[0].test_start, long[1].train_end, long[1].test_end) == (date(2024, 5, 28), date(2024, 6, 5), date(2024, 6, 11), date(2024, 6, 25))


def test_real_shape(spark):
    start, ids = date(2024, 3, 28), ["379", "38", "4", "411", "580", "596", "600", "686", "699", "740", "834"]
    rows = panel(spark, [day(p, start + timedelta(i), 1) for p in ids for i in range(90)] + [day("548", start + timedelta(i), 1) for i in range(10)])
    folds = splits.derive_folds(start, 90)
    assert [tuple(r)[1:] for r in splits.row_counts(rows, folds).orderBy("fold").collect()] == [(692, 77, 77, 154), (846, 77, 77, 0)]
    assert [r["fit_row_count"] for r in splits.fit_bounds(rows, folds, "test").orderBy("fold").collect()] == [769, 923]
    gaps = {r["product_id"]: r["dates"] for r in evaluation.missing_dates_by_product(rows).collect()}
    assert len(gaps["548"]) == 80 and gaps["548"][0] == date(2024, 4, 7) and not gaps["379"]
    assert evaluation.coverage_facts(rows).first()["calendar_span_days"] == 90
    order = [r["product_id"] for r in panels.validate_unique_and_sort(rows).select("product_id").collect()]
    assert list(dict.fromkeys(order)) == ["379", "38", "4", "411", "548", "580", "596", "600", "686", "699", "740", "834"]


def test_fit_baseline_guards(spark):
    train = panel(spark, [day("A", D(d), d) for d in (1, 2, 3)])
    ahead = panels.project_targets(panel(spark, [day("A", D(4), 4), day("B", D(1), 1)]))
    assert {r["product_id"]: (r["prediction"], r["unavailable_reason"]) for r in baselines.fit_moving_average(train, ahead).collect()} == {"A": (2.0, None), "B": (None, "no training history for product")}
    assert [r["prediction"] for r in baselines.fit_ses(train, ahead, alpha=0).where("product_id = 'A'").collect()] == [1.0]
    with pytest.raises(errors.TargetNotInFutureError):
        baselines.fit_naive(train, panels.project_targets(train))
    with pytest.raises(ValueError):
        baselines.fit_baseline("other", train, ahead)
    for bad in ({"window": 0}, {"window": True}):
        with pytest.raises(ValueError):
            baselines.fit_moving_average(train, ahead, **bad)


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("m", 10.0, 10.0, 0), ("m", 10.0, 12.0, 1), ("m", 10.0, 9.0, 0), ("m", 10.0, None, 5), ("m", None, 3.0, 5)], "model string, observed_sales double, prediction double, stockout_hours_6_22 int")
    r = metrics.evaluate_metrics(rows, ["model"]).first()
    assert (r["requested"], r["available"], r["evaluated"], r["stockout_rows"]) == (5, 4, 3, 1)
    assert [r[m] for m in ("mae", "rmse", "wmape", "bias", "coverage")] == pytest.approx([1.0, math.sqrt(5 / 3), 0.1, 1 / 3, 0.8])


def test_run_refuses(spark, rows):
    with pytest.raises(errors.DuplicateKeyError):
        evaluation.run_baseline_evaluation(rows.union(rows), config())
    with pytest.raises(ValueError, match="revisions"):
        evaluation.run_baseline_evaluation(rows.withColumn("revision", F.lit("x")), config())
    for bad in (("naive",), ("naive", "naive", "ses", "moving_average"), ("naive", "seasonal_naive", "moving_average", "x")):
        with pytest.raises(ValueError):
            evaluation.BaselineConfig(models=bad)
    with pytest.raises(ValueError):
        evaluation.SplitConfig((FOLDS[0], FOLDS[0]), "test")
    with pytest.raises(ValueError):
        evaluation.SplitConfig(FOLDS, "train")


def test_tables_by_product_stay_off_the_driver(rows):
    made = evaluation.run_baseline_evaluation(rows, config())
    assert "missing_per_product" not in made.fold_statuses[0] and set(made.tables) == {"missing_per_product", "insufficient_history", "insufficient_fit_history"}
    few, all_ = made.to_dict(products=False), made.to_dict()
    assert "missing_per_product" not in few["fold_statuses"][0] and len(all_["fold_statuses"][0]["missing_per_product"]) == 2
    assert all("insufficient_fit_history" in r for r in all_["results"])


def test_own_models_are_evaluated(rows):
    def last_but_one(history, dt, params):
        return F.try_element_at(history, F.lit(-2))["y"]

    baselines.register("last_but_one", last_but_one)
    try:
        got = {r["model"]: r for r in evaluation.evaluation_grid(rows, FOLDS[:1], "test", evaluation.BaselineConfig(extra=("last_but_one",))).collect()}
        assert list(got) == ["naive", "seasonal_naive", "moving_average", "ses", "last_but_one"] or len(got) == 5
        assert got["last_but_one"]["mae"] == 3.0 and got["naive"]["mae"] == 2.0
        assert {r["model"] for r in evaluation.evaluation_grid(rows, FOLDS[:1], "test").collect()} == {"naive", "seasonal_naive", "moving_average", "ses"}
        assert "last_but_one" not in {r["model"] for r in evaluation.forecasts(rows, FOLDS[:1], "test").select("model").distinct().collect()}
    finally:
        del baselines.BASELINES["last_but_one"]
    with pytest.raises(ValueError, match="registered"):
        evaluation.BaselineConfig(extra=("last_but_one",))


def test_split_has_its_reports(spark):
    rows = panel(spark, [day("A", D(d), 1) for d in (1, 2, 4, 5, 7, 20)] + [day("B", D(7), 1)])
    split = splits.split_temporal(rows, Fold("f", D(1), D(4), D(6), D(7), min_history_days=2))
    assert split.train.count() == 3 and split.validation.count() == 2 and split.test.count() == 0 and split.train.columns == rows.columns
    assert split.excluded_out_of_range == 2 and sorted(r["dt"] for r in split.missing_dates.collect()) == [D(3), D(6)]
    assert {r["product_id"]: r["observed_days"] for r in split.insufficient_history.collect()} == {"B": 0}
    assert {r["product_id"]: len(r["dates"]) for r in split.missing_per_product.collect()} == {"A": 3, "B": 6}
    with pytest.raises(errors.InvalidBoundaryOrderError):
        splits.split_temporal(rows, Fold("f", D(1), D(4), D(4), D(7)))


def test_guards_find_planted_violations(rows):
    bad = [Fold("bad", D(1), D(10), D(11), D(13), D(9), D(14))]
    assert sorted((r["product_id"], r["dt"]) for r in evaluation.overlap(rows, bad, "test").collect()) == [("A", D(d)) for d in range(9, 14)]
    assert sorted((r["product_id"], r["dt"]) for r in evaluation.future_violations(rows, bad, "test").collect()) == [("A", D(d)) for d in range(9, 14)]
