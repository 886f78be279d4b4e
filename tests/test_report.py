import copy
import json
from datetime import date

import pytest
from helpers import evaluation_rows, panel
from pyspark.sql import functions as F

import shelfcast
from shelfcast.errors import BenchmarkReportError
from shelfcast.operators.splits import Fold, derive_folds
from shelfcast.plans import evaluation, report

CONTRACT = report.Contract("evaluation/v1", "bounded-v2")
MODELS = ["naive", "seasonal_naive", "moving_average", "ses"]
VALUES = {"fold-1": [(0.574, 0.918, 0.581), (0.586, 0.935, 0.593), (0.557, 0.819, 0.564), (0.538, 0.771, 0.545)], "fold-2": [(0.610, 0.874, 0.570), (0.518, 0.749, 0.484), (0.481, 0.645, 0.449), (0.515, 0.662, 0.481)]}


def frozen():
    folds = [{"fold": f.fold} | {b: getattr(f, b).isoformat() for b in report.BOUNDS} for f in derive_folds(date(2024, 3, 28), 90)]
    protocol = {"evaluation_protocol_version": "baseline-evaluation-v2", "evaluation_partition": "test", "fit_partition": "train+validation", "test_excluded_from_fit": True, "baseline_parameters_fixed": True}
    status = {"evaluable": True, "evaluation_rows": 77, "fit_history_start": "2024-03-28", "fit_history_end": "2024-06-04", "fit_partition": "train+validation", "fit_row_count": 769, "test_excluded_from_fit": True, "test_rows": 77, "train_rows": 692, "validation_rows": 77, "evaluation_protocol_version": "baseline-evaluation-v2"}
    results = [{"model": m, "fold": f, "mae": v[0], "rmse": v[1], "wmape": v[2], "bias": 0.0, "coverage": 1.0, "available": 77, "requested": 77, "evaluated": 77, "stockout_rows": 34, "fit_partition": "train+validation", "test_excluded_from_fit": True} for f in VALUES for m, v in zip(MODELS, VALUES[f], strict=True)]
    return protocol | {
        "dataset": "d", "dataset_revision": "r", "evaluation_id": "bounded-v2", "evaluation_mode": "bounded", "schema": "evaluation/v1", "bounded_real_evaluation": True, "max_rows": 1000, "rows_loaded": 1000, "models": MODELS, "results": results[::-1], "limitations": [], "warnings": [],
        "fold_statuses": [f | status for f in folds], "protocol": protocol, "coverage": {"rows": 1000, "products": 12, "date_min": "2024-03-28", "date_max": "2024-06-25", "calendar_span_days": 90, "stockout_rows": 593, "rows_with_any_observed_stockout_status": 708},
        "fold_derivation": {"folds": folds}, "seasonal_naive_by_fold": {f["fold"]: {"available": 77, "requested": 77, "coverage": 1.0} for f in folds}, "configuration": {"dataset_revision": "r", "evaluation_id": "bounded-v2", "models": MODELS, "moving_average_window": 7, "ses_alpha": 0.3},
    }


def test_load(tmp_path):
    path = tmp_path / "bounded-v2.json"
    path.write_text(json.dumps(frozen()))
    got = report.load_report(str(path), CONTRACT)
    assert [(r["fold"], r["model"]) for r in got.results[:2]] == [("fold-1", "naive"), ("fold-1", "seasonal_naive")]
    for name, text in (("other.json", "{}"), ("bounded-v2.json", "{"), ("bounded-v2.json", "[]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(BenchmarkReportError):
            report.load_report(str(tmp_path / name), CONTRACT)
    with pytest.raises(BenchmarkReportError):
        report.load_report(str(tmp_path / "none" / "bounded-v2.json"), CONTRACT)


def _set(data, path, value):
    for k in path[:-1]:
        data = data[k]
    if value is KeyError:
        del data[path[-1]]
    else:
        data[path[-1]] = value


@pytest.mark.parametrize(
    ("path", "value"),
    [(("schema",), "x"), (("evaluation_id",), "x"), (("models",), []), (("results",), []), (("max_rows",), True), (("protocol", "fit_partition"), "train"), (("configuration", "models"), ["naive"]), (("configuration", "dataset_revision"), "x"), (("configuration", "ses_alpha"), "x"),
     (("fold_derivation", "folds"), []), (("fold_derivation", "folds", 0, "test_end"), "2024-01-01"), (("fold_statuses", 0, "fold"), "fold-2"), (("results", 0, "model"), "naive"), (("results", 0, "fold"), "fold-9"), (("results", 0, "mae"), "x"), (("coverage", "rows"), KeyError), (("seasonal_naive_by_fold",), {})],
)
def test_fails_closed(path, value):
    data = copy.deepcopy(frozen())
    _set(data, path, value)
    with pytest.raises(BenchmarkReportError):
        report.BenchmarkReport.from_dict(data, CONTRACT)


def test_tables(spark):
    data = frozen()
    data["results"][0]["rmse"] = None  # ses of fold-2
    rows = report.results_frame(spark, report.BenchmarkReport.from_dict(data, CONTRACT))
    best = {(r["fold"], r["metric"]): (r["model"], r["value"]) for r in report.smallest(rows).collect()}
    assert best[("fold-1", "mae")] == ("ses", 0.538) and best[("fold-2", "rmse")] == ("moving_average", 0.645)
    assert not report.universal_winner(rows).first()[0] and report.coverage_complete(rows).first()[0]
    texts = [r["text"] for r in report.observations(rows).orderBy("position").collect()]
    assert texts[0] == "ses has the smallest MAE in fold-1 (0.538)." and len(texts) == 7 and texts[-1].startswith("No single model")
    chart = report.comparison_data(rows).collect()
    assert len(chart) == 23 and sum(r["is_min"] for r in chart) == 6
    assert report.results_table(rows, "fold-1").count() == 4
    with pytest.raises(BenchmarkReportError):
        report.results_table(rows, "fold-9")
    assert {r["fold"]: r["stockout_rows"] for r in report.stockout_facts(rows).collect()} == {"fold-1": 34, "fold-2": 34}
    shown = report.table_rows(rows).where("partition = 'Partition 2' and model = 'ses'").first()
    assert shown["rmse"] == "—" and shown["mae"] == "0.515" and shown["requested"] == "77"


def test_ties_go_to_the_first_model(spark):
    rows = spark.createDataFrame([(0, "f", i, m, 1.0, 1.0, 1.0, 0.0, 1.0, 1, 1, 1, 0) for i, m in enumerate(MODELS)], report.RESULT_SCHEMA)
    assert {r["model"] for r in report.smallest(rows).collect()} == {"naive"} and report.universal_winner(rows).first()[0]


def test_segments_sum_to_100(spark):
    got = report.protocol_segments(spark, derive_folds(date(2024, 3, 28), 90)).collect()
    for fold in ("fold-1", "fold-2"):
        assert sum(r["width"] for r in got if r["fold"] == fold) == pytest.approx(100)


def test_fixed_rounds_the_binary_value(spark):
    values = [0.825, 0.125, 0.375, 2.675, 1.005, -0.0001, 0.5745, 1234.5675, 0.0, -17.1235, 1e-9, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", report.fixed("v", 2).alias("a"), report.fixed("v", 3).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("—", "—") if v is None else (f"{v:.2f}", f"{v:.3f}") for v in values]


def test_an_evaluation_can_be_written_and_loaded(spark, tmp_path):
    rows = panel(spark, evaluation_rows())
    d = lambda x: date(2024, 1, x)
    folds = (Fold("fold-1", d(1), d(10), d(11), d(13), d(14), d(16)), Fold("fold-2", d(1), d(13), d(14), d(16), d(17), d(19)))
    config = evaluation.EvaluationConfig("bounded-v2", "s", "test-rev", evaluation.SplitConfig(folds, "test"))
    data = evaluation.benchmark_report(rows, config, CONTRACT, dataset="d", mode="bounded", max_rows=1000, rule="as given", limitations=["short"])
    path = report.write_report(data, str(tmp_path), CONTRACT)
    got = report.load_report(path, CONTRACT)
    assert got.data == json.loads(json.dumps(data)) and len(got.results) == 8 and got.data["coverage"]["rows"] == 26 and got.data["rows_loaded"] == 26
    assert got.data["seasonal_naive_by_fold"]["fold-2"]["available"] == 3
    table = report.results_frame(spark, got)
    assert report.stockout_summary(table.where("model = 'naive'"), got.data["coverage"])["test_rows_by_fold"] == {"fold-1": 1, "fold-2": 2}
    with pytest.raises(BenchmarkReportError, match="differ"):
        report.agreed_stockouts(table)  # the seasonal model sees fewer rows of fold-2
    again = evaluation.benchmark_report(rows.repartition(5), config, CONTRACT, dataset="d", mode="bounded", max_rows=1000, rule="as given", limitations=["short"])
    assert again == data


def test_texts_in_another_language(spark):
    rows = report.results_frame(spark, report.BenchmarkReport.from_dict(frozen(), CONTRACT))
    texts = [r["text"] for r in report.localized_observations(rows).orderBy("position").collect()]
    assert texts[0] == "En la Partición 1, el suavizamiento exponencial tiene el MAE más bajo (0.538)." and len(texts) == 8
    assert texts[6] == "Líneas base evaluadas: Último valor, Naive estacional, Promedio móvil y Suavizamiento exponencial." and texts[7].startswith("Ningún modelo")
    assert {r["fold"]: r["label"] for r in report.fold_labels(rows).collect()} == {"fold-1": "Partición 1", "fold-2": "Partición 2"}
    assert report.translated(["a"], {"a": "b"}) == ["b"]
    with pytest.raises(BenchmarkReportError, match="no translation"):
        report.translated(["a", "c"], {"a": "b"})
    with pytest.raises(BenchmarkReportError):
        report.localized_observations(rows.withColumn("model", F.lit("other")))


def test_public_names():
    for name in shelfcast.__all__:
        assert getattr(shelfcast, name) is not None, name
    assert {"run_baseline_evaluation", "split_temporal", "TargetRow", "REQUIRED_MODEL_ORDER", "EvaluationSplitConfig"} <= set(shelfcast.__all__)
    with pytest.raises(AttributeError):
        shelfcast.nothing  # noqa: B018
