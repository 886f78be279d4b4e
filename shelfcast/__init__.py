"""Evaluation of retail demand forecasts on a daily panel, as Spark DataFrames.

Names are loaded when they are asked for, so that workers which need one module don't load all of them. Where other
engines have a class for each kind of row, the name here stands for the schema of the table that holds such rows.
"""

from __future__ import annotations

import importlib
from typing import Any

_PLACES = {
    "shelfcast.errors": ("BaselineError", "BenchmarkReportError", "DuplicateKeyError", "FreshRetailDomainError", "GlobalSnapshotError", "InvalidBoundaryOrderError", "RowValidationError", "SplittingError", "TargetNotInFutureError", "UnpinnedRevisionError"),
    "shelfcast.functions.rows": ("checked", "parse_daily_rows", "quarantine", "validate_revision"),
    "shelfcast.operators.baselines": ("BASELINES", "fit_baseline", "fit_moving_average", "fit_naive", "fit_seasonal_naive", "fit_ses", "register"),
    "shelfcast.operators.metrics": ("evaluate_metrics",),
    "shelfcast.operators.panel": ("SnapshotContext", "expand_to_hourly", "project_targets", "validate_global_snapshot", "validate_unique_and_sort"),
    "shelfcast.operators.splits": ("Fold", "TemporalSplit", "derive_folds", "expanding_window_folds", "split_temporal"),
    "shelfcast.plans.evaluation": ("BaselineConfig", "EvaluationConfig", "EvaluationReport", "SplitConfig", "benchmark_report", "evaluation_grid", "forecasts", "run_baseline_evaluation"),
    "shelfcast.plans.report": ("BenchmarkReport", "Contract", "load_report", "write_report"),
    "shelfcast.schema": ("EvaluationPartition", "ObservationState", "REASON_NO_HISTORY", "REASON_NO_SEASONAL_LAG", "WMAPE_CALCULABLE", "WMAPE_NO_EVALUABLE", "WMAPE_ZERO_ACTUALS"),
    "shelfcast.sources.daily": ("acquire", "read_raw", "stream_daily"),
    "shelfcast.streaming.ingest": ("ingest", "read_panel", "read_stream"),
}
_AS = {
    "BaselineEvaluationConfig": ("shelfcast.plans.evaluation", "BaselineConfig"),
    "BaselineForecastResult": ("shelfcast.schema", "FORECAST_ROW"),
    "EVALUATION_PARTITIONS": ("shelfcast.plans.evaluation", "PARTITIONS"),
    "EVALUATION_PARTITION_TEST": ("shelfcast.plans.evaluation", "TEST"),
    "EVALUATION_PARTITION_VALIDATION": ("shelfcast.plans.evaluation", "VALIDATION"),
    "EVALUATION_PROTOCOL_VERSION": ("shelfcast.schema", "PROTOCOL_VERSION"),
    "EvaluationProtocol": ("shelfcast.plans.evaluation", "PROTOCOL_KEYS"),
    "EvaluationResult": ("shelfcast.schema", "METRICS_ROW"),
    "EvaluationSplitConfig": ("shelfcast.plans.evaluation", "SplitConfig"),
    "ExpandingWindowFold": ("shelfcast.operators.splits", "Fold"),
    "FIT_PARTITION_TRAIN": ("shelfcast.schema", "FIT_TRAIN"),
    "FIT_PARTITION_TRAIN_PLUS_VALIDATION": ("shelfcast.schema", "FIT_TRAIN_AND_VALIDATION"),
    "FoldEvaluationConfig": ("shelfcast.operators.splits", "Fold"),
    "FoldEvaluationStatus": ("shelfcast.plans.report", "STATUS"),
    "ForecastMetrics": ("shelfcast.schema", "METRICS_ROW"),
    "ForecastRow": ("shelfcast.schema", "FORECAST_ROW"),
    "InsufficientHistory": ("shelfcast.schema", "HISTORY_ROW"),
    "MissingDatesForProduct": ("shelfcast.schema", "MISSING_ROW"),
    "REQUIRED_MODEL_ORDER": ("shelfcast.schema", "MODELS"),
    "TargetRow": ("shelfcast.schema", "TARGET_ROW"),
}
_FOUND = {name: (place, name) for place, names in _PLACES.items() for name in names} | _AS
__all__ = sorted(_FOUND)  # noqa: PLE0605


def __getattr__(name: str) -> Any:
    if name not in _FOUND:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    place, there = _FOUND[name]
    return getattr(importlib.import_module(place), there)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
