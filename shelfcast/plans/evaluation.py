"""Evaluation of the fixed models over folds: one distributed pass, then a small deterministic report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema
from shelfcast.errors import TargetNotInFutureError
from shelfcast.operators import baselines, metrics, panel, splits
from shelfcast.operators.splits import Fold
from shelfcast.plans.report import BenchmarkReport, Contract


VALIDATION, TEST = "validation", "test"
PARTITIONS = (VALIDATION, TEST)
PROTOCOL_KEYS = ("evaluation_protocol_version", "evaluation_partition", "fit_partition", "test_excluded_from_fit", "baseline_parameters_fixed")


def _text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be text that isn't blank, not {value!r}")
    return value.strip()


@dataclass(frozen=True)
class SplitConfig:
    """Folds in report order, and the part that is evaluated: validation or test."""

    folds: tuple[Fold, ...]
    partition: str = "validation"
    product_group: str = "all_products"

    def __post_init__(self) -> None:
        folds = tuple(self.folds)
        if not folds or not all(isinstance(f, Fold) for f in folds):
            raise ValueError("folds must be one Fold or more")
        names = [str(f.fold) for f in folds]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"folds that repeat: {twice}")
        if self.partition not in schema.PARTS[1:]:
            raise ValueError(f"partition must be validation or test, not {self.partition!r}")
        object.__setattr__(self, "folds", folds)
        object.__setattr__(self, "product_group", _text(self.product_group, "product_group"))


@dataclass(frozen=True)
class BaselineConfig:
    """Exactly the four models, in any order, with fixed parameters, and any registered models of one's own in extra."""

    models: tuple[str, ...] = schema.MODELS
    moving_average_window: int = schema.MOVING_AVERAGE_WINDOW
    ses_alpha: float = schema.SES_ALPHA
    extra: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if unknown := sorted(set(self.extra) - (set(baselines.BASELINES) - set(schema.MODELS))):
            raise ValueError(f"models that aren't registered: {unknown}")
        given = list(self.models)
        if unknown := sorted({str(m) for m in given} - set(schema.MODELS)):
            raise ValueError(f"unknown models: {unknown}")
        if twice := sorted({m for m in given if given.count(m) > 1}):
            raise ValueError(f"models that repeat: {twice}")
        if missing := [m for m in schema.MODELS if m not in given]:
            raise ValueError(f"missing models: {missing}")
        object.__setattr__(self, "models", (*schema.MODELS, *self.extra))
        baselines.check_params(self.moving_average_window, self.ses_alpha)


@dataclass(frozen=True)
class EvaluationConfig:
    evaluation_id: str
    source_id: str
    dataset_revision: str
    splits: SplitConfig
    baselines: BaselineConfig = field(default_factory=BaselineConfig)

    def __post_init__(self) -> None:
        for name in ("evaluation_id", "source_id", "dataset_revision"):
            object.__setattr__(self, name, _text(getattr(self, name), name))
        if not isinstance(self.splits, SplitConfig) or not isinstance(self.baselines, BaselineConfig):
            raise TypeError("splits and baselines must be SplitConfig and BaselineConfig")

    @property
    def fit_partition(self) -> str:
        return "+".join(splits.fit_parts(self.splits.partition))

    def to_dict(self) -> dict[str, Any]:
        return {
            "evaluation_id": self.evaluation_id, "source_id": self.source_id, "dataset_revision": self.dataset_revision, "evaluation_partition": self.splits.partition, "product_group": self.splits.product_group,
            "models": list(self.baselines.models), "moving_average_window": self.baselines.moving_average_window, "ses_alpha": self.baselines.ses_alpha,
            "folds": [_bounds(f) | {"min_history_days": f.min_history_days, "min_history_span_days": f.min_history_span_days} for f in self.splits.folds],
        }


def _day(value: date | None) -> str | None:
    return value.isoformat() if value else None


def _bounds(f: Fold) -> dict[str, Any]:
    return {"fold": f.fold} | {f"{p}_{e}": _day(getattr(f, f"{p}_{e}")) for p in schema.PARTS for e in ("start", "end")}


def forecasts(rows: DataFrame, folds: Sequence[Fold], partition: str, how: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Forecasts of all models for the evaluated part of all folds, fitted on the parts before it and on nothing else."""
    held = splits.assign(rows, folds).where(F.col("part").isin(*splits.fit_parts(partition), partition))
    censored = panel.state(F.exists("hours_stock_status", lambda x: x == 1)) if "hours_stock_status" in rows.columns else F.lit(None).cast("string")
    revision = F.col("revision") if "revision" in rows.columns else F.lit(None).cast("string")
    role = F.when(F.col("part") == partition, "target").otherwise("fit")
    named = held.select("fold_rank", "fold", "product_id", "dt", F.col("sale_amount").alias(schema.TARGET), "stockout_hours_6_22", censored.alias("observation_state"), revision.alias("revision"), role.alias("role"))
    return baselines.forecast(named, window=how.moving_average_window, alpha=how.ses_alpha, models={m: baselines.BASELINES[m] for m in how.models}, keys=("fold_rank", "fold", "product_id"))


def evaluation_grid(rows: DataFrame, folds: Sequence[Fold], partition: str, how: BaselineConfig = BaselineConfig()) -> DataFrame:
    """One row for each fold and model, in their order of rank: all measures."""
    by = ["fold_rank", "fold", "model_rank", "model"]
    cells = [(i, str(f.fold), j, m) for i, f in enumerate(folds) for j, m in enumerate(how.models)]
    grid = rows.sparkSession.createDataFrame(cells, "fold_rank int, fold string, model_rank int, model string")
    return metrics.on_grid(metrics.evaluate_metrics(forecasts(rows, folds, partition, how), by), grid, by)


def overlap(rows: DataFrame, folds: Sequence[Fold], partition: str) -> DataFrame:
    """fold, product_id, dt of keys that stand both among the rows to fit and the rows to evaluate."""
    held = splits.assign(rows, folds).select("fold", "product_id", "dt", "part")
    return held.where(F.col("part").isin(*splits.fit_parts(partition))).drop("part").intersect(held.where(F.col("part") == partition).drop("part"))


def future_violations(rows: DataFrame, folds: Sequence[Fold], partition: str) -> DataFrame:
    """fold, product_id, dt of evaluated rows on or before the last fitted day of their product."""
    held = splits.assign(rows, folds)
    last = held.where(F.col("part").isin(*splits.fit_parts(partition))).groupBy("fold", "product_id").agg(F.max("dt").alias("last_dt"))
    return held.where(F.col("part") == partition).join(last, ["fold", "product_id"]).where("dt <= last_dt").select("fold", "product_id", "dt")


def coverage_facts(rows: DataFrame) -> DataFrame:
    """One row on the whole panel: rows, products, first and last day, span, stockout rows, rows with any stockout hour, days without any product."""
    days = F.array_except(F.sequence(F.min("dt"), F.max("dt")), F.collect_set("dt"))
    out = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("products"), F.min("dt").alias("date_min"), F.max("dt").alias("date_max"),
        (F.datediff(F.max("dt"), F.min("dt")) + 1).alias("calendar_span_days"), F.count_if(F.col("stockout_hours_6_22") > 0).alias("stockout_rows"),
        F.count_if(F.exists("hours_stock_status", lambda x: x == 1)).alias("rows_with_any_observed_stockout_status"), F.array_sort(days).alias("missing_dates"),
    )
    return out


def missing_dates_by_product(rows: DataFrame) -> DataFrame:
    """product_id, dates: days of the whole panel's span without a row of the product."""
    span = rows.agg(F.sequence(F.min("dt"), F.max("dt")).alias("days"))
    return rows.groupBy("product_id").agg(F.collect_set("dt").alias("seen")).join(F.broadcast(span)).select("product_id", F.array_sort(F.array_except("days", "seen")).alias("dates"))


#: Reports by product, as tables, and the columns that their entries show.
HISTORY = ("product_id", "observed_days", "observed_span_days", "required_days", "required_span_days")


@dataclass(frozen=True)
class EvaluationReport:
    """Measures and statuses by fold, which are few, and tables by product (missing_per_product, insufficient_history, insufficient_fit_history), which stay distributed until to_dict asks for them."""

    config: EvaluationConfig
    protocol: dict[str, Any]
    results: tuple[dict[str, Any], ...]
    fold_statuses: tuple[dict[str, Any], ...]
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def _listed(self, name: str) -> dict[str, list[dict[str, Any]]]:
        out: dict[str, list] = {s["fold"]: [] for s in self.fold_statuses}
        for r in self.tables[name].orderBy("fold", *panel.product_order()).collect():
            entry = {"product_id": r["product_id"], "dates": [_day(d) for d in r["dates"]]} if name == "missing_per_product" else {k: r[k] for k in HISTORY}
            out[r["fold"]].append(entry)
        return out

    def to_dict(self, products: bool = True) -> dict[str, Any]:
        """With products, each fold lists its products; only then do these come to the driver."""
        statuses, results = [dict(s) for s in self.fold_statuses], [dict(r) for r in self.results]
        if products and self.tables:
            listed = {name: self._listed(name) for name in self.tables}
            for s in statuses:
                s.update({name: found[s["fold"]] for name, found in listed.items()})
            for r in results:
                r["insufficient_fit_history"] = listed["insufficient_fit_history"][r["fold"]]
        return {"config": self.config.to_dict(), "protocol": self.protocol, "results": results, "fold_statuses": statuses}

    def to_json(self, products: bool = True) -> str:
        return json.dumps(self.to_dict(products), sort_keys=True)


def run_baseline_evaluation(rows: DataFrame, config: EvaluationConfig) -> EvaluationReport:
    """Checks keys, revision and folds in this order, then evaluates.

    rows is read once: the columns that count, without the hourly vectors, are kept while the report is made. Only
    counts, dates of folds and measures come to the driver.
    """
    flag = F.exists("hours_stock_status", lambda x: x == 1) if "hours_stock_status" in rows.columns else F.lit(None).cast("boolean")
    kept = [c for c in ("product_id", "product_is_int", "dt", "sale_amount", "stockout_hours_6_22", "revision") if c in rows.columns]
    slim = rows.select(*kept, F.when(flag.isNotNull(), F.array(flag.cast("int"))).alias("hours_stock_status"))
    held = slim.persist()
    try:
        return _report(held, slim, config)
    finally:
        held.unpersist()


def _report(rows: DataFrame, source: DataFrame, config: EvaluationConfig) -> EvaluationReport:
    panel.require_unique(rows)
    found = panel.revisions(rows)
    if len(found) > 1 or (found and found[0] != config.dataset_revision):
        raise ValueError(f"revisions {found} in the panel, not {config.dataset_revision!r}")
    folds, part = [f.check_order() for f in config.splits.folds], config.splits.partition
    if part == "test":
        if (bad := overlap(rows, folds, part).limit(5).collect()) or (bad := future_violations(rows, folds, part).limit(5).collect()):
            raise TargetNotInFutureError(f"evaluated rows that are not after the fitted ones: {bad}")

    def by_fold(df: DataFrame, order: str | None = None) -> dict[str, list]:
        out: dict[str, list] = {str(f.fold): [] for f in folds}
        for r in df.orderBy(order).collect() if order else df.collect():
            out[r["fold"]].append(r)
        return out

    ids = source.select("product_id", "product_is_int").distinct()
    tables = {"missing_per_product": splits.missing_per_product(source, folds), "insufficient_history": splits.insufficient_history(source, folds), "insufficient_fit_history": splits.insufficient_fit_history(source, folds, part)}
    tables = {name: t.join(ids, "product_id") for name, t in tables.items()}
    counts, bounds = by_fold(splits.row_counts(rows, folds)), by_fold(splits.fit_bounds(rows, folds, part))
    missing = by_fold(splits.missing_dates(rows, folds), "dt")
    envelope = {"evaluation_protocol_version": schema.PROTOCOL_VERSION, "fit_partition": config.fit_partition, "test_excluded_from_fit": True}
    statuses, fits = [], {}
    for f in folds:
        name = str(f.fold)
        n, b = counts[name][0], bounds[name][0]
        fits[name] = {"fit_row_count": b["fit_row_count"], "fit_history_start": _day(b["fit_history_start"]), "fit_history_end": _day(b["fit_history_end"])}
        statuses.append(
            _bounds(f) | {"fold": name} | envelope | fits[name] | {f"{p}_rows": n[f"{p}_rows"] for p in schema.PARTS} | {f"missing_{p}_dates": [_day(r["dt"]) for r in missing[name] if r["part"] == p] for p in schema.PARTS}
            | {"evaluation_rows": n[f"{part}_rows"], "evaluable": n[f"{part}_rows"] > 0, "excluded_out_of_range": n["excluded_out_of_range"]}
        )
    by_name = {str(f.fold): f for f in folds}
    results = []
    for r in evaluation_grid(rows, folds, part, config.baselines).orderBy("fold_rank", "model_rank").collect():
        results.append(
            _bounds(by_name[r["fold"]]) | {"fold": r["fold"]} | envelope | fits[r["fold"]] | {k: r[k] for k in metrics.MEASURES}
            | {"model": r["model"], "evaluation_id": config.evaluation_id, "source_id": config.source_id, "dataset_revision": config.dataset_revision, "evaluation_partition": part, "product_group": config.splits.product_group, "target": schema.TARGET, "configuration": config.to_dict()}
        )
    protocol = envelope | {"evaluation_partition": part, "baseline_parameters_fixed": True}
    return EvaluationReport(config, protocol, tuple(results), tuple(statuses), tables)


def benchmark_report(rows: DataFrame, config: EvaluationConfig, contract: Contract, *, dataset: str, mode: str, max_rows: int, rule: str = "", limitations: Sequence[str] = (), warnings: Sequence[str] = ()) -> dict[str, Any]:
    """A whole report as load_report reads it: the evaluation, the coverage of the panel, the folds and how they were derived (rule), and the seasonal model by fold."""
    made = run_baseline_evaluation(rows, config)
    whole = made.to_dict(products=False)
    facts = coverage_facts(rows).first().asDict()
    coverage = {k: v.isoformat() if isinstance(v, date) else v for k, v in facts.items() if k != "missing_dates"} | {"missing_dates": [_day(d) for d in facts["missing_dates"] or []]}
    data = whole["protocol"] | {
        "schema": contract.schema, "evaluation_id": config.evaluation_id, "dataset": dataset, "dataset_revision": config.dataset_revision, "evaluation_mode": mode, "bounded_real_evaluation": mode == "bounded",
        "max_rows": max_rows, "rows_loaded": facts["rows"], "models": list(config.baselines.models), "results": whole["results"], "fold_statuses": whole["fold_statuses"], "protocol": whole["protocol"],
        "coverage": coverage, "fold_derivation": {"rule": rule, "folds": [_bounds(f) | {"fold": str(f.fold)} for f in config.splits.folds]},
        "seasonal_naive_by_fold": {r["fold"]: {k: r[k] for k in ("available", "requested", "coverage", "wmape_status")} for r in whole["results"] if r["model"] == "seasonal_naive"},
        "configuration": whole["config"], "limitations": list(limitations), "warnings": list(warnings),
    }
    BenchmarkReport.from_dict(data, contract)
    return data
