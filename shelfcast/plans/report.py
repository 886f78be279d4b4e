"""Reader and validator of a frozen evaluation report, and the small tables that a viewer shows.

The tables are DataFrame operations over result rows: fold_rank, fold, model_rank, model and the measures, as
evaluation_grid gives them or as results_frame makes them from a report.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.errors import BenchmarkReportError
from shelfcast.operators.splits import Fold

COMPARED = ("mae", "rmse", "wmape")
TABLE = ("fold", "model", "mae", "rmse", "wmape", "bias", "coverage", "available", "requested", "evaluated", "stockout_rows")
RESULT_SCHEMA = "fold_rank int, fold string, model_rank int, model string, mae double, rmse double, wmape double, bias double, coverage double, available long, requested long, evaluated long, stockout_rows long"

# Keys of a report and the kinds of their values.
TOP = {
    **dict.fromkeys(("dataset", "dataset_revision", "evaluation_id", "evaluation_mode", "evaluation_partition", "evaluation_protocol_version", "fit_partition", "schema"), str),
    **dict.fromkeys(("baseline_parameters_fixed", "test_excluded_from_fit", "bounded_real_evaluation"), bool),
    **dict.fromkeys(("max_rows", "rows_loaded"), int),
    **dict.fromkeys(("models", "results", "limitations", "warnings", "fold_statuses"), list),
    **dict.fromkeys(("protocol", "coverage", "fold_derivation", "seasonal_naive_by_fold", "configuration"), dict),
}
PROTOCOL = {"evaluation_protocol_version": str, "evaluation_partition": str, "fit_partition": str, "test_excluded_from_fit": bool, "baseline_parameters_fixed": bool}
CONFIGURATION = {"dataset_revision": str, "evaluation_id": str, "models": list, "moving_average_window": int, "ses_alpha": float}
BOUNDS = tuple(f"{p}_{e}" for p in ("train", "validation", "test") for e in ("start", "end"))
FOLD = dict.fromkeys(("fold", *BOUNDS), str)
STATUS = FOLD | {"evaluable": bool, "evaluation_rows": int, "fit_history_start": str, "fit_history_end": str, "fit_partition": str, "fit_row_count": int, "test_excluded_from_fit": bool, "test_rows": int, "train_rows": int, "validation_rows": int, "evaluation_protocol_version": str}
RESULT = {"model": str, "fold": str, "mae": None, "rmse": None, "wmape": None, "coverage": float, "available": int, "requested": int, "evaluated": int, "stockout_rows": int, "fit_partition": str, "test_excluded_from_fit": bool}
COVERAGE = {"rows": int, "products": int, "date_min": str, "date_max": str, "calendar_span_days": int, "stockout_rows": int, "rows_with_any_observed_stockout_status": int}
SEASONAL = {"available": int, "requested": int, "coverage": float}


@dataclass(frozen=True)
class Contract:
    """What a report file must call itself."""

    schema: str
    evaluation_id: str

    @property
    def file_name(self) -> str:
        return f"{self.evaluation_id}.json"


def _need(fine: bool, message: str) -> None:
    if not fine:
        raise BenchmarkReportError(message)


def _fits(value: Any, kind: type | None) -> bool:
    if kind is None or kind is float:
        return (kind is None and value is None) or (isinstance(value, (int, float)) and not isinstance(value, bool))
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool))


def _shape(value: Any, keys: dict[str, type | None], where: str) -> None:
    _need(isinstance(value, dict), f"{where} must be an object")
    for k, kind in keys.items():
        _need(k in value, f"{where}.{k} is missing")
        _need(_fits(value[k], kind), f"{where}.{k} must be {kind.__name__ if kind else 'a number or null'}")


@dataclass(frozen=True)
class BenchmarkReport:
    """A report that passed all checks; results stand in order of folds, then models."""

    data: dict[str, Any]
    folds: tuple[dict[str, Any], ...]
    models: tuple[str, ...]
    results: tuple[dict[str, Any], ...]

    @classmethod
    def from_dict(cls, data: Any, contract: Contract) -> BenchmarkReport:
        """Fails closed: a wrong key, kind, name, bound or cell raises BenchmarkReportError."""
        _shape(data, TOP, "report")
        _need(data["schema"] == contract.schema, f"schema {data['schema']!r} is not supported")
        _need(data["evaluation_id"] == contract.evaluation_id, f"evaluation_id {data['evaluation_id']!r} is unexpected")
        models, results = data["models"], data["results"]
        _need(bool(models) and all(isinstance(m, str) for m in models), "report.models must be names, one or more")
        _need(len(set(models)) == len(models), "report.models repeats a name")
        _need(bool(results), "report.results must not be empty")
        protocol, made = data["protocol"], data["configuration"]
        _shape(protocol, PROTOCOL, "protocol")
        _shape(made, CONFIGURATION, "configuration")
        for k in PROTOCOL:
            _need(data[k] == protocol[k], f"{k} differs between report and protocol")
        for k in ("dataset_revision", "evaluation_id", "models"):
            _need(data[k] == made[k], f"{k} differs between report and configuration")
        folds = data["fold_derivation"].get("folds")
        _need(isinstance(folds, list) and bool(folds), "fold_derivation.folds must be a list that isn't empty")
        for f in folds:
            _shape(f, FOLD, "fold")
        names = [f["fold"] for f in folds]
        _need(len(set(names)) == len(names), "fold_derivation.folds repeats a fold")
        for s in data["fold_statuses"]:
            _shape(s, STATUS, "fold status")
        told = [s["fold"] for s in data["fold_statuses"]]
        _need(sorted(told) == sorted(names), "fold statuses and folds don't match one to one")
        status = {s["fold"]: s for s in data["fold_statuses"]}
        for f in folds:
            for k in BOUNDS:
                _need(f[k] == status[f["fold"]][k], f"{k} of {f['fold']} differs between derivation and status")
        for r in results:
            _shape(r, RESULT, "result")
        cells = [(r["fold"], r["model"]) for r in results]
        want = [(f, m) for f in names for m in models]
        _need(sorted(cells) == sorted(want), "results must hold each fold and model once")
        _shape(data["coverage"], COVERAGE, "coverage")
        seasonal = data["seasonal_naive_by_fold"]
        _need(sorted(seasonal) == sorted(names), "seasonal_naive_by_fold and folds don't match")
        for f, facts in seasonal.items():
            _shape(facts, SEASONAL, f"seasonal_naive_by_fold.{f}")
        by_cell = dict(zip(cells, results, strict=True))
        return cls(data, tuple(folds), tuple(models), tuple(by_cell[c] for c in want))


def load_report(path: str, contract: Contract) -> BenchmarkReport:
    """The report in a local file of the contract's name."""
    p = Path(path)
    _need(p.name == contract.file_name, f"{p.name} is not {contract.file_name}")
    try:
        data = json.loads(p.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise BenchmarkReportError(f"{path} can't be read: {e}") from e
    return BenchmarkReport.from_dict(data, contract)


def write_report(data: dict[str, Any], folder: str, contract: Contract) -> str:
    """Writes a report that passes all checks under the contract's name, byte for byte the same for the same data; its path."""
    BenchmarkReport.from_dict(data, contract)
    path = Path(folder) / contract.file_name
    path.write_text(json.dumps(data, sort_keys=True, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    return str(path)


def results_frame(spark: SparkSession, report: BenchmarkReport) -> DataFrame:
    names = [f["fold"] for f in report.folds]
    number = lambda v: None if v is None else float(v)
    rows = [(names.index(r["fold"]), r["fold"], report.models.index(r["model"]), r["model"], *(number(r.get(m)) for m in ("mae", "rmse", "wmape", "bias", "coverage")), *(int(r[c]) for c in ("available", "requested", "evaluated", "stockout_rows"))) for r in report.results]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def results_table(results: DataFrame, fold: str | None = None) -> DataFrame:
    """The flat table of one fold or of all; an unknown fold is an error."""
    if fold is not None:
        _need(bool(results.where(F.col("fold") == fold).limit(1).collect()), f"unknown fold {fold!r}")
        results = results.where(F.col("fold") == fold)
    return results.select(*TABLE)


def long_results(results: DataFrame) -> DataFrame:
    """One row for each fold, model and compared measure; absent values are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("metric_rank"), F.lit(m).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(COMPARED)]))
    return results.select("fold_rank", "fold", "model_rank", "model", cells.alias("c")).select("fold_rank", "fold", "model_rank", "model", "c.*").where("value is not null")


def smallest(results: DataFrame) -> DataFrame:
    """fold, metric, model, value of the least value; of equal ones the first model in report order."""
    best = F.min(F.struct("value", "model_rank", "model"))
    return long_results(results).groupBy("fold_rank", "fold", "metric_rank", "metric").agg(best.alias("b")).select("fold_rank", "fold", "metric_rank", "metric", "b.model", "b.value")


def universal_winner(results: DataFrame) -> DataFrame:
    """has_universal_winner: whether one model has the least value of every measure in every fold. Descriptive; nothing is selected."""
    cells = results.agg((F.count_distinct("fold") * len(COMPARED)).alias("cells"))
    wins = smallest(results).groupBy("model").agg(F.count(F.lit(1)).alias("wins")).agg(F.max("wins").alias("most"))
    return cells.join(F.broadcast(wins)).select(F.coalesce(F.col("most") == F.col("cells"), F.lit(False)).alias("has_universal_winner"))


def coverage_complete(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and(F.col("coverage") == 1.0), F.lit(False)).alias("coverage_complete"))


def comparison_data(results: DataFrame) -> DataFrame:
    """fold, fold_label, metric, model, value, formatted, is_min: chart rows with one minimum for each fold and measure."""
    order = Window.partitionBy("fold", "metric").orderBy("value", "model_rank")
    return long_results(results).select(
        "fold", F.format_string("Partition %d", F.col("fold_rank") + 1).alias("fold_label"), "metric", "model", "value", fixed("value", 3).alias("formatted"), (F.row_number().over(order) == 1).alias("is_min")
    )


def comparison_min_values(results: DataFrame) -> DataFrame:
    return smallest(results).select("fold", "metric", fixed("value", 3).alias("minimum"))


def bar_widths(results: DataFrame) -> DataFrame:
    """fold, metric, model, width: value as a share of the largest of its fold and measure."""
    top = F.max("value").over(Window.partitionBy("fold", "metric"))
    return long_results(results).select("fold", "metric", "model", F.coalesce(F.try_divide("value", top), F.lit(0.0)).alias("width"))


def conclusion_summary(results: DataFrame) -> DataFrame:
    """fold, then the least value and its model for each measure."""
    best = smallest(results)
    cells = [x for m in COMPARED for x in (F.max(F.when(F.col("metric") == m, F.col("model"))).alias(f"{m}_model"), F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_value"))]
    return best.groupBy("fold").agg(*cells)


def observations(results: DataFrame) -> DataFrame:
    """position, text: what the numbers say, measure by measure and fold by fold; a last line where no model is least everywhere."""
    best = smallest(results)
    lines = best.select(
        F.row_number().over(Window.orderBy("metric_rank", "fold_rank")).alias("position"),
        F.concat("model", F.lit(" has the smallest "), F.upper("metric"), F.lit(" in "), "fold", F.lit(" ("), fixed("value", 3), F.lit(").")).alias("text"),
    )
    last = universal_winner(results).where("not has_universal_winner").select(F.lit(1_000_000).alias("position"), F.lit("No single model has the smallest error for every metric in both folds.").alias("text"))
    return lines.union(last)


@dataclass(frozen=True)
class Wording:
    """Public texts in one language. Sentences are patterns of {fold}, {model}, {metric} and {value}, and of {models} and {last}."""

    fold: str
    models: dict[str, str]
    smallest: str
    evaluated: str
    no_winner: str


# The public names and sentences of the Spanish tables.
SPANISH = Wording(
    fold="Partición {}",
    models={"naive": "Último valor", "seasonal_naive": "Naive estacional", "moving_average": "Promedio móvil", "ses": "Suavizamiento exponencial"},
    smallest="En la {fold}, el {model} tiene el {metric} más bajo ({value}).",
    evaluated="Líneas base evaluadas: {models} y {last}.",
    no_winner="Ningún modelo individual tiene el error más bajo en todas las métricas de ambas particiones.",
)


def translated(texts: Sequence[str], words: dict[str, str]) -> list[str]:
    """The texts in another language; one without a translation is an error, so that nothing is shown as it stands."""
    missing = [t for t in texts if t not in words]
    _need(not missing, f"no translation for {missing}")
    return [words[t] for t in texts]


def _pattern(pattern: str, **values: Column) -> Column:
    """A sentence with its places filled."""
    out, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), values[name]]
    return F.concat(*out, F.lit(rest))


def localized_observations(results: DataFrame, words: Wording = SPANISH) -> DataFrame:
    """position, text: the observations in another language, with public names of folds and models. A model without a name is an error."""
    ranked = results.select("model_rank", "model").distinct().orderBy("model_rank").collect()
    names = translated([r["model"] for r in ranked], words.models)
    spark = results.sparkSession
    named = spark.createDataFrame([(r["model"], name.lower()) for r, name in zip(ranked, names, strict=True)], "model string, public string")
    text = _pattern(words.smallest, fold=F.format_string(words.fold.replace("{}", "%d"), F.col("fold_rank") + 1), model=F.col("public"), metric=F.upper("metric"), value=fixed("value", 3))
    lines = smallest(results).join(F.broadcast(named), "model").select((F.col("metric_rank") * 1000 + F.col("fold_rank")).cast("long").alias("position"), text.alias("text"))
    listed = [(1_000_000, words.evaluated.replace("{models}", ", ".join(names[:-1])).replace("{last}", names[-1]))] if names else []
    last = universal_winner(results).where("not has_universal_winner").select(F.lit(1_000_001).cast("long").alias("position"), F.lit(words.no_winner).alias("text"))
    return lines.union(spark.createDataFrame(listed, "position long, text string")).union(last)


def fold_labels(results: DataFrame, words: Wording = SPANISH) -> DataFrame:
    """fold, label: the public name of each fold, numbered in report order."""
    return results.select("fold_rank", "fold").distinct().select("fold", F.format_string(words.fold.replace("{}", "%d"), F.col("fold_rank") + 1).alias("label"))


def agreed_stockouts(results: DataFrame) -> dict[str, int]:
    """The stockout rows of each fold, on which all models must agree; else an error."""
    found = results.groupBy("fold_rank", "fold").agg(F.min("stockout_rows").alias("a"), F.max("stockout_rows").alias("z")).orderBy("fold_rank").collect()
    for r in found:
        _need(r["a"] == r["z"], f"models differ on the stockout rows of {r['fold']}: {r['a']} to {r['z']}")
    return {r["fold"]: r["a"] for r in found}


def stockout_summary(results: DataFrame, facts: dict[str, Any]) -> dict[str, Any]:
    """What the whole panel and each fold's test rows say of stockouts. facts: the coverage of a report."""
    return {k: facts[k] for k in ("stockout_rows", "rows_with_any_observed_stockout_status", "rows")} | {"test_rows_by_fold": agreed_stockouts(results)}


def stockout_facts(results: DataFrame) -> DataFrame:
    """fold, stockout_rows on which all models agree; null where they don't."""
    return results.groupBy("fold").agg(F.when(F.min("stockout_rows") == F.max("stockout_rows"), F.max("stockout_rows")).alias("stockout_rows"))


def seasonal_naive_by_fold(results: DataFrame) -> DataFrame:
    return results.where(F.col("model") == "seasonal_naive").select("fold", "available", "requested", "coverage", "wmape_status")


def fixed(column: str, places: int) -> Column:
    """Text with so many decimals, a dash where there is no value. The number's exact binary value is rounded, half to even.

    Splitting the number in two gives the product with the power of ten and its rounding error exactly, so a product
    that looks like a tie is told from a real one.
    """
    x, ten = F.abs(F.col(column)), float(10**places)
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    product = x * F.lit(ten)
    error = (high * F.lit(ten) - product) + (x - high) * F.lit(ten)
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    digits = F.format_string(f"%.{places}f", (whole + up.cast("long")) / F.lit(ten))
    return F.when(F.col(column).isNull(), "—").otherwise(F.concat(F.when(F.col(column) < 0, "-").otherwise(""), digits))


def protocol_segments(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    """fold, segment, days, width: parts of a fold as percent of its days, one decimal; the last takes the rest."""
    rows = [(str(f.fold), i, p, a, z) for f in folds for i, (p, a, z) in enumerate(f.ranges())]
    spans = spark.createDataFrame(rows, "fold string, i int, segment string, a date, z date").withColumn("days", F.datediff("z", "a") + 1)
    whole = Window.partitionBy("fold")
    share = F.bround(100.0 * F.col("days") / F.sum("days").over(whole), 1)
    part = spans.withColumn("share", share).withColumn("n", F.count(F.lit(1)).over(whole))
    before = F.coalesce(F.sum("share").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return part.select("fold", "segment", "days", F.when(F.col("i") == F.col("n") - 1, F.bround(100.0 - before, 1)).otherwise(F.col("share")).alias("width"))


def table_rows(results: DataFrame) -> DataFrame:
    """The results as display text."""
    thousands = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    return results.select(
        F.format_string("Partition %d", F.col("fold_rank") + 1).alias("partition"), "model", *[fixed(m, 3).alias(m) for m in ("mae", "rmse", "wmape", "bias")], fixed("coverage", 2).alias("coverage"),
        *[thousands(c).alias(c) for c in ("available", "requested", "evaluated", "stockout_rows")],
    )


def stockout_share(facts: DataFrame) -> DataFrame:
    return facts.select("rows", "stockout_rows", F.coalesce(F.try_divide(100.0 * F.col("stockout_rows"), F.col("rows")), F.lit(0.0)).alias("stockout_percent"))


def fold_rows(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    day = "fold string, " + ", ".join(f"{b} date" for b in BOUNDS)
    rows: list[tuple[str | date | None, ...]] = [(str(f.fold), *(getattr(f, b) for b in BOUNDS)) for f in folds]
    return spark.createDataFrame(rows, day)
