"""Temporal folds: literal day ranges over the panel, and reports on what they hold.

All folds are computed at once: a row carries an array of the (fold, part) pairs whose range holds its day, and one
explode makes a row for each. There is no range join and no scan for each fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schema
from shelfcast.errors import InvalidBoundaryOrderError, SplittingError

DAY = timedelta(days=1)


def require_count(value: object, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a whole number of 1 or more, not {value!r}")


@dataclass(frozen=True)
class Fold:
    """Inclusive day ranges of one fold. validation and test may be absent."""

    fold: str | int
    train_start: date
    train_end: date
    validation_start: date | None = None
    validation_end: date | None = None
    test_start: date | None = None
    test_end: date | None = None
    min_history_days: int = 1
    min_history_span_days: int = 1

    def __post_init__(self) -> None:
        if isinstance(self.fold, bool) or not isinstance(self.fold, (str, int)) or (isinstance(self.fold, str) and not self.fold.strip()):
            raise ValueError(f"a fold must be named by text or a whole number, not {self.fold!r}")
        if isinstance(self.fold, str):
            object.__setattr__(self, "fold", self.fold.strip())
        for part in schema.PARTS[1:]:
            if (getattr(self, f"{part}_start") is None) != (getattr(self, f"{part}_end") is None):
                raise ValueError(f"{part}_start and {part}_end must be given together")
        require_count(self.min_history_days, "min_history_days")
        require_count(self.min_history_span_days, "min_history_span_days")

    def bounds(self, part: str) -> tuple[date, date] | None:
        start, end = getattr(self, f"{part}_start"), getattr(self, f"{part}_end")
        return None if start is None else (start, end)

    def ranges(self) -> list[tuple[str, date, date]]:
        return [(p, *b) for p in schema.PARTS if (b := self.bounds(p))]

    def check_order(self) -> Fold:
        """Each range must end no earlier than it starts, and start after the range before it ends."""
        before = None
        for part, start, end in self.ranges():
            if end < start:
                raise InvalidBoundaryOrderError(f"{part} ends before it starts")
            if before and start <= before:
                raise InvalidBoundaryOrderError(f"{part} must start after {before}")
            before = end
        return self


def assign(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """panel rows by fold and part; a row stands once for each range that holds its day."""
    marks = [F.when(F.col("dt").between(F.lit(a), F.lit(z)), F.struct(F.lit(i).alias("fold_rank"), F.lit(str(f.fold)).alias("fold"), F.lit(p).alias("part"))) for i, f in enumerate(folds) for p, a, z in f.ranges()]
    if not marks:
        raise SplittingError("no folds")
    held = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return panel.select("*", F.explode(held).alias("_m")).select(*panel.columns, "_m.*")


def grid(spark, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([(i, str(f.fold)) for i, f in enumerate(folds)], "fold_rank int, fold string")


def row_counts(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows of each fold by part, and the rows that no part of it holds."""
    total = panel.agg(F.count(F.lit(1)).alias("total"))
    parts = assign(panel, folds).groupBy("fold").agg(*[F.count_if(F.col("part") == p).alias(f"{p}_rows") for p in schema.PARTS])
    held = grid(panel.sparkSession, folds).join(parts, "fold", "left").fillna(0)
    left = F.col("total") - sum((F.col(f"{p}_rows") for p in schema.PARTS), F.lit(0))
    return held.join(F.broadcast(total)).select("fold", *[f"{p}_rows" for p in schema.PARTS], left.alias("excluded_out_of_range"))


def missing_dates(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """fold, part, dt: days of a range on which no product has a row."""
    ranges = [(str(f.fold), p, a, z) for f in folds for p, a, z in f.ranges()]
    days = panel.sparkSession.createDataFrame(ranges, "fold string, part string, a date, z date").select("fold", "part", F.explode(F.sequence("a", "z")).alias("dt"))
    seen = assign(panel.select("dt").distinct(), folds).select("fold", "part", "dt")
    return days.join(seen, ["fold", "part", "dt"], "left_anti")


def missing_per_product(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """fold, product_id, dates: days from the fold's first to its last, gaps between its parts included, on which a product of the fold has no row inside any part."""
    span = {str(f.fold): (min(a for _, a, _ in f.ranges()), max(z for _, _, z in f.ranges())) for f in folds}
    calendar = F.coalesce(*[F.when(F.col("fold") == name, F.sequence(F.lit(a), F.lit(z))) for name, (a, z) in span.items()])
    seen = assign(panel, folds).groupBy("fold", "product_id").agg(F.collect_set("dt").alias("seen"))
    return seen.select("fold", "product_id", F.array_sort(F.array_except(calendar, "seen")).alias("dates"))


def _history(rows: DataFrame, counted: Column, folds: Sequence[Fold]) -> DataFrame:
    """Products of each fold whose counted rows are fewer, or span fewer days, than the fold asks for."""
    day = F.when(counted, F.col("dt"))
    by = rows.groupBy("fold", "product_id").agg(F.count(day).cast("int").alias("observed_days"), F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0)).alias("observed_span_days"))
    needs = [F.coalesce(*[F.when(F.col("fold") == str(f.fold), F.lit(getattr(f, name))) for f in folds]) for name in ("min_history_days", "min_history_span_days")]
    out = by.select("*", needs[0].alias("required_days"), needs[1].alias("required_span_days"))
    return out.where((F.col("observed_days") < F.col("required_days")) | (F.col("observed_span_days") < F.col("required_span_days")))


def insufficient_history(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Products with a row in any part whose training rows are too few."""
    return _history(assign(panel, folds), F.col("part") == "train", folds)


def fit_parts(partition: str) -> list[str]:
    """What a model may see: train for validation, train and validation for test."""
    return {"validation": ["train"], "test": ["train", "validation"]}[partition]


def insufficient_fit_history(panel: DataFrame, folds: Sequence[Fold], partition: str) -> DataFrame:
    """Products among the rows to fit or to evaluate whose rows to fit are too few."""
    fit = fit_parts(partition)
    rows = assign(panel, folds).where(F.col("part").isin(*fit, partition))
    return _history(rows, F.col("part").isin(*fit), folds)


def fit_bounds(panel: DataFrame, folds: Sequence[Fold], partition: str) -> DataFrame:
    """fold, fit_row_count, fit_history_start, fit_history_end; a fold without rows to fit has 0 and nulls."""
    rows = assign(panel, folds).where(F.col("part").isin(*fit_parts(partition))).groupBy("fold").agg(F.count(F.lit(1)).alias("fit_row_count"), F.min("dt").alias("fit_history_start"), F.max("dt").alias("fit_history_end"))
    return grid(panel.sparkSession, folds).join(rows, "fold", "left").select("fold", F.coalesce("fit_row_count", F.lit(0)).alias("fit_row_count"), "fit_history_start", "fit_history_end")


@dataclass(frozen=True)
class TemporalSplit:
    """One fold over a panel. rows: the panel's rows with fold and part; the reports are tables, worked out when asked for."""

    panel: DataFrame
    fold: Fold

    @property
    def rows(self) -> DataFrame:
        return assign(self.panel, [self.fold])

    def part(self, name: str) -> DataFrame:
        """The panel's rows of train, validation or test; none for a part that the fold doesn't have."""
        if name not in schema.PARTS:
            raise ValueError(f"part must be one of {schema.PARTS}, not {name!r}")
        return self.rows.where(F.col("part") == name).select(*self.panel.columns)

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def validation(self) -> DataFrame:
        return self.part("validation")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    @property
    def row_counts(self) -> DataFrame:
        return row_counts(self.panel, [self.fold])

    @property
    def missing_dates(self) -> DataFrame:
        return missing_dates(self.panel, [self.fold]).select("part", "dt")

    @property
    def missing_per_product(self) -> DataFrame:
        return missing_per_product(self.panel, [self.fold]).drop("fold")

    @property
    def insufficient_history(self) -> DataFrame:
        return insufficient_history(self.panel, [self.fold]).drop("fold")

    @property
    def excluded_out_of_range(self) -> int:
        return self.row_counts.first()["excluded_out_of_range"]


def split_temporal(panel: DataFrame, fold: Fold) -> TemporalSplit:
    """The split of a panel by one fold, its bounds checked and the rows to fit found to end before the rows to forecast."""
    fold.check_order()
    split = TemporalSplit(panel, fold)
    ends = split.rows.groupBy("part").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    before: date | None = None
    for _, first, last in sorted((schema.PARTS.index(r["part"]), r["first"], r["last"]) for r in ends.collect()):
        if before and first <= before:
            raise InvalidBoundaryOrderError(f"rows of {first} are not after those of {before}")
        before = last
    return split


def expanding_window_folds(*, start: date, initial_train_days: int, validation_days: int, folds: int, step_days: int, test_start: date | None = None, test_days: int | None = None, min_history_days: int = 1, min_history_span_days: int = 1) -> list[Fold]:
    """Training from start on, longer by step_days each fold, validation right after; one test range after the last validation, if asked for."""
    for name, value in (("initial_train_days", initial_train_days), ("validation_days", validation_days), ("folds", folds), ("step_days", step_days)):
        require_count(value, name)
    if (test_start is None) != (test_days is None):
        raise InvalidBoundaryOrderError("test_start and test_days must be given together")
    out = []
    for i in range(folds):
        train_end = start + DAY * (initial_train_days + i * step_days - 1)
        validation_end = train_end + DAY * validation_days
        out.append((i + 1, start, train_end, train_end + DAY, validation_end))
    if test_start is not None:
        require_count(test_days, "test_days")
        if test_start <= out[-1][4]:
            raise InvalidBoundaryOrderError("the test range must start after the last validation range")
    test = (None, None) if test_start is None else (test_start, test_start + DAY * (test_days - 1))
    return [Fold(*x, *test, min_history_days, min_history_span_days) for x in out]


def derive_folds(first: date, span_days: int, prefix: str = "fold") -> list[Fold]:
    """Two folds over a span (one, where two don't fit): validation and test of a tenth of it each, 1 to 7 days, the second fold after the first's test."""
    v = min(7, max(1, span_days // 10))
    step = 2 * v
    n = 2 if span_days - 2 * step >= 1 else 1
    initial = span_days - n * step
    if initial < 1:
        raise SplittingError(f"{span_days} days are too few")
    out = []
    for i in range(n):
        train_end = first + DAY * (initial + i * step - 1)
        out.append(Fold(f"{prefix}-{i + 1}", first, train_end, train_end + DAY, train_end + DAY * v, train_end + DAY * (v + 1), train_end + DAY * 2 * v))
    return out
