"""Sums of doubles that don't depend on the order of rows.

A double is cut into whole-number digits to the base 2^30. Digits add up as whole numbers, without rounding, in any
order and in partial aggregates; only the few digit sums of a group are put together in floating point, with the
rounding errors carried along. So a sum is the same for any partitioning, and the nearest double but in rare ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 30
#: Digits from 2^-150 up to 2^120. Smaller parts are dropped; a group with larger values is summed as doubles.
DIGITS = range(-5, 4)
LARGE = 2.0 ** (BASE * (DIGITS[-1] + 1))


def total(array: Column) -> Column:
    """The sum of an array of doubles, with each step's rounding error carried along."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def add(a: Column, x: Column) -> Column:
        s = a["s"] + x
        back = s - a["s"]
        return F.struct(s.alias("s"), (a["e"] + ((a["s"] - (s - back)) + (x - back))).alias("e"))

    return F.aggregate(array, zero, add, lambda a: F.when(F.isnan(a["e"]), a["s"]).otherwise(a["s"] + a["e"]))


def digit_sums(value: Column, name: str) -> list[Column]:
    """Aggregates of a group from which finished() makes the sum of value; nulls don't count."""
    out = []
    for d in DIGITS:
        unit = 2.0 ** (BASE * d)
        # The remainder and the quotient by a power of two are exact.
        whole = (value % F.lit(unit * 2.0**BASE)) / F.lit(unit)
        out.append(F.sum(F.when(F.abs(value) < LARGE, whole).cast("long")).alias(f"{name}_d{d - DIGITS[0]}"))
    return [*out, F.count_if(~(F.abs(value) < LARGE)).alias(f"{name}_large"), F.sum(value).alias(f"{name}_plain")]


def finished(sums: DataFrame, *names: str) -> DataFrame:
    """sums with a column for each name, made of its digit_sums, which go; null for a group without values."""
    for name in names:
        digits = F.array(*[F.col(f"{name}_d{i}").cast("double") * F.lit(2.0 ** (BASE * d)) for i, d in enumerate(DIGITS)])
        made = F.when(F.col(f"{name}_large") > 0, F.col(f"{name}_plain")).when(F.col(f"{name}_plain").isNotNull(), total(digits))
        sums = sums.withColumn(name, made).drop(*[f"{name}_d{i}" for i in range(len(DIGITS))], f"{name}_large", f"{name}_plain")
    return sums
