"""Sums against exactly rounded ones, for any order and partitioning."""

import json
import math
import random
from datetime import date, timedelta

import pytest
from helpers import day, panel
from pyspark.sql import functions as F

from shelfcast.functions import exact
from shelfcast.operators.splits import Fold
from shelfcast.plans import evaluation

D = lambda d: date(2024, 1, d)


def groups():
    rng = random.Random(11)
    out = {
        "prices": [round(rng.uniform(-500, 500), 2) for _ in range(4000)],
        "tiny": [rng.uniform(0, 1e-9) for _ in range(500)],
        "mixed": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(3000)],
        "cancel": [x for i in range(500) for x in (1e15 + i, -1e15 - i, 0.1)],
        "one": [0.1],
        "zeros": [0.0, -0.0],
        "nulls": [None, None],
        "large": [1e300, 1e299, 3.0],
        "nan": [1.0, math.nan],
    }
    return [(k, x) for k, xs in out.items() for x in xs], {k: [x for x in xs if x is not None] for k, xs in out.items()}


def test_sums_are_exactly_rounded_and_independent_of_order(spark):
    rows, by = groups()
    seen = []
    for n, seed in ((1, 0), (3, 1), (7, 2)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, x double").repartition(n)
        got = {r["k"]: r["s"] for r in exact.finished(df.groupBy("k").agg(*exact.digit_sums(F.col("x"), "s")), "s").collect()}
        assert got["nulls"] is None and math.isnan(got["nan"]) and got["large"] == pytest.approx(1.1e300)
        seen.append({k: v for k, v in got.items() if k not in ("nan", "large")})
    assert seen[0] == seen[1] == seen[2]
    for k, v in seen[0].items():
        assert k == "nulls" or v == math.fsum(by[k]), k


def test_array_totals(spark):
    rng = random.Random(12)
    rows = [([rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 6) for _ in range(24)],) for _ in range(300)] + [([],), ([math.inf, 1.0],), ([0.1] * 10,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>").select(exact.total(F.col("a"))).collect()]
    assert got == [math.fsum(a) for (a,) in rows]


def test_report_is_the_same_for_any_partitioning(spark):
    rng = random.Random(13)
    rows = [day(f"P{p}", D(1) + timedelta(i), rng.lognormvariate(1, 2), i % 3) for p in range(60) for i in range(20)]
    folds = (Fold("fold-1", D(1), D(10), D(11), D(13), D(14), D(16)), Fold("fold-2", D(1), D(13), D(14), D(16), D(17), D(19)))
    config = evaluation.EvaluationConfig("e1", "s1", "test-rev", evaluation.SplitConfig(folds, "test"))
    made = {evaluation.run_baseline_evaluation(panel(spark, rows).repartition(n, "dt"), config).to_json() for n in (1, 3, 7)}
    assert len(made) == 1
    naive = json.loads(made.pop())["results"][0]
    last = {p: next(r[3] for r in rows if r[0] == p and r[2] == D(13)) for p in {r[0] for r in rows}}
    errors = [last[r[0]] - r[3] for r in rows if D(14) <= r[2] <= D(16)]
    assert naive["mae"] == math.fsum(map(abs, errors)) / len(errors) and naive["bias"] == math.fsum(errors) / len(errors)
    assert naive["rmse"] == math.sqrt(math.fsum(e * e for e in errors) / len(errors))
