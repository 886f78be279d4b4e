import random

import pytest
from llm_fixtures import PARAGRAPH, TEXTS, dedup_lines, docs, dup_lines, empty, repeat_words, space_words
from pyspark.sql import functions as F

from shelfcast.llm import line_dedup, quality_rules


def test_line_dedup_edges(spark):
    df = docs(spark)
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and out.count() == len(TEXTS)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["text"])
    assert got[8] == {f"intro line eight\n{PARAGRAPH}\nafter"} and got[9] == {"intro line nine\n\nother"}
    assert got[2] == {None} and got[3] == {""} and got[4] == {" \n\t \n "} and None in got[None]
    assert got[12] == {t for i, t in TEXTS if i == 12}  # under the least number of words: stays
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_rows_of_one_document_get_one_result(spark):
    twice = [(1, PARAGRAPH), (1, PARAGRAPH), (2, PARAGRAPH), (2, PARAGRAPH), (None, PARAGRAPH)]
    got = sorted(line_dedup.report(spark.createDataFrame(twice, "doc_id long, text string")).collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, PARAGRAPH), (1, ""), (1, ""), (2, ""), (2, "")]


def test_line_dedup_against_every_run(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdef") + str(rng.randrange(4)) for _ in range(rng.choice([1, 4, 9, 30, 55]))) for _ in range(14)] + ["", " "]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    start = pool[3:8]
    texts += [(100 + i, "\n".join([f"own {i}", *start[: 2 + i % 4], f"end {i}"])) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in texts] == dedup_lines(texts)


def test_rules_report(spark):
    got = quality_rules.report(docs(spark)).collect()
    want = []
    for i, text in TEXTS:
        words = space_words(text)
        rep = repeat_words(words)
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup_lines(text), rep, len(words) < 10 or 100 * rep > 20 * len(words)))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"]}
    assert kept[1] and kept[13] and kept[7] and not kept[2] and not kept[14] and not kept[15] and not kept[16]
    assert quality_rules.report(empty(spark)).count() == 0


def test_random_repeats_and_lines(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "\x0b", "\x1c", "é"]) for _ in range(rng.randrange(0, 200)))) for i in range(80)]
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"], r["n_words"]) for r in quality_rules.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: (repeat_words(space_words(t)), dup_lines(t), len(space_words(t))) for i, t in texts}


def test_cascade_order_changes_no_verdict(spark):
    df = docs(spark)
    how = quality_rules.Rules()
    given = quality_rules.rules(how)
    order = quality_rules.ordered(df, given, how)
    assert sorted(r.name for r in order) == sorted(r.name for r in given)
    verdicts = [sorted((r[0] or -1, r[1]) for r in df.select("doc_id", quality_rules.with_statistics(quality_rules.first_failed(x), how).isNull()).collect()) for x in (given, order, given[::-1])]
    assert verdicts[0] == verdicts[1] == verdicts[2]
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(v for _, v in verdicts[0]) == quality_rules.cascade(df).where(F.col("failed_rule").isNull()).count()
    assert quality_rules.keep(empty(spark)).count() == 0


def test_cascade_order_saves_evaluations(spark):
    """A dear rule that rejects little is tried last, and only on what the others leave."""
    rows = [(i, f"{'word ' * 30}text {i}" if i % 4 else "#### ####") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    how = quality_rules.Rules()
    slow = quality_rules.Rule("slow", lambda x: F.length(F.regexp_replace(F.repeat(x.text, 2000), "o+r", "")) < 5)
    given = [slow, *[r for r in quality_rules.rules(how) if r.name in ("symbols", "word_length")]]
    found = {e.rule.name: e for e in quality_rules.estimated(df, given, how)}
    assert found["slow"].cost > found["symbols"].cost and found["symbols"].rejected == 0.25 and found["slow"].rejected == 0
    order = quality_rules.ordered(df, given, how)
    assert order[-1].name == "slow"
    # A rule that isn't reached isn't evaluated: this one would raise.
    touchy = quality_rules.Rule("touchy", lambda x: F.when(x.n < 10, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.lit(False)))
    few = quality_rules.rules(how)[0]
    assert df.select(quality_rules.with_statistics(quality_rules.first_failed([few, touchy]), how).alias("f")).where("f is null").count() == 300
    with pytest.raises(Exception, match="evaluated"):
        df.select(quality_rules.with_statistics(quality_rules.first_failed([touchy, few]), how).alias("f")).collect()
    reached = {}
    for name, x in (("given", given), ("ordered", order)):
        failed = [r[0] for r in df.select(quality_rules.with_statistics(quality_rules.first_failed(x), how)).collect()]
        names = [r.name for r in x]
        reached[name] = {n: sum(f is None or names.index(f) >= names.index(n) for f in failed) for n in names}
    assert reached["given"]["slow"] == 400 and reached["ordered"]["slow"] == 300


@pytest.mark.parametrize("name", ["op1", "op5"])
def test_main_path_is_native(spark, name):
    df = line_dedup.report(docs(spark)) if name == "op1" else quality_rules.report(docs(spark))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
