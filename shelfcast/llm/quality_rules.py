"""Quality rules as a short-circuit cascade: the rule that rejects most per cost is tried first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import SPACE_WORD, cut

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """sample_rows: rows from which cost and selectivity are estimated, about; they only set the order of the rules, never a verdict. tries: how often each rule is timed on them."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.5
    max_mean_word: float = 20.0
    min_mean_word: float = 1.5
    max_shout_share: float = 0.2
    sample_rows: int = 2000
    tries: int = 2


class Lazy:
    """A text's statistics, each an expression of its own that runs only where a rule asks for it. n, the words' count, which most rules need, is given."""

    def __init__(self, text: Column, n: Column, how: Rules):
        self.text, self.n, self.how = text, n, how

    def chars(self) -> Column:
        return F.length(F.translate(self.text, " \t\n\x0b\x0c\r", "")).cast("long")

    def symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(SYMBOLS)).cast("long")

    def shouts(self) -> Column:
        return F.regexp_count(self.text, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")).cast("long")

    def lines(self) -> Column:
        return F.regexp_count(self.text, F.lit("\n")) + 1

    def dup_lines(self) -> Column:
        return _dup_lines(self.text)

    def repeats(self) -> Column:
        return _let(_words(self.text), lambda w: _repeat_words(w, self.how.window))


class Known(Lazy):
    """Statistics of which some are at hand already: the fields of known."""

    def __init__(self, text: Column, known: Column, how: Rules):
        super().__init__(text, known["n_words"], how)
        self.known = known

    def chars(self) -> Column:
        return self.known["word_chars"]

    def symbols(self) -> Column:
        return self.known["n_symbols"]

    def dup_lines(self) -> Column:
        return self.known["n_dup_lines"]

    def repeats(self) -> Column:
        return self.known["n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """rejects: whether the rule rejects a text, from its statistics; those that it asks for are worked out inside it."""

    name: str
    rejects: Callable[[Lazy], Column]


@dataclass(frozen=True)
class Estimate:
    """What a sample says of a rule: seconds for its rows, and the share of them that it rejects."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def rate(self) -> float:
        return self.rejected / self.cost


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))


def _dup_lines(text: Column) -> Column:
    return _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _repeat_words(words: Column, k: int) -> Column:
    """How many words lie in a k-word window that is found twice or more.

    Windows are compared by a 64-bit hash of their words. Most texts repeat none, which the distinct count shows;
    for the rest, windows sorted by hash show their places, and places sorted show how many words they cover.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - k)
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(p, i + 1)["h"]).eqNullSafe(True))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def cover(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.least(F.lit(k), x - F.coalesce(F.get(at, i - 1), x - k)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return _let(_let(pairs, places), cover)

    counted = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(n > k, counted).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_statistics(body: Callable[[Lazy], Column], how: Rules) -> Column:
    """body of the statistics of the column text. The whole is one expression, so a filter on it can be pushed through projections without doing the work again for each use."""
    given = F.struct(_text().alias("text"), F.regexp_count(_text(), F.lit(SPACE_WORD)).cast("long").alias("n"))
    return _let(given, lambda x: body(Lazy(x["text"], x["n"], how)))


def rules(how: Rules) -> list[Rule]:
    return [
        Rule("few_words", lambda x: x.n < how.min_words),
        Rule("symbols", lambda x: x.symbols() > how.max_symbols_per_word * x.n),
        Rule("shouting", lambda x: x.shouts() > how.max_shout_share * x.n),
        Rule("word_length", lambda x: _let(x.chars(), lambda c: (c > how.max_mean_word * x.n) | (c < how.min_mean_word * x.n))),
        Rule("dup_lines", lambda x: x.dup_lines() > how.max_dup_line_share * x.lines()),
        Rule("repeats", lambda x: 100 * x.repeats() > how.max_repeat_percent * x.n),
    ]


def estimated(docs: DataFrame, given: list[Rule], how: Rules, seed: int = 42) -> list[Estimate]:
    """Cost and selectivity of each rule on a seeded sample: each rule runs on it alone, and the time that the sample takes without a rule is taken off. None for an empty sample."""
    total = docs.count()
    if not total:
        return []
    sample = cut(docs.select(_text().alias("text")).sample(min(1.0, how.sample_rows / total), seed), "rules_sample")

    def timed(test: Callable[[Lazy], Column]) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(max(1, how.tries)):
            began = time.perf_counter()
            share = sample.select(with_statistics(test, how).alias("r")).agg(F.avg(F.col("r").cast("double"))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, share or 0.0

    timed(lambda x: x.n < 0)  # compiles
    idle, _ = timed(lambda x: x.n < 0)
    out = []
    for r in given:
        spent, share = timed(r.rejects)
        out.append(Estimate(r, max(spent - idle, 1e-4), share))
    return out


def ordered(docs: DataFrame, given: list[Rule], how: Rules, seed: int = 42) -> list[Rule]:
    """The rules by rejections per cost on a sample, most first; of equal ones the cheaper first. As given for an empty sample."""
    found = estimated(docs, given, how, seed)
    return [e.rule for e in sorted(found, key=lambda e: (-e.rate, e.cost))] or given


def first_failed(given: list[Rule]) -> Callable[[Lazy], Column]:
    """The name of the first rule that rejects, else null. A rule runs only where all before it pass."""

    def tried(x: Lazy) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(given):
            out = F.when(r.rejects(x), F.lit(r.name)).otherwise(out)
        return out

    return tried


def cascade(docs: DataFrame, how: Rules = Rules()) -> DataFrame:
    """docs with the column failed_rule: the first rule of the cascade that rejects the text, null for a text that passes all.

    A null text counts as empty and fails for its few words. Equal texts get equal verdicts. The verdict, null or not,
    doesn't depend on the order of the rules; the order, for which the rules are timed, only saves work and says which
    of several failures is named. Other columns stay; a column failed_rule is replaced.
    """
    return docs.withColumn("failed_rule", with_statistics(first_failed(ordered(docs, rules(how), how)), how))


def keep(docs: DataFrame, how: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass all rules, with the columns of docs."""
    return docs.where(with_statistics(first_failed(ordered(docs, rules(how), how)), how).isNull())


def report(docs: DataFrame, how: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for every row of docs.

    The base counts are reported for every text, so they are worked out once and the cascade's rules read them; only
    what a rule needs beyond them is worked out lazily, and only where the base counts leave the verdict open.
    """
    order = ordered(docs, [r for r in rules(how) if r.name not in ("few_words", "repeats")], how)

    def base(w: Column) -> Column:
        x = Lazy(_text(), F.size(w).cast("long"), how)
        return F.struct(x.n.alias("n_words"), x.chars().alias("word_chars"), x.symbols().alias("n_symbols"), x.dup_lines().alias("n_dup_lines"), _repeat_words(w, how.window).alias("n_repeat_words"))

    def out(b: Column) -> Column:
        failed = (b["n_words"] < how.min_words) | (100 * b["n_repeat_words"] > how.max_repeat_percent * b["n_words"])
        kept = F.when(failed, F.lit(False)).otherwise(first_failed(order)(Known(_text(), b, how)).isNull())
        return F.struct(*[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), kept.alias("kept"))

    found = _let(_let(_words(_text()), base), out)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.array(found)))


def oracle(how: Rules = Rules()) -> str:
    """DuckDB SQL for report()."""
    space = r"[^\x20\x09-\x0D]+"
    k = how.window
    return f"""
    WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{space}') w, string_split(coalesce(text, ''), chr(10)) l FROM documents),
    g AS (SELECT r, i, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') g FROM (SELECT r, w, unnest(range(1, len(w) - {k} + 2)) i FROM d WHERE len(w) >= {k})),
    p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) c FROM g) WHERE c > 1),
    rep AS (SELECT r, sum(least({k}, coalesce(i - before, {k}))) n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) before FROM p) GROUP BY r),
    s AS (SELECT doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
        len(list_filter(l, lambda x: regexp_matches(x, '{space}'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '{space}')))) n_dup_lines,
        coalesce(n, 0) n_repeat_words, len(l) n_lines,
        len(list_filter(w, lambda x: x LIKE '%!!')) n_shouts
      FROM d LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < {how.min_words} OR 100 * n_repeat_words > {how.max_repeat_percent} * n_words base_failed FROM s)
    SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words, base_failed,
      NOT base_failed AND NOT (n_symbols > {how.max_symbols_per_word} * n_words OR n_shouts > {how.max_shout_share} * n_words
        OR word_chars > {how.max_mean_word} * n_words OR word_chars < {how.min_mean_word} * n_words OR n_dup_lines > {how.max_dup_line_share} * n_lines) kept
    FROM b"""
