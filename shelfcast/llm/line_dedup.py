"""Deletes runs of lines that repeat an earlier run, found by winnowing over line hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shelfcast.llm.common import SPACE_WORD, cut, unused


@dataclass(frozen=True)
class LineDedup:
    """min_words: a run must have so many words to count as repeated. salts: parts that the rows of one fingerprint, or of one window, are dealt to."""

    min_words: int = 50
    salts: int = 64


def _sequences(docs: DataFrame) -> DataFrame:
    """One row for each distinct document (d: doc_id, t: hash of its text): its lines with a word, as (i: place among all lines, h and h2: hashes, n: words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("int").alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(SPACE_WORD)).cast("int").alias("n")))
    seq = F.filter(lines, lambda x: x["n"] > 0)
    found = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), seq.alias("seq"))
    return found.groupBy("d", "t").agg(F.first("seq").alias("seq"))


def _minima(sequences: DataFrame, how: LineDedup) -> DataFrame:
    """The fingerprints: d, t, p (place in seq), h, and wins, the windows (lo, hi: places in seq) of which the line is the least.

    A line's windows are the shortest runs with how.min_words words from it onwards and from it back. Only the line
    with the least hash of each is selected, so few lines are, and any two equal runs that long select a line alike.
    """
    w = how.min_words
    lines = sequences.select("d", "t", F.posexplode("seq").alias("k", "x")).select("d", "t", "k", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    doc = Window.partitionBy("d", "t")
    ends = lines.withColumn("end", F.sum("n").over(doc.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    starts = ends.withColumn("start", F.col("end") - F.col("n"))
    onwards, back = doc.orderBy("start").rangeBetween(0, w - 1), doc.orderBy("end").rangeBetween(-(w - 1), 0)

    def window(frame: WindowSpec) -> dict[str, Column]:
        return {"lo": F.min("k").over(frame), "hi": F.max("k").over(frame), "words": F.max("end").over(frame) - F.min("start").over(frame), "least": F.min(F.struct("h", F.col("k").alias("p"))).over(frame)}

    kinds = {f"{name}{i}": c for i, frame in enumerate((onwards, back)) for name, c in window(frame).items()}
    found = starts.select("d", "t", *[c.alias(name) for name, c in kinds.items()])
    each = F.array(*[F.struct(*[F.col(f"{name}{i}").alias(name) for name in ("lo", "hi", "words", "least")]) for i in range(2)])
    both = found.select("d", "t", F.explode(each).alias("w")).where(F.col("w.words") >= w)
    return both.groupBy("d", "t", F.col("w.least.p").alias("p"), F.col("w.least.h").alias("h")).agg(F.collect_set(F.struct("w.lo", "w.hi")).alias("wins"))


def _repeated(rows: DataFrame, keys: list[str], place: Column, how: LineDedup) -> DataFrame:
    """The rows whose keys stand at two places or more, with the first of these in the column first.

    Rows of one key are dealt to how.salts parts by their place. Parts are summed up apart, then by key, and the first
    place goes back to each part, so that a key of any number of rows is in no task as a whole.
    """
    salted = rows.withColumn("at", place).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(how.salts)))
    parts = salted.groupBy(*keys, "salt").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    whole = parts.groupBy(*keys).agg(F.min("a").alias("first"), F.max("z").alias("last")).where("not (first <=> last)").drop("last")
    return salted.join(parts.join(whole, keys).select(*keys, "salt", "first"), [*keys, "salt"]).drop("salt")


def repeats(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """For each document (d, t) with repeated runs: the sorted places from the first to the last line of each.

    1. Winnowing: the least line of each window is its fingerprint (_minima).
    2. Positions join: a fingerprint that is selected at one place alone can't belong to a repeat and goes, with its
       windows. Only what is left goes back to its document's lines.
    3. Extension: around a fingerprint that is left, a match reaches both ways as far as its windows agree, line by line:
       windows meet by the hash of all their lines, and all but the first in the order of (doc_id, text hash, line)
       are repeats. Each longest repeated run is the union of its windows: a line of it has min_words words from it
       onwards inside the run, or back, or lies in the window of the run's first line. So overlapping windows extend a
       match exactly as far as it goes, against whichever earlier place it goes furthest, without comparing any pair.
    """
    sequences = cut(_sequences(docs), "line_sequences")
    minima = cut(_minima(sequences, how), "line_minima")
    met = _repeated(minima, ["h"], F.struct("d", "t", "p"), how).select("d", "t", F.explode("wins").alias("win"))
    met = met.groupBy("d", "t").agg(F.collect_set("win").alias("wins")).alias("m")
    here = met.join(sequences.alias("s"), F.col("m.d").eqNullSafe(F.col("s.d")) & (F.col("m.t") == F.col("s.t"))).select("m.d", "m.t", "s.seq", F.explode("m.wins").alias("win"))
    lines = F.slice("seq", F.col("win.lo") + 1, F.col("win.hi") - F.col("win.lo") + 1)
    hashed = [F.xxhash64(F.transform(lines, lambda x: x["h"])).alias("g1"), F.xxhash64(F.transform(lines, lambda x: x["h2"])).alias("g2")]
    place = [F.get("seq", F.col(f"win.{e}"))["i"].alias(e) for e in ("lo", "hi")]
    windows = cut(here.select("d", "t", *place, *hashed), "line_windows")
    later = _repeated(windows, ["g1", "g2"], F.struct("d", "t", "lo"), how).where(~F.col("at").eqNullSafe(F.col("first")))
    spans = later.select("d", "t", F.sequence("lo", "hi").alias("s"))
    return spans.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("dead"))


def dedup(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """docs with repeated runs of lines taken out of text. Other columns and the number of rows stay.

    A line with a word is deleted if and only if it lies in a run of lines (those without a word don't count) that has
    how.min_words words or more and stands at an earlier place, too: in a document with a smaller doc_id (null first;
    for equal ids with a smaller text hash), or further up in the same document. Lines without a word stay. A null
    text stays null. A text whose lines all go becomes empty. Rows equal in doc_id and text are one document and get
    one result. Documents need doc_id and text; any other columns may have any names.
    """
    text = F.col("l.text").cast("string")
    (hashed,) = unused(docs, "t")
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("l")
    dead = repeats(docs, how).alias("r")
    joined = keyed.join(dead, F.col("l.doc_id").cast("long").eqNullSafe(F.col("r.d")) & (F.col(f"l.{hashed}") == F.col("r.t")), "left")
    kept = F.concat_ws("\n", F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("int").alias("i"))), lambda x: ~(F.array_contains("r.dead", x["i"]) & x["x"].rlike(SPACE_WORD)))["x"])
    new = F.when(F.col("r.dead").isNull() | text.isNull(), text).otherwise(kept)
    return joined.select(*[new.alias(c) if c == "text" else F.col(f"l.`{c}`") for c in docs.columns])


def report(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """doc_id and the text without its repeated runs, for every row."""
    return dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), how)


def oracle(how: LineDedup = LineDedup()) -> str:
    """DuckDB SQL for report() where doc_id is a key."""
    w, space = how.min_words, r"[^\x20\x09-\x0D]+"
    return f"""
    WITH l AS (SELECT doc_id d, i, string_split(text, chr(10))[i] x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY d ORDER BY i)::BIGINT e FROM (SELECT d, i, x, len(regexp_extract_all(x, '{space}')) n FROM l) WHERE n > 0),
    v AS (SELECT *, e - n b FROM s),
    f AS (SELECT d, list(i ORDER BY i) OVER f li, list(x ORDER BY i) OVER f lx, max(e) OVER f - min(b) OVER f n FROM v WINDOW f AS (PARTITION BY d ORDER BY b RANGE BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
    k AS (SELECT d, list(i ORDER BY i) OVER f li, list(x ORDER BY i) OVER f lx, max(e) OVER f - min(b) OVER f n FROM v WINDOW f AS (PARTITION BY d ORDER BY e RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)),
    u AS (SELECT d, li, lx, row_number() OVER (PARTITION BY lx ORDER BY d, li[1]) r FROM (SELECT DISTINCT d, li, lx FROM (SELECT * FROM f UNION ALL SELECT * FROM k) WHERE n >= {w})),
    dead AS (SELECT DISTINCT d, unnest(li) i FROM u WHERE r > 1),
    t AS (SELECT d, string_agg(x, chr(10) ORDER BY i) x FROM l ANTI JOIN dead USING (d, i) GROUP BY d)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(x, '') END AS text FROM documents LEFT JOIN t ON d = doc_id"""
