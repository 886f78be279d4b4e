"""A factorisation machine that scores texts for quality.

Inputs are hashed words, statistics of the text's structure in ranges, and declared metadata (the character count).
With x the inputs, a score is sigmoid(b + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j). The pair sum needs no
pairs: for each factor it is half of (sum v_i x_i) squared less sum of (v_i x_i) squared.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import plus, ship, unused

#: Upper ends of the ranges of each statistic, the last range being open.
RANGES = {
    "symbols": (0.0, 0.02, 0.1, 0.3, 0.6, 1.2, 2.0),
    "shouts": (0.0, 0.02, 0.1, 0.3, 0.6),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "digits": (0.0, 0.01, 0.05, 0.2),
    "ends": (0.02, 0.05, 0.1, 0.2, 0.4),
    "mean_word": (2.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "doubled": (0.0, 0.02, 0.05, 0.15, 0.3),
    "repeated": (0.0, 0.05, 0.1, 0.2, 0.4, 0.7),
    "dup_lines": (0.0, 0.1, 0.25, 0.4, 0.6, 0.8),
    "words": (0.0, 4.0, 9.0, 30.0, 100.0, 300.0, 1000.0, 5000.0),
    "declared": (0.0, 50.0, 200.0, 1000.0, 5000.0, 20000.0),
    "declared_off": (0.0, 0.05, 0.5),
}
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Machine:
    """most_labelled: labelled rows that training reads at most, chosen by a seeded hash of their ids; nothing else is sampled."""

    hash_bits: int = 16
    factors: int = 8
    most_labelled: int = 6000
    epochs: int = 10
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 42
    threshold: float = 0.7
    held_out_of: int = 4
    held_out: int = 2


STAT_AT = np.concatenate(([0], np.cumsum([len(x) + 1 for x in RANGES.values()])))
N_STATS = int(STAT_AT[-1])
EDGES = [np.array(x) for x in RANGES.values()]


def statistics(text: str, words: list[bytes], distinct: int, declared: int | None) -> list[float]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = list(zip(words, words[1:], words[2:], strict=False))
    return [
        len(SYMBOLS.findall(text)) / n,
        text.count("!!") / n,
        len(UPPER.findall(text)) / chars,
        len(DIGITS.findall(text)) / chars,
        (text.count(".") + text.count("?") + text.count("!")) / n,
        sum(map(len, words)) / n,
        distinct / n,
        doubled / n,
        1 - len(set(pairs)) / max(1, len(pairs)) if pairs else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(len(words)),
        float(declared if declared is not None else -1),
        abs((declared if declared is not None else len(text)) - len(text)) / chars,
    ]


def features(text: str, declared: int | None, how: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words (hashed, by count, to length 1), then one index for each statistic's range."""
    words = text.encode().lower().split()
    mask, crc = (1 << how.hash_bits) - 1, zlib.crc32
    hashed = np.fromiter((crc(w) & mask for w in words), dtype=np.int64, count=len(words))
    at, counts = np.unique(hashed, return_counts=True)
    value = counts / np.sqrt(np.square(counts, dtype=np.float64).sum()) if len(at) else counts.astype(np.float64)
    stats = statistics(text, words, len(set(words)), declared)
    ranges = [int(STAT_AT[i]) + int(np.searchsorted(EDGES[i], x)) for i, x in enumerate(stats)]
    return np.concatenate((at, np.array(ranges) + mask + 1)).astype(np.int32), np.concatenate((value, np.ones(len(ranges)))).astype(np.float32)


@dataclass
class Weights:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(np.square(vx), starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[idx] * val, starts) + 0.5 * (np.square(total) - squares).sum(axis=1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        idx, val = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1]))
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val.astype(np.float64), starts), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, how: Machine) -> Weights:
    """Logistic loss, Adam in small batches. Without both labels among the rows the bias alone decides."""
    size = (1 << how.hash_bits) + N_STATS
    rng = np.random.default_rng(how.seed)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    w = Weights(float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.01, (size, how.factors)))
    if len(set(labels.tolist())) < 2:
        return Weights(w.bias, w.linear, np.zeros_like(w.factors))
    first, second = np.zeros((size, how.factors + 1)), np.zeros((size, how.factors + 1))
    step = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), how.batch):
            pick = order[a : a + how.batch]
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            error = (1 / (1 + np.exp(-np.clip(w.raw(idx, val, starts), -30, 30))) - labels[pick]) / len(pick)
            vx = w.factors[idx] * val[:, None]
            total = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
            each = np.repeat(error, sizes) * val
            slope = np.concatenate((each[:, None], each[:, None] * (total - vx)), axis=1)
            used, flat = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(flat, weights=slope[:, j], minlength=len(used)) for j in range(how.factors + 1)], axis=1)
            now = np.concatenate((w.linear[used, None], w.factors[used]), axis=1)
            grad += how.decay * now
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.999 * second[used] + 0.001 * np.square(grad)
            now -= how.rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
            w.linear[used], w.factors[used] = now[:, 0], now[:, 1:]
            w.bias -= how.rate * float(error.sum())
    return w


def held_out(doc_id: Column, how: Machine) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % how.held_out_of == how.held_out, F.lit(False))


def _inputs(docs: DataFrame) -> list[Column]:
    declared = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").cast("string").alias("text"), declared.alias("declared")]


def fit(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> Weights:
    """Trains on labelled rows that aren't held out. At most how.most_labelled of them, by a seeded hash of doc_id, come to the driver, as features."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), how))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(how.seed), "doc_id"), "doc_id").limit(how.most_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "declared")).alias("x")).select("doc_id", "quality", "x.*")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py() or "", d.as_py(), how) for t, d in zip(batch.column("text"), batch.column("declared"), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), *(pa.array([g[i].tobytes() for g in got], pa.binary()) for i in (0, 1))], names=["doc_id", "quality", "idx", "val"])

    table = rows.mapInArrow(extract, "doc_id long, quality int, idx binary, val binary").collect()
    table.sort(key=lambda r: r["doc_id"])
    return train([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in table], np.array([float(r["quality"] == 1) for r in table]), how)


def with_score(docs: DataFrame, weights: Weights, name: str, how: Machine = Machine()) -> DataFrame:
    """docs with their scores in the column name. A null text counts as empty."""
    ship(docs.sparkSession)
    read = docs.select("*", *[c.alias(x) for x, c in zip(unused(docs, "text_in", "declared_in"), _inputs(docs), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, declared = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            parts = []
            for a in range(0, batch.num_rows, 64):
                parts.append(weights.score([features(texts[i].as_py() or "", declared[i], how) for i in range(a, min(a + 64, batch.num_rows))]))
            out = batch.select(list(range(batch.num_columns - 2)))
            yield out.append_column(name, pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    return read.mapInArrow(run, plus(docs, name, T.DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from how.threshold on) for every row of docs.

    labels needs doc_id and quality (1 good, 0 bad); null labels and null ids don't teach, and of several labels of
    one id the least holds. Labels, language, source and id are never inputs. A null doc_id isn't held out. Empty and
    null texts are scored by their statistics. Equal texts with equal metadata get equal scores. Without labels of
    both kinds all scores are the labels' share of ones (kept from 0.01 to 0.99), or 0.5. Other columns of docs are ignored.
    """
    weights = fit(docs, labels, how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    out = with_score(rows, weights, "score", how)
    return out.select("doc_id", held_out(F.col("doc_id"), how).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> DataFrame:
    """The rows of docs that score how.threshold or more, with the columns of docs."""
    (score,) = unused(docs, "score")
    return with_score(docs, fit(docs, labels, how), score, how).where(F.col(score) >= how.threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
