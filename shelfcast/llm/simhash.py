"""SimHash fingerprints and their exact near neighbours by tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import cut, plus, ship, spread_join, unused
from shelfcast.llm.graph import components

#: Four 16-bit parts of a fingerprint. A bit that differs changes the population count of one part by one, so
#: fingerprints within the radius have part counts within it, too, summed over the parts.
PARTS = np.array([0xFFFF << s for s in (48, 32, 16, 0)], dtype=np.uint64)


@dataclass(frozen=True)
class SimHash:
    """tile: fingerprints of a tile. strip: fingerprints of a strip inside a tile. block: neighbouring tiles that a task compares with as many others, at most."""

    shingle: int = 3
    seed: int = 42
    radius: int = 3
    tile: int = 16384
    strip: int = 128
    block: int = 8


def hashes(text: str, how: SimHash) -> list[int]:
    """XXH64 of each shingle: words of the text, A to Z in lower case, as UTF-8 with one space between."""
    import xxhash

    digest, seed, k = xxhash.xxh64_intdigest, how.seed, how.shingle
    words = text.encode().lower().split()  # bytes: A to Z alone change, and ASCII white space alone splits
    if len(words) <= k:
        return [digest(b" ".join(words), seed)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(flat[a:z], seed) for a, z in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprints(texts: Iterator[str], how: SimHash, block: int = 200_000) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; a text without words has 0. Long texts are counted in blocks."""
    out, pending, sizes = [], [], []

    def flush() -> None:
        if not sizes:
            return
        bits = np.unpackbits(np.array(pending, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = [i for i, n in enumerate(sizes) if n]
        votes = np.zeros((len(sizes), 64), dtype=np.int64)
        if full:
            at = np.concatenate(([0], np.cumsum([sizes[i] for i in full])[:-1]))
            votes[full] = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        set_ = 2 * votes > np.array(sizes)[:, None]
        out.append(np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel())
        pending.clear()
        sizes.clear()

    for text in texts:
        hs = hashes(text, how)
        if len(hs) > block:  # its votes are summed up block by block
            flush()
            votes = np.zeros(64, dtype=np.int64)
            for i in range(0, len(hs), block):
                part = np.array(hs[i : i + block], dtype="<u8").view(np.uint8).reshape(-1, 8)
                votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(np.packbits(2 * votes > len(hs), bitorder="little").view("<u8"))
            continue
        pending += hs
        sizes.append(len(hs))
        if len(pending) >= block:
            flush()
    flush()
    return np.concatenate(out).astype(np.uint64) if out else np.zeros(0, dtype=np.uint64)


def with_fingerprint(docs: DataFrame, name: str, how: SimHash = SimHash()) -> DataFrame:
    """docs with their fingerprints as a signed long in the column name. A null text counts as empty."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints((x.as_py() or "" for x in batch.column(at)), how)
            yield batch.append_column(name, pa.array(fp.view(np.int64)))

    return docs.mapInArrow(run, plus(docs, name, T.LongType()))


def part_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] & PARTS[None, :]).astype(np.int16)


def _boxes(fp: np.ndarray, strip: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(fp), strip)
    counts = part_counts(fp)
    return np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars around the least node of each component: fewer links, the same components."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def near_pairs(left: np.ndarray, right: np.ndarray, same: bool, how: SimHash, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of two tiles within the radius, by exclusive-or and bit counts; strips whose population counts lie too far apart are skipped."""
    (llo, lhi), (rlo, rhi) = _boxes(left, how.strip), _boxes(right, how.strip)
    us, vs, held = [], [], 0
    for i in range(len(llo)):
        gap = np.maximum(0, np.maximum(rlo - lhi[i], llo[i] - rhi)).sum(axis=1)
        if same:
            gap[:i] = how.radius + 1
        near = np.flatnonzero(gap <= how.radius)
        if not len(near):
            continue
        a = left[i * how.strip : (i + 1) * how.strip]
        at = (near[:, None] * how.strip + np.arange(how.strip)[None, :]).ravel()
        at = at[at < len(right)]
        for part in np.array_split(at, max(1, len(at) // 8192)):
            b = right[part]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= how.radius)
            if len(x):
                us.append(a[x])
                vs.append(b[y])
                held += len(x)
        if held >= most:
            u, v = _stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    apart = u != v
    return _stars(u[apart], v[apart])


def links(distinct: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """u, v: links between the distinct fingerprints (column fp) that connect exactly what pairs within the radius connect."""
    spark = distinct.sparkSession
    ship(spark)
    parts = [f"bit_count(shiftrightunsigned(fp, {s}) & 65535)" for s in (48, 32, 16, 0)]
    keyed = distinct.selectExpr("fp", *[f"{e} as p{i}" for i, e in enumerate(parts)])
    n_tiles = max(1, -(-keyed.count() // how.tile))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 20
        rest = np.zeros(0, np.uint64)

        def out(fp: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            at += 1
            counts = part_counts(fp)
            low, high = counts.min(axis=0).tolist(), counts.max(axis=0).tolist()
            return pa.record_batch([pa.array([at - 1]), pa.array([low], pa.list_(pa.int32())), pa.array([high], pa.list_(pa.int32())), pa.array([fp.astype("<u8").tobytes()], pa.binary())], names=["tile", "low", "high", "fps"])

        for batch in batches:
            rest = np.concatenate((rest, batch.column(0).to_numpy().view(np.uint64)))
            while len(rest) >= 2 * how.tile:
                yield out(rest[: how.tile])
                rest = rest[how.tile :]
        for part in np.array_split(rest, max(1, round(len(rest) / how.tile))):
            if len(part):
                yield out(part)

    order = ["p0", "p1", "p2", "p3", "fp"]
    made = keyed.repartitionByRange(n_tiles, *order).sortWithinPartitions(*order).select("fp").mapInArrow(tiles, "tile long, low array<int>, high array<int>, fps binary")
    made = cut(made, "tiles")
    # Numbers travel first. Pairs of tiles are compared by blocks of neighbouring tiles, so that a tile comes once to each block.
    block = max(1, min(how.block, n_tiles // 32))
    number = lambda c: F.shiftright(c, 20).cast("long") - F.pmod(F.shiftright(c, 20), F.lit(block))
    pairs = cut(tile_pairs(made, how.radius).select("a", "b", number("a").alias("ga"), number("b").alias("gb")), "tile_pairs")
    needed = pairs.select("ga", "gb", F.explode(F.array("a", "b")).alias("tile")).distinct().join(made.select("tile", "fps"), "tile")
    listed = pairs.groupBy(F.col("ga").alias("la"), F.col("gb").alias("lb")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))

    def compare(keys: tuple, held: pa.Table, todo: pa.Table) -> pa.Table:
        fps = {t: np.frombuffer(x.as_buffer(), dtype="<u8").astype(np.uint64) for t, x in zip(held.column("tile").to_pylist(), held.column("fps"), strict=True)}
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for pair in todo.column("pairs").to_pylist()[0]:
            u, v = near_pairs(fps[pair["a"]], fps[pair["b"]], pair["a"] == pair["b"], how)
            us.append(u)
            vs.append(v)
        u, v = _stars(np.concatenate(us), np.concatenate(vs))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    both = needed.groupBy("ga", "gb").cogroup(listed.groupBy("la", "lb"))
    return both.applyInArrow(compare, "u long, v long")


def tile_pairs(made: DataFrame, radius: int) -> DataFrame:
    """a, b: the pairs of tiles (a <= b, each with itself) whose population counts leave room for fingerprints within the radius.

    A range join on the counts of the first two parts: tiles meet in the cells of count by count that they cover, one of
    them widened by the radius, and a pair is kept in the first cell that they share.
    """
    span = lambda i, wide: F.explode(F.sequence(F.get("low", F.lit(i)) - wide, F.get("high", F.lit(i)) + wide))

    def cells(name: str, wide: int) -> DataFrame:
        out = made.select(F.col("tile").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"), "low", "high").withColumn("c0", span(0, wide)).withColumn("c1", span(1, wide))
        return out.drop("low", "high")

    gap = F.lit(0)
    for i in range(len(PARTS)):
        low_a, high_a, low_b, high_b = (F.get(c, F.lit(i)) for c in ("low_a", "high_a", "low_b", "high_b"))
        gap = gap + F.greatest(F.lit(0), low_b - high_a, low_a - high_b)
    first = F.lit(True)
    for i in range(2):
        first = first & (F.col(f"c{i}") == F.greatest(F.get("low_a", F.lit(i)) - radius, F.get("low_b", F.lit(i))))
    return cells("a", radius).join(cells("b", 0), ["c0", "c1"]).where((F.col("a") <= F.col("b")) & first & (gap <= radius)).select("a", "b")


def groups(fps: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """fp, root (least fingerprint of the component) and component_id (its least doc_id) for each distinct fingerprint of fps (doc_id, fp)."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, how))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Fingerprints link at how.radius or fewer differing bits; component_id is the least doc_id that links reach. Equal
    fingerprints are compared once. Texts without words, null or not, have fingerprint zero and link like any other.
    A null doc_id is never the least unless all of its component are null. Equal rows each get their row; an empty
    table gives none. Other columns of docs are ignored.
    """
    fps = cut(with_fingerprint(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "fp", how).select("doc_id", "fp"), "docs_fp")
    out = spread_join(fps, groups(fps, how), "fp", F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """docs with one row of each component: that with the least doc_id (null last), of these that with the least text hash, of equal rows one."""
    fp, row = unused(docs, "fp", "row")
    keyed = with_fingerprint(docs.withColumn("text", F.col("text").cast("string")), fp, how).withColumn(row, F.monotonically_increasing_id())
    held = cut(keyed, "docs_fp")
    fps = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"), F.xxhash64("text").alias("t"))
    rooted = spread_join(fps, groups(fps, how).select("fp", "root"), "fp", F.col("row"))
    keep = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "row")).alias("k")).select(F.col("k.row").alias(row))
    return held.join(keep, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
