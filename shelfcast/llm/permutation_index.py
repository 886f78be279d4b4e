"""Approximate nearest neighbours by permutation index: vectors as orders of their nearest pivots, posted in pivot inverted files."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import cut, drop, ship

PLACED = "vec_id long, v array<double>, near binary"
INDEX = "block long, ids binary, vectors binary, starts binary, heads binary, posted binary, places binary"
ROUTED = "block long, chunk long, query_id long, v array<double>, near binary"
FOUND = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """pivots: a sample of so many distinct vectors, by a seeded hash; only it and its spares come to the driver.
    prefix: nearest pivots that stand for a vector; asks: those of them whose lists a query reads. alike: vectors of a block with this cosine to a common one are a crowd,
    which is posted once. share: part of a block's crowds, nearest by footrule distance, that is reranked with all their
    members, at least. tested: queries that are compared with all vectors to find how many pivots' cells a query must
    visit, and queries of a block that are compared with the whole block to widen the share; both until they hold the
    part sure of the nearest vectors, up to all. block: vectors of an index block, from the first number to the second,
    so that there are 1024 blocks in between; they divide the work. chunk: queries that meet a block at once."""

    pivots: int = 2048
    prefix: int = 64
    asks: int = 32
    share: float = 0.1
    alike: float = 0.8
    tested: int = 32
    sure: float = 0.95
    k: int = 20
    every: int = 20
    block: tuple[int, int] = (8192, 131_072)
    chunk: int = 2048
    seed: int = 42


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part: v isn't null or zero and all its components are finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def distinct(rows: DataFrame, how: Index) -> DataFrame:
    """Of equal vectors the rows with the how.k + 1 least ids. As equal vectors tie by id, the others are never among the how.k best of any query, itself left out."""
    return rows.withColumn("copy", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= how.k + 1).drop("copy")


def raised(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Vectors with one more component that brings them all to the length longest, so that direction alone ranks their inner products with queries; queries have 0 there (longest is None)."""
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.column_stack((x, more))


def cosines(x: np.ndarray, longest: float, alike: float) -> np.ndarray:
    """The cosine from which a raised vector is alike each of x: as far off, for x's own length, as alike is without raising."""
    return 1 - (1 - alike) * (x * x).sum(axis=1) / longest**2


def choose_pivots(rows: DataFrame, how: Index) -> tuple[np.ndarray, float]:
    """At most how.pivots distinct vectors of rows, which are of one length, by a seeded hash, raised and each to length 1, those alike last; and the length of the longest vector."""
    # Hashes find the sample; only its vectors travel.
    hashed = rows.withColumn("h", F.xxhash64(F.lit(how.seed), "v"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(2 * how.pivots)
    got = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    x = np.array([r["v"] for r in got], dtype=np.float64)
    p = raised(x, longest)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    return p[spread(p, cosines(x, longest, how.alike), how.pivots)], longest


def spread(p: np.ndarray, alike: np.ndarray, most: int) -> np.ndarray:
    """The places of at most so many unit vectors: first those that are not alike an earlier one of the first, then the others."""
    free, first = np.ones(len(p), dtype=bool), []
    for i in range(len(p)):
        if free[i]:
            first.append(i)
            if len(first) == most:
                break
            free &= p @ p[i] < alike[i]
    return np.array((first + sorted(set(range(len(p))) - set(first)))[:most])


def crowds(x: np.ndarray, near: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x crowd by crowd, each with its leader first, and where the crowds start, with the end. Members have their leader's nearest pivot and its cosine of alike to it."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = np.argsort(near[:, 0], kind="stable")
    out, sizes = [], []
    for left in np.split(by, np.flatnonzero(np.diff(near[by, 0])) + 1):
        v = u[left]
        while len(left):
            member = v @ v[0] >= alike[left[0]]
            member[0] = True
            out.append(left[member])
            sizes.append(len(out[-1]))
            left, v = left[~member], v[~member]
    return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; of equally near ones the first."""
    out = np.empty((len(x), min(prefix, len(pivots))), dtype=np.int16)
    for a in range(0, len(x), 512):
        far = -(x[a : a + 512] @ pivots.T)
        if out.shape[1] < len(pivots):
            edge = np.partition(far, out.shape[1] - 1, axis=1)[:, out.shape[1] - 1 : out.shape[1]]
            pick = np.argsort(far > edge, axis=1, kind="stable") if (far == edge).sum() > len(far) else np.argpartition(far, out.shape[1] - 1, axis=1)
            # Sorted by place first, so that equally near pivots keep it.
            pick = np.sort(pick[:, : out.shape[1]], axis=1)
            sort = np.argsort(np.take_along_axis(far, pick, axis=1), axis=1, kind="stable")
            out[a : a + 512] = np.take_along_axis(pick, sort, axis=1)
        else:
            out[a : a + 512] = np.argsort(far, axis=1, kind="stable")
    return out


def as_arrays(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    """The vectors of the rows, all of them of dim components."""
    v = batch.column("v")
    parts = v.chunks if isinstance(v, pa.ChunkedArray) else [v]
    return np.concatenate([np.zeros((0, dim)), *(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for x in parts)])


def placed(rows: DataFrame, pivots: np.ndarray, longest: float | None, how: Index) -> DataFrame:
    """vec_id and v with near, the order of their nearest pivots, and cell, the nearest. longest: see raised."""
    dim = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = orders(raised(as_arrays(batch, dim), longest), pivots, how.prefix)
            yield batch.append_column("near", pa.array([x.tobytes() for x in near], pa.binary())).append_column("cell", pa.array(near[:, 0].astype(np.int32)))

    return rows.select("vec_id", "v").mapInArrow(run, PLACED + ", cell int")


def chain(pivots: np.ndarray) -> list[int]:
    """The pivots in a row in which each is followed by the nearest of those left, so that neighbours in space stand close."""
    left, at, out = np.ones(len(pivots), dtype=bool), 0, []
    while True:
        out.append(at)
        left[at] = False
        if not left.any():
            return out
        at = int(np.argmax(np.where(left, pivots @ pivots[at], -np.inf)))


def divided(sizes: dict[int, int], row: list[int], block: int) -> dict[int, tuple[int, int]]:
    """The first block of each cell and the number of blocks that it has: cells that follow each other share blocks of about equal size, a cell larger than a block is divided among blocks of its own."""
    small = [(c, sizes[c]) for c in row if 0 < sizes.get(c, 0) <= block]
    total = sum(n for _, n in small)
    number = -(-total // block)
    out, before = {}, 0
    for c, n in small:
        out[c] = (before + n // 2) * number // total, 1
        before += n
    for c in row:
        if sizes.get(c, 0) > block:
            out[c] = number, -(-sizes[c] // block)
            number += out[c][1]
    return out


def build(rows: DataFrame, n_pivots: int, longest: float, dim: int, how: Index) -> DataFrame:
    """Index blocks with their vectors and inverted files, from rows with vec_id, v, near and block: starts are a block's crowds, posted the crowds by pivot, places where the pivot stands in the order of each, heads where a pivot's list starts."""

    def run(keys: tuple, held: pa.Table) -> pa.Table:
        x, ids = as_arrays(held, dim), held.column("vec_id").to_numpy()
        near = np.array([np.frombuffer(b, dtype=np.int16) for b in held.column("near").to_pylist()])
        by = np.lexsort((*x.T[::-1], ids))
        x, ids, near = x[by], ids[by], near[by]
        by, starts = crowds(raised(x, longest), near, cosines(x, longest, how.alike))
        x, ids, near = x[by], ids[by], near[by[starts[:-1]]]
        flat = near.ravel()
        sort = np.argsort(flat, kind="stable")
        heads = np.searchsorted(flat[sort], np.arange(n_pivots + 1))
        crowd, place = np.divmod(sort, near.shape[1])
        parts = [ids.astype("<i8"), x.astype("<f8"), starts.astype("<i8"), heads.astype("<i8"), crowd.astype("<i4"), place.astype("<i2")]
        return pa.table({"block": pa.array([keys[0].as_py()], pa.int64())} | {name: pa.array([p.tobytes()], pa.binary()) for name, p in zip(("ids", "vectors", "starts", "heads", "posted", "places"), parts, strict=True)})

    return rows.groupBy("block").applyInArrow(run, INDEX)


def search(block: tuple[np.ndarray, ...], query_ids: np.ndarray, queries: np.ndarray, near: np.ndarray, how: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The how.k best of one block for each query: by footrule distance first, then by inner product.

    With prefixes of length p and the place p for a pivot that a prefix lacks, the footrule distance of two orders is
    a constant less twice the sum, over pivots of both, of p - max(place, place). So adding up that sum along the
    lists of the query's first pivots, which weigh most, ranks a whole block. Crowds are ranked by their leaders, and count once each.
    """
    ids, x, starts, heads, posted, places = block
    n, p = len(starts) - 1, how.prefix
    sizes, single = np.diff(starts), len(starts) - 1 == len(ids)
    posted, weight, room = posted.astype(np.intp), (p - places).astype(np.float64), p - np.arange(p, dtype=np.float64)

    def gains(order: np.ndarray) -> np.ndarray:
        order = order[: how.asks]
        a, z = heads[order], heads[order + 1]
        lists = [slice(i, j) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
        add = np.minimum(np.concatenate([weight[t] for t in lists]), np.repeat(room[: len(order)], z - a))
        return np.bincount(np.concatenate([posted[t] for t in lists]), add, n).astype(np.intp)

    def edge(gain: np.ndarray, wanted: int) -> int:
        """The gain of the wanted-th best."""
        from_top = np.cumsum(np.bincount(gain)[::-1])
        return len(from_top) - 1 - int(np.searchsorted(from_top, wanted))

    wanted = max(how.k + 1, int(np.ceil(how.share * n)))  # how.k must be left beside the query itself
    if how.tested:
        needed = [np.zeros(1, dtype=np.int64)]
        for i in np.unique(np.linspace(0, len(queries) - 1, min(len(queries), how.tested)).astype(int)):
            gain, score = gains(near[i]), np.where(ids == query_ids[i], -np.inf, x @ queries[i])
            most = min(how.k, len(ids) - 1)
            best = np.argpartition(-score, most - 1)[:most] if most > 0 else []
            mine = gain if single else gain[np.searchsorted(starts, best, "right") - 1]
            needed.append(n - np.searchsorted(np.sort(gain), mine[best] if single else mine))
        wanted = max(wanted, int(np.quantile(np.concatenate(needed), how.sure, method="higher")))
    # Products are found in bulk by short numbers, scaled to lengths of one at most; these miss by less than the slack.
    # What they leave is multiplied out in double precision.
    length = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)) or 1.0
    short, slack = (x / length).astype(np.float32), 1e-5
    ahead = (queries / (np.linalg.norm(queries, axis=1, keepdims=True))).astype(np.float32)
    out_q, out_v, out_s = [], [], []
    for row, (q, vector, order) in enumerate(zip(query_ids, queries, near, strict=True)):
        gain = gains(order)
        met = gain >= edge(gain, min(wanted, n))  # with all that tie with the last
        pick = np.flatnonzero(met if single else np.repeat(met, sizes))
        if len(pick) > how.k + 1:
            rough = short[pick] @ ahead[row]
            rough[ids[pick] == q] = -np.inf
            pick = pick[rough >= np.partition(rough, len(rough) - how.k)[len(rough) - how.k] - 2 * slack]
        pick = pick[ids[pick] != q]
        score = (x[pick] * vector).sum(axis=1)
        best = np.lexsort((ids[pick], -score))[: how.k]
        out_q.append(np.full(len(best), q, dtype=np.int64))
        out_v.append(ids[pick[best]])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def cells_to_visit(index: DataFrame, asked: DataFrame, pivots: np.ndarray, how: Index) -> int:
    """How many of its nearest pivots' cells a query must visit: so many that a sample of queries, compared with all vectors, finds the part how.sure of its nearest vectors there, with half of what is missing from that part to spare."""
    if not how.tested:
        return len(pivots)
    dim = pivots.shape[1] - 1
    sample = asked.orderBy(F.xxhash64(F.lit(how.seed), "vec_id"), "vec_id").limit(how.tested).collect()
    ids, x = np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3))
        for batch in batches:
            score = x @ as_arrays(batch, dim).T
            score[ids[:, None] == batch.column("vec_id").to_numpy()[None, :]] = -np.inf
            best = np.argpartition(-score, min(how.k, score.shape[1]) - 1, axis=1)[:, : how.k]
            cell = batch.column("cell").to_numpy()
            new = [np.column_stack((np.full(best.shape[1], q), score[q, best[q]], cell[best[q]])) for q in range(len(ids))]
            held = np.concatenate((held, *new))
            held = held[np.lexsort((-held[:, 1], held[:, 0]))]
            place = np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0])
            held = held[place < how.k]
        held = held[np.isfinite(held[:, 1])]
        yield pa.record_batch([pa.array(held[:, 0].astype(np.int32)), pa.array(held[:, 1]), pa.array(held[:, 2].astype(np.int32))], names=["q", "score", "cell"])

    found = index.select("vec_id", "v", "cell").mapInArrow(run, "q int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    rows = found.withColumn("place", place).where(F.col("place") <= how.k).collect()  # how.tested times how.k at most
    if not rows:
        return len(pivots)
    rank = np.argsort(orders(raised(x, None), pivots, len(pivots)), axis=1)
    return 1 + int(np.quantile([rank[r["q"], r["cell"]] for r in rows], (1 + how.sure) / 2, method="higher"))


def routed(asked: DataFrame, pivots: np.ndarray, visits: int, sizes: dict[int, int], blocks: dict[int, tuple[int, int]], chunks: int, how: Index) -> DataFrame:
    """Each query once for each block that holds vectors of the cells it visits, with the order of its nearest pivots. It visits as many cells more as it takes to meet how.k vectors beside itself."""
    dim = pivots.shape[1] - 1
    n_blocks = max(a + n for a, n in blocks.values())
    of, held = np.zeros((len(pivots), n_blocks), dtype=bool), np.array([sizes.get(c, 0) for c in range(len(pivots))])
    for cell, (a, n) in blocks.items():
        of[cell, a : a + n] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_arrays(batch, dim)
            for a in range(0, len(x), 256):
                near = orders(raised(x[a : a + 256], None), pivots, len(pivots))
                least = 1 + np.argmax(np.cumsum(held[near], axis=1) >= min(how.k + 1, held.sum()), axis=1)
                pairs = [np.flatnonzero(of[order[: max(visits, n)]].any(axis=0)) for order, n in zip(near, least, strict=True)]
                rows = np.repeat(np.arange(len(near)), [len(b) for b in pairs])
                part = batch.slice(a, len(near)).take(pa.array(rows))
                order = pa.array([near[i, : how.asks].tobytes() for i in rows], pa.binary())
                yield pa.record_batch([pa.array(np.concatenate(pairs).astype(np.int64)), part.column("chunk"), part.column("vec_id"), part.column("v"), order], names=["block", "chunk", "query_id", "v", "near"])

    return asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")).mapInArrow(run, ROUTED)


def nearest_of(rows: DataFrame, asked: DataFrame, dim: int, how: Index) -> DataFrame:
    """nearest() for the vectors of one length."""
    spark = rows.sparkSession
    pivots, longest = choose_pivots(rows, how)
    held = cut(placed(distinct(rows, how), pivots, longest, how), "placed")
    sizes = {r["cell"]: r["count"] for r in held.groupBy("cell").count().collect()}  # one a pivot
    least, most = how.block
    blocks = divided(sizes, chain(pivots), min(most, max(least, sum(sizes.values()) // 1024)))
    layout = spark.createDataFrame([(c, a, n) for c, (a, n) in blocks.items()], "cell int, first long, parts long")
    number = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    index = cut(build(held.join(F.broadcast(layout), "cell").select("vec_id", "v", "near", number.alias("block")), len(pivots), longest, dim, how), "index")
    chunks = max(1, -(-asked.count() // how.chunk))
    queries = routed(asked, pivots, cells_to_visit(held, asked, pivots, how), sizes, blocks, chunks, how)
    drop(held)
    there = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).withColumnRenamed("block", "number")

    def run(keys: tuple, met: pa.Table, block: pa.Table) -> pa.Table:
        if not met.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        kinds = {"ids": "<i8", "vectors": "<f8", "starts": "<i8", "heads": "<i8", "posted": "<i4", "places": "<i2"}
        parts = [np.frombuffer(block.column(c)[0].as_buffer(), dtype=t) for c, t in kinds.items()]
        parts[1] = parts[1].reshape(-1, dim)
        ids = met.column("query_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        near = np.array([np.frombuffer(b, dtype=np.int16) for b in met.column("near").to_pylist()])
        found = search(tuple(parts), ids[by], as_arrays(met, dim)[by], near[by], how)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return queries.groupBy("block", "chunk").cogroup(there.groupBy("number", "part")).applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, how: Index = Index()) -> DataFrame:
    """The how.k nearest by inner product for each row whose vec_id is divisible by how.every: query_id, rank, vec_id, score.

    vectors needs vec_id and embedding; other columns are ignored. Null, zero and non-finite vectors and null ids take
    no part. Vectors of one length are indexed together, and a query's candidates are those of its length: every other
    row with another id; equal vectors tie by vec_id. Rows that share an id are candidates each, and one query (the
    least of their vectors). Fewer than how.k candidates are all returned. An empty table gives no rows.

    Index blocks hold neighbouring pivots' cells. A query goes to the blocks of the cells that it must visit, ranks each
    block's crowds along the lists of its own pivots, and is compared with the best share of them.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % how.every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [nearest_of(rows.where(F.size("v") == d), asked.where(F.size("v") == d), d, how) for d in dims]
    if not found:
        return spark.createDataFrame([], RESULT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    met = functools.reduce(DataFrame.union, found)
    return met.withColumn("rank", place.cast("int")).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
