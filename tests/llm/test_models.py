import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_fixtures import SMALL, TEXTS, components, docs, empty, simhash
from pyspark.sql import functions as F

from shelfcast.llm import graph, permutation_index, quality_fm
from shelfcast.llm import simhash as near
from shelfcast.llm.common import table
from shelfcast.llm.permutation_index import Index

SF = SMALL.replace("0.001", "0.01")
LARGE = SMALL.replace("0.001", "0.1")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    w = quality_fm.Weights(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    idx, val = rng.choice(50, 12, replace=False), rng.normal(size=12)
    pairs = sum(w.factors[idx[a]] @ w.factors[idx[b]] * val[a] * val[b] for a in range(12) for b in range(a))
    assert w.raw(idx, val, np.array([0]))[0] == pytest.approx(0.3 + w.linear[idx] @ val + pairs)


def plain_machine(rows, labels, how):
    """Training and scoring with every pair written out, one row and one weight at a time."""
    size = (1 << how.hash_bits) + quality_fm.N_STATS
    rng = np.random.default_rng(how.seed)
    prior = min(0.99, max(0.01, sum(labels) / len(labels)))
    bias, w, v = float(np.log(prior / (1 - prior))), [0.0] * size, rng.normal(0, 0.01, (size, how.factors)).tolist()
    first, second = [[[0.0] * (how.factors + 1) for _ in range(size)] for _ in range(2)]

    def raw(x):
        pairs = sum(sum(v[i][f] * v[j][f] for f in range(how.factors)) * a * b for k, (i, a) in enumerate(x) for j, b in x[:k])
        return bias + sum(w[i] * a for i, a in x) + pairs

    def sigmoid(z):
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

    step = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), how.batch):
            pick = order[at : at + how.batch]
            grad, errors = {}, 0.0
            for r in pick:
                error = (sigmoid(raw(rows[r])) - labels[r]) / len(pick)
                errors += error
                for i, a in rows[r]:
                    g = grad.setdefault(i, [0.0] * (how.factors + 1))
                    g[0] += error * a
                    for f in range(how.factors):
                        g[f + 1] += error * a * sum(v[j][f] * b for j, b in rows[r] if j != i)
            step += 1
            for i, g in grad.items():
                now = [w[i], *v[i]]
                for f in range(how.factors + 1):
                    d = g[f] + how.decay * now[f]
                    first[i][f] = 0.9 * first[i][f] + 0.1 * d
                    second[i][f] = 0.999 * second[i][f] + 0.001 * d * d
                    now[f] -= how.rate * (first[i][f] / (1 - 0.9**step)) / (np.sqrt(second[i][f] / (1 - 0.999**step)) + 1e-8)
                w[i], v[i] = now[0], now[1:]
            bias -= how.rate * errors
    return [sigmoid(raw(x)) for x in rows]


def test_classifier_against_plain():
    how = quality_fm.Machine(hash_bits=6, factors=3, epochs=3, batch=4)
    texts = ["the cat sat on the mat and slept.", "buy### now$$$ cheap%%%!!", "a plain sentence of words, quite long enough.", "spam spam spam spam", "", "one two three four five six seven", "### $$$", "The End. Of it all."] * 2
    labels = np.array([1.0, 0, 1, 0, 0, 1, 0, 1] * 2)
    rows = [quality_fm.features(t, len(t) + i % 3, how) for i, t in enumerate(texts)]
    got = quality_fm.train(rows, labels, how).score(rows)
    want = plain_machine([[(int(i), float(a)) for i, a in zip(*r, strict=True)] for r in rows], labels.tolist(), how)
    assert got == pytest.approx(want, abs=1e-9) and len(set(np.round(got, 6))) > 4


@needs_tables
def test_classifier_held_out(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_fm.classify(documents, labels)
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == documents.count() and (held.predicted == held.quality).mean() >= 0.95
    # Labels of held-out rows, languages, sources and ids teach nothing.
    other = labels.withColumn("quality", F.when(quality_fm.held_out(F.col("doc_id"), quality_fm.Machine()), 1 - F.col("quality")).otherwise(F.col("quality")))
    blind = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, quality_fm.classify(blind, other).collect())) == sorted(map(tuple, got.collect()))


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (14, 0, 0), (15, 0, 0), (13, 1, 0), (None, 1, 0), (9, None, 0), (12, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_fm.classify(docs(spark), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert {r["score"] for r in quality_fm.classify(docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_fm.classify(empty(spark), labels).count() == 0
    assert quality_fm.keep(docs(spark), labels).columns == docs(spark).columns


def test_simhash_edges(spark):
    out = near.near_duplicates(docs(spark)).collect()
    assert sorted((r["doc_id"], r["fingerprint"]) for r in out if r["doc_id"]) == sorted((i, f"{simhash(t):016x}") for i, t in TEXTS if i)
    by = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]}
    assert by[12] == by[13] == 12 and by[2] == by[3] == by[4] == 2
    assert near.near_duplicates(empty(spark)).count() == 0
    kept = near.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16]


@needs_tables
def test_simhash_against_all_pairs(spark):
    documents = table(spark, SMALL, "documents")
    texts = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    fps = [simhash(t) for _, t in texts]
    want = {texts[i][0]: (f"{fps[i]:016x}", texts[r][0]) for i, r in enumerate(components(fps))}
    how = near.SimHash(tile=64, strip=8)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near.near_duplicates(documents, how).collect()} == want


def test_tiles_miss_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = base.copy()
    for i in range(300):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            flips[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate((base, flips)))
    order = np.lexsort((fps, *near.part_counts(fps).T[::-1]))
    fps = fps[order]
    u, v = near.near_pairs(fps, fps, True, near.SimHash(strip=16))
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        root[find(a)] = find(b)
    want = components([int(x) for x in fps])
    groups = {}
    for x, r in zip(fps.tolist(), want, strict=True):
        groups.setdefault(r, set()).add(find(x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (100, 102), (7, 7), (-5, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, -5: -5, 200: -5}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def exact(ids, x, query, k=20):
    score = (x * x[ids.index(query)]).sum(axis=1)
    return sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != query)[:k]


@needs_tables
def test_index_recall(spark):
    vectors = table(spark, SF, "embeddings")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    for how in (Index(), Index(tested=0, share=0.2), Index(block=(64, 64), chunk=10)):
        got = {}
        for r in permutation_index.nearest(vectors, how).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(got) == [i for i in ids if i % 20 == 0]
        hits = 0
        for q, found in got.items():
            found.sort()
            assert [r for r, *_ in found] == list(range(1, 21))
            want = exact(ids, x, q)
            hits += len({i for _, i in want} & {i for _, i, _ in found})
            assert all(s == pytest.approx(float(x[ids.index(i)] @ x[ids.index(q)]), abs=1e-12) for _, i, s in found)
        assert hits / (20 * len(got)) >= 0.9


def test_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (21, [1.0, 0.0]), (40, []), (60, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, rank string, block int")
    got = [tuple(r) for r in permutation_index.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 21, 1.0), (0, 4, 2, 0.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 21, 2.0), (20, 4, 2, 0.0)]
    assert permutation_index.nearest(df.limit(0)).count() == 0


def resampled(spark, n):
    """So many unit vectors around those of the largest table."""
    rng = np.random.default_rng(3)
    x = np.array([r["embedding"] for r in table(spark, LARGE, "embeddings").orderBy("vec_id").collect()], dtype=np.float64)
    x = x[rng.integers(0, len(x), n)] + rng.normal(size=(n, x.shape[1])) * 0.3 / 8
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng


def recalls(spark, path, x, how, files=1):
    """Query ids and the recall of each, by scores, as equal vectors tie."""
    path.mkdir()
    for i in range(files):
        at = np.arange(i, len(x), files)
        pq.write_table(pa.table({"vec_id": at, "embedding": pa.array(list(x[at]), pa.list_(pa.float64()))}), path / f"{i}.parquet")
    got = permutation_index.nearest(spark.read.parquet(str(path)), how).toPandas()
    out = {}
    for q, found in got.groupby("query_id"):
        want = np.delete(x @ x[q], q)
        least = np.partition(want, len(want) - 20)[-20]
        out[q] = (found.score >= least - 1e-9).sum() / 20
    assert sorted(out) == list(range(0, len(x), how.every))
    return np.array(list(out)), np.array(list(out.values()))


@needs_tables
def test_index_recall_beside_a_crowd(spark, tmp_path):
    for noise in (0, 0.2):  # a third are copies of one vector, or near copies
        x, rng = resampled(spark, 25_000)
        crowd = rng.random(len(x)) < 1 / 3
        near = x[0] + rng.normal(size=(crowd.sum(), x.shape[1])) * noise / 8
        x[crowd] = near / np.linalg.norm(near, axis=1, keepdims=True)
        q, r = recalls(spark, tmp_path / f"{noise}.parquet", x, Index(every=100))
        assert r[crowd[q]].mean() >= 0.9 and r[~crowd[q]].mean() >= 0.9


@needs_tables
def test_index_recall_of_unequal_lengths(spark, tmp_path):
    x, rng = resampled(spark, 25_000)
    x *= rng.lognormal(0, 0.5, len(x))[:, None]
    assert recalls(spark, tmp_path / "lengths.parquet", x, Index(every=100, tested=0))[1].mean() >= 0.9
    x[7] *= 1000  # one vector longer than all others by far
    assert recalls(spark, tmp_path / "longest.parquet", x, Index(every=100))[1].mean() >= 0.9


@needs_tables
def test_index_recall_of_full_blocks_in_any_number_of_files(spark, tmp_path):
    x, _ = resampled(spark, 17_000)
    found = [recalls(spark, tmp_path / f"{n}", x, Index(every=100), n) for n in (1, 4, 64)]
    assert all(r.mean() >= 0.9 for _, r in found)
    assert all(np.array_equal(r, found[0][1]) for _, r in found)  # files don't matter
    for how in (Index(every=100, block=(17_000, 17_000)), Index(every=100, tested=0, share=0.15)):
        assert recalls(spark, tmp_path / f"{how.tested}", x, how)[1].mean() >= 0.9


def test_search_beside_brute_force():
    """One block of 16,384 vectors, 820 queries: recall against a matrix product with the best of each row; the times are shown, not tested."""
    import time

    rng = np.random.default_rng(5)
    x = rng.normal(size=(16_384, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::20]
    how = Index(tested=0, share=0.1)
    pivots = permutation_index.raised(x[rng.permutation(len(x))[: how.pivots]], 1.0)
    near = permutation_index.orders(permutation_index.raised(x, 1.0), pivots, how.prefix)
    flat = near.ravel()
    sort = np.argsort(flat, kind="stable")
    crowd, place = np.divmod(sort, how.prefix)
    block = (np.arange(len(x)), x, np.arange(len(x) + 1), np.searchsorted(flat[sort], np.arange(len(pivots) + 1)), crowd.astype(np.int32), place.astype(np.int16))
    began = time.process_time()
    _, found, _ = permutation_index.search(block, np.arange(0, len(x), 20), q, near[::20], how)
    mine, began = time.process_time() - began, time.process_time()
    score = q @ x.T
    score[np.arange(len(q)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argpartition(-score, 20, axis=1)[:, :20]
    brute = time.process_time() - began
    met = sum(len(set(a) & set(b)) for a, b in zip(found.reshape(-1, 20).tolist(), best.tolist(), strict=True)) / best.size
    print(f"search {mine:.2f} s, brute force {brute:.2f} s, recall {met:.3f}")
    assert met >= 0.9


def test_vectors_of_any_length_are_searched(spark):
    """A vector of another length takes no other out."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)] + [(1000 + i, rng.normal(size=2).tolist()) for i in range(30)] + [(5000, [1.0] * 7)]
    got = {}
    for r in permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: len(x) for q, x in got.items()} == {i: 20 for i in range(0, 200, 20)} | {1000: 20, 1020: 20}
    hits = []
    for q, found in got.items():
        ids = [i for i, v in rows if len(v) == (3 if q < 1000 else 2)]
        x = np.array([v for i, v in rows if i in set(ids)])
        hits.append(len({i for _, i in exact(ids, x, q)} & {i for _, i in found}) / 20)
    assert sum(hits) / len(hits) >= 0.9
