import random
import re
import time
import zlib
from collections import Counter, defaultdict

import xxhash
from llm_fixtures import TEXTS, docs, empty, rows

from shelfcast.llm import license_scan, sharding

WORD = re.compile(license_scan.WORD)


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, how=license_scan.Scan()):
    words = words_of(text)
    places = [(i, label) for phrase, label in how.phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {label for _, label in places}, 0.0
    at = {}
    for i in range(len(words) - how.k + 1):
        at.setdefault(tuple(words[i : i + how.k]), []).append(i)
    for label, template in how.templates:
        tw = words_of(template)
        diagonals = {}
        for j in range(len(tw) - how.k + 1):
            for i in at.get(tuple(tw[j : j + how.k]), ()):
                diagonals.setdefault(i - j, []).append(j)
        runs, before, room = [], None, how.k + (1 - how.min_share) * len(tw)
        for diag, js in sorted(diagonals.items()):
            first, last = diag + min(js), diag + max(js) + how.k - 1
            if before is None or diag - before[0] > how.slack or first - before[2] > room or before[1] - last > room:
                runs.append(set())
            for j in js:
                runs[-1].update(range(j, j + how.k))
            before = diag, first, last
        for covered in runs:
            share = min(1.0, len(covered) / len(tw))
            best = max(best, share)
            if share >= how.min_share:
                labels.add(label)
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else best


def test_scan_against_plain(spark):
    more = [(20, "x " * 40 + license_scan.TEMPLATES[8][1] + " y"), (21, license_scan.TEMPLATES[8][1].replace("charge", "any charge").replace("copy", "whole copy")), (22, "Permission is hereby granted, free of charge, to nobody"), (23, "gnu general public license gnu general public license"), (24, "GNU GENERAL PUBLIC LICENSÉ")]
    given = TEXTS + more
    df = docs(spark).select("doc_id", "text", "words", "places", "score").union(spark.createDataFrame([(i, t, "c", "c", "c") for i, t in more], "doc_id long, text string, words string, places string, score string"))
    got = sorted((tuple(r) for r in license_scan.scan(df).collect()), key=str)
    assert got == sorted(((i, *plain_scan(t)) for i, t in given), key=str)
    by = {r[0]: r for r in got}
    assert by[7][6] == "apache,apache-2.0" and by[20][6] == "mit" and by[21][6] == "mit" and by[22][6] == "" and 0 < by[22][7] < 0.8 and by[10][2] == 3 and by[10][5] == "cc-by,mit"
    assert license_scan.scan(empty(spark)).count() == 0


def test_edited_headers(spark):
    """Every whole template is found, with words put in and left out here and there, and twice in one text."""
    rng = random.Random(8)
    given = []
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        given.append((i, text))
        if len(words) > 25:
            at = rng.randrange(8, len(words) - 8)
            given.append((100 + i, " ".join([*words[:at], "new", "words", *words[at + 1 :]])))
        given.append((200 + i, f"{text} {'between ' * 50} {text.upper()}"))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, text in given:
        assert tuple(got[i])[1:] == plain_scan(text)
        assert license_scan.TEMPLATES[i % 100][0] in got[i]["labels"].split(",")


def test_time_is_linear_in_the_text(spark):
    spent = []
    for n in (80_000, 320_000):
        df = spark.createDataFrame([(1, " ".join(f"w{i % 9973}" for i in range(n)) + " Released under the MIT License")], "doc_id long, text string")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert license_scan.scan(df).first()["n_words"] == n + 5
            took.append(time.perf_counter() - began)
        spent.append(min(took))
    assert spent[1] < 4.5 * spent[0]


def test_scan_is_native(spark):
    plan = license_scan.scan(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_shards(given, got, n):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in given)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(n))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    return by


def test_shards_hold_the_mixture(spark):
    given = [(i, f"text {i}", f"s{min(4, int(7 * (i / 900) ** 3))}") for i in range(900)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = sharding.interleave(df, sharding.Sharding(shards=7, buckets=16)).collect()
    by = check_shards(given, got, 7)
    total = Counter(s for _, _, s in given)
    for x in by.values():
        mix = Counter(r["source"] for r in x)
        assert all(abs(mix[s] - n / 7) <= 2 for s, n in total.items())
    again = sharding.interleave(df.repartition(5), sharding.Sharding(shards=7, buckets=999)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))  # neither the layout nor the buckets matter
    # In slot order the fractional ranks rise: rank within the source over the source's rows.
    seen, place = Counter(), []
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        place.append((2 * seen[r["source"]] + 1) / (2 * total[r["source"]]))
        seen[r["source"]] += 1
    assert place == sorted(place)


def spark_hash(*values):
    """Spark's xxhash64 of an int and longs: each value is hashed with the hash before it as the seed; nulls change nothing."""
    h = 42
    for i, v in enumerate(values):
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(4 if i == 0 else 8, "little", signed=True), h)
    return h


def plain_shards(given, n, seed=42):
    """Rows as (doc_id, text, source): sorted by the seeded key in each source, then all by fractional rank, then cut."""
    by = defaultdict(list)
    for i, t, source in given:
        raw = (t or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 16
        by[source].append((spark_hash(seed, i, crc, size) >> 1, (i is not None, i or 0), crc, size, i))
    placed = []
    for source, held in by.items():
        for r, row in enumerate(sorted(held)):
            placed.append(((2 * r + 1) / (2 * len(held)), (source is not None, source or ""), row))
    out, slots = Counter(), Counter()
    for p, (_, _, (_, _, crc, size, i)) in enumerate(sorted(placed)):
        shard = p * n // len(placed)
        out[(i, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
    return out


def test_shards_against_plain(spark):
    rng = random.Random(9)
    given = [(i, f"text {i % 50}" if i % 7 else None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(700)] + [(5, "twice", "a")] * 3 + [(None, "no id", "b")] * 2
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    for n in (7, 40):
        got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(df, sharding.Sharding(shards=n)).collect())
        assert got == plain_shards(given, n)


def test_shards_of_awkward_rows(spark):
    check_shards([(r[0], r[1]) for r in rows()], sharding.interleave(docs(spark)).collect(), 40)
    assert sharding.interleave(empty(spark)).count() == 0
