import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from llm_fixtures import LONG, TEXTS, docs, empty

from shelfcast.llm import bpe, bpe_tree, packing
from shelfcast.llm.queries import PACKING, VOCABULARY

PARTS = ["a", "b", "the", "'s", "'re", "'", "  ", " ", "\n", "\t", "é", "ß", "漢", "1", "23", "!!", "--", " ", "́", "ing", "z", "\x1c", "😀", "\xa0", "\r\n"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) if rng.random() < 0.9 else rng.choice("a!1 ") * rng.randint(1, 60) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library():
    return bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize(("leaf", "window"), [(3, 1), (5, 2), (16, 4), (64, 8)])
def test_tree_joins_are_exact(leaf, window):
    tree = bpe_tree.TreeCodec(bpe_tree.Vocabulary(VOCABULARY.ranks_path, VOCABULARY.pattern, leaf, window))
    rng = random.Random(leaf)
    long = ["a" * 3000, "!?-" * 900, "12345" * 700, " " * 2000 + "x", "漢字" * 700, "".join(rng.choice("abcdefghij") for _ in range(4000)), "'s" * 500, "\n\n" * 300 + "b"]
    for text in texts(1500, leaf) + long:
        ids = tree.encode(text)
        assert ids == library().encode_ordinary(text), repr(text[:80])
        assert tree.decode(ids) == text.encode()


def test_packed_ids_are_the_tokenizers():
    encode = bpe.packed_encoder(PACKING.json_path, PACKING.ranks_path, PACKING.pattern)
    for text in [*texts(1500, 9), "<|endoftext|> a", "x<|endoftext|>", *(t or "" for _, t in TEXTS)]:
        assert encode(text) == encode.whole(text), repr(text[:80])


def test_encode_decode_query(spark):
    got = sorted((tuple(r) for r in bpe_tree.encode_decode(docs(spark), VOCABULARY).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = library().encode_ordinary(t or "")
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_tree.encode_decode(empty(spark), VOCABULARY).count() == 0


def test_packing(spark):
    got = packing.best_fit_pack(docs(spark), PACKING).collect()
    whole = bpe.tokenizer(PACKING.json_path)
    want = Counter()
    for i, t in TEXTS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        sizes = [len(ids)] if len(ids) <= 1024 else [len(ids) % 1024] * bool(len(ids) % 1024) + [1024] * (len(ids) // 1024)
        at = 0
        for k, n in enumerate(sizes):
            want[(i, k, at, n, zlib.crc32(bpe.packed(ids[at : at + n])))] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in got) == want and len(LONG) > 100_000
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.best_fit_pack(empty(spark), PACKING).count() == 0


def test_open_bins_are_bounded_and_best_fit():
    rng = random.Random(2)
    sizes = [rng.randint(1, 64) for _ in range(4000)]
    bins, held = packing.OpenBins(64, 8), defaultdict(int)
    for n in sizes:
        b, offset = bins.place(n)
        assert offset == held[b]
        held[b] += n
        assert bins.n_open <= 8 and held[b] <= 64 and bins.n_open == sum(map(len, bins.free))
    # With all bins left open it is plain best fit.
    free, bins = {}, packing.OpenBins(64, 10_000)
    for n in sizes:
        room = [f for f in free.values() if f >= n]
        b, offset = bins.place(n)
        assert 64 - offset == (min(room) if room else 64)
        free[b] = 64 - offset - n


@pytest.mark.parametrize("most", [1, 2, 8, 50])
def test_bounded_best_fit_against_plain(most):
    """The fullest bin closes, the one just filled counted with the others; of equally full ones an older one stays open."""
    rng = random.Random(most)
    sizes = [524, 1023, *(rng.randint(1, 1024) for _ in range(1500))]
    bins, free, made = packing.OpenBins(1024, most), {}, 0
    for n in sizes:
        room = min((f for f in free.values() if f >= n), default=None)
        b, offset = bins.place(n)
        assert offset == 1024 - (room or 1024) and (free.pop(b) == room if room else b == made)
        made += room is None
        left = 1024 - offset - n
        if left and (len(free) < most or left > min(free.values())):
            if len(free) == most:
                closed = {i for i, f in free.items() if f == min(free.values())}
                still = {i for held in bins.free for i in held}
                (gone,) = closed - still
                del free[gone]
            free[b] = left
        assert {i: f for f, held in enumerate(bins.free) for i in held} == free
    assert bins.made == made


def test_usual_texts_are_joined():
    tree = bpe_tree.TreeCodec(VOCABULARY)
    joins, plain = [], tree.join
    tree.join = lambda text, a, m, b, left, right: joins.append(m) or plain(text, a, m, b, left, right)
    text = "An ordinary paragraph of some words, it's not long. " * 20
    assert tree.encode(text) == library().encode_ordinary(text) and len(joins) >= 3
