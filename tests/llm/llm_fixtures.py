"""Awkward rows for every operator, and plain versions of what the operators compute."""

import re

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))
PARAGRAPH = " ".join(f"shared{i}" for i in range(60))
#: Columns that operators might be tempted to use themselves.
EXTRA = ["score", "size", "d", "t", "h", "fp", "words", "places", "shard", "piece", "text_crc32", "fingerprint", "component_id", "failed_rule", "kept", "i", "n", "x", "seq", "sequence_id", "__t", "__fp", "__row", "__score", "__in0", "text_in", "declared_in", "row", "salt", "at", "hashed", "first", "_fp", "l", "r"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, " \n\t \n "),
    (5, LONG),
    (6, "one"),
    (7, "Licensed under the Apache License, Version 2.0 and then some more words follow here."),
    (8, f"intro line eight\n{PARAGRAPH}\nafter"),
    (9, f"intro line nine\n{PARAGRAPH}\n\nother"),
    (10, "the MIT license, The mit-license; CC BY 4.0"),
    (11, "é ß 漢字 kana かな text with   wide spaces and <|endoftext|> marks 's 're"),
    (12, "same text twice over ten words long so that it passes all rules"),
    (12, "same text twice over ten words long so that it passes all rules"),
    (13, "same text twice over ten words long so that it passes all rules"),
    (None, "a document without any id but with enough words to pass the rules easily"),
    (None, None),
    (14, "spam spam spam spam spam spam spam spam spam spam spam spam spam spam"),
    (15, "buy### now$$$ cheap%%% deals&&& here*** and### there$$$ for%%% you&&& all*** today###"),
    (16, "x" * 5000),
]


def rows():
    return [(i, t, None if i == 6 else "en", None if i in (3, None) else f"s{(i or 0) % 2}", None if t is None else len(t), *["clash"] * len(EXTRA)) for i, t in TEXTS]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeat_words(words, k=5):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}
    return len(covered)


def dup_lines(text):
    seen, n = set(), 0
    for x in (text or "").split("\n"):
        if space_words(x):
            n += x in seen
            seen.add(x)
    return n


def dedup_lines(texts, min_words=50):
    """texts: (id, text) in order, ids distinct. Every run of lines is tried."""
    held = []
    for _, text in texts:
        lines = (text or "").split("\n")
        held.append([(i, x, len(space_words(x))) for i, x in enumerate(lines) if space_words(x)])
    runs = {}
    for d, seq in enumerate(held):
        for s in range(len(seq)):
            n = 0
            for e in range(s, len(seq)):
                n += seq[e][2]
                if n >= min_words:
                    runs.setdefault(tuple(x for _, x, _ in seq[s : e + 1]), []).append((d, s, e))
    dead = {(d, held[d][j][0]) for at in runs.values() for d, s, e in sorted(at)[1:] for j in range(s, e + 1)}
    return [None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in dead) for d, (_, text) in enumerate(texts)]


def simhash(text, k=3):
    import xxhash

    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in space_words(text)]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius=3):
    """Least index reachable from each index."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]
