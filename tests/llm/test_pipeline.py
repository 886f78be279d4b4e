"""Each stage of the pipeline against a plain version over what its predecessor kept."""

import os
import zlib
from collections import Counter

import pytest
from llm_fixtures import SMALL, components, dedup_lines, docs, dup_lines, empty, repeat_words, simhash, space_words

import corpus_pipeline
from shelfcast.llm import bpe, quality_fm
from shelfcast.llm.common import cut, table
from shelfcast.llm.queries import PACKING


def passes(text):
    words = space_words(text)
    n, chars = len(words), sum(map(len, words))
    shouts = sum(w.endswith("!!") for w in words)
    return not (n < 10 or 10 * sum(c in "#*$%&|<>" for c in text) > n or shouts > 0.2 * n or chars > 20 * n or chars < 1.5 * n or dup_lines(text) > 0.5 * len(text.split("\n")) or 100 * repeat_words(words) > 20 * n)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")
def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "quality rules", "line dedup", "SimHash near-dedup", "best-fit packing"]
    given = table(spark, SMALL, "documents")
    now = cut(stages["quality classifier"](spark, given, SMALL))
    good = {r["doc_id"] for r in quality_fm.classify(given, table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in now.collect()} == good and now.columns == given.columns
    texts = sorted((r["doc_id"], r["text"]) for r in now.collect())
    now = cut(stages["quality rules"](spark, now, SMALL))
    texts = [(i, t) for i, t in texts if passes(t)]
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == texts
    now = cut(stages["line dedup"](spark, now, SMALL))
    texts = [(i, t) for (i, _), t in zip(texts, dedup_lines(texts), strict=True)]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in now.collect()) == [(i, t, len(t)) for i, t in texts]
    now = cut(stages["SimHash near-dedup"](spark, now, SMALL))
    roots = components([simhash(t) for _, t in texts])
    texts = [x for k, x in enumerate(texts) if roots[k] == k]
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == texts and now.columns == given.columns
    whole = bpe.tokenizer(PACKING.json_path)
    want = Counter()
    for i, t in texts:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        want[i] = zlib.crc32(bpe.packed(ids[-1024:] if len(ids) % 1024 == 0 or len(ids) > 1024 else ids))
    last = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        last[r["doc_id"]] = max(last.get(r["doc_id"], (-1, 0)), (r["piece"], r["ids_crc32"]))
    assert {i: c for i, (_, c) in last.items()} == dict(want)


def test_stages_take_awkward_and_empty_tables(spark):
    for given in (docs(spark), empty(spark)):
        now = cut(given)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = cut(stage(spark, now, SMALL))
            assert now.columns == given.columns, name
        corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count()
