"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from daybook.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for (doc, tf), n in zip(counts, sizes):
            score = 0
            for t in words & tf.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        found.sort()
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(found[:k], 1)]
    return Counter(out)


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


ITEMS = [
    (1, "the same text of many copies"), (2, None), (3, ""), (4, "w1 w2 w29 TAIL tail"), (5, "éa B"), (None, "lone"),
    (None, "passage"), (6, "no such terms herein"), (7, "start 10 end 12 surely fifty"), (7, "w3"), (8, "x" * 200_000),
    (9, "long word the"), (10, "the"),
]


@pytest.mark.parametrize("round_bytes", [8 << 20, 70_000])
def test_odd_rows_in_rounds(spark, odd_rows, odd_docs, round_bytes):
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id bigint, text string, score int, term string")
    found = result(lexical.search(odd_docs, items, 10, round_bytes))
    assert found == expected(odd_rows, ITEMS)
    assert found[(1, 10, 109, next(s for i, r, d, s in found if (i, r) == (1, 10)))] == 1


def test_several_shards(spark, odd_rows, odd_docs, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "SHARD_WORDS", 50)
    assert result(lexical.search(odd_docs.coalesce(1), items, 3)) == expected(odd_rows, ITEMS, 3)


def test_empty_tables(spark, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.search(odd_docs.filter("false"), items).collect() == []
    assert lexical.search(odd_docs, items.filter("false")).collect() == []
    assert lexical.search(odd_docs, items.filter("item_id IN (2, 3)")).collect() == []


def _shard(docs):
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, text in docs for t in terms(text)}))}
    found = [np.array([vocabulary[t] for t in terms(text)], np.int32) for _, text in docs]
    batch = lexical._packed([i for i, _ in docs], [len(f) for f in found], found)
    return vocabulary, batch.to_pylist()[0]


def test_accumulators_stop_and_the_result_is_exact():
    """A rare term fills the accumulators; the postings of frequent ones open no more."""
    docs = [(i, "common " * (i % 4 + 1) + ("rare scarce" if i % 50 == 0 else f"only{i}")) for i in range(1000)]
    vocabulary, row = _shard(docs)
    sizes = [len(terms(t)) for _, t in docs]
    shard = lexical.Shard(row, len(docs), sum(sizes))
    df = Counter(t for _, text in docs for t in set(terms(text)))
    weights = np.array([math.floor(1000 * math.log((2 * 1000 + 2) / (2 * df[t] + 1))) for t in sorted(vocabulary)])
    ids, scores = shard.search(np.array([vocabulary[t] for t in ("common", "rare", "scarce")]), weights, 10)
    assert shard.read < 100  # of 1,040 postings
    wanted = expected(docs, [(0, "common rare scarce")])
    assert Counter((0, n, i, s) for n, (i, s) in enumerate(zip(ids.tolist(), scores.tolist()), 1)) == wanted
