"""Byte-level substring dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from daybook.llm import suffix_dedup


def expected(docs, window):
    raw = [(i, (t or "").encode()) for i, t in docs]
    key = lambda i: (i is not None, i or 0)
    first = {}
    for i, body in raw:
        for s in range(len(body) - window + 1):
            w = body[s : s + window]
            if w not in first or key(i) < key(first[w]):
                first[w] = i
    out = []
    for i, body in raw:
        gone = [False] * len(body)
        upto = 0
        for s in range(len(body) - window + 1):
            if key(first[body[s : s + window]]) < key(i):
                upto = max(upto, s)
                gone[upto : s + window] = [True] * (s + window - upto)
                upto = s + window
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(df):
    assert df.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return Counter(tuple(r)[:5] for r in df.collect())


@pytest.mark.parametrize("window", [50, 12])
def test_odd_rows(spark, odd_rows, odd_docs, window):
    assert result(suffix_dedup.dedup_bytes(odd_docs, window)) == expected(odd_rows, window)


def test_small_blocks_and_shards(spark, odd_rows, odd_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 60_000)
    out = suffix_dedup.dedup_bytes(odd_docs.coalesce(1), 50, keep_text=True)
    assert result(out) == expected(odd_rows, 50)
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in out.collect())


def test_empty_table_and_texts(spark, odd_docs):
    assert suffix_dedup.dedup_bytes(odd_docs.filter("false")).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert result(suffix_dedup.dedup_bytes(odd_docs.filter("doc_id <= 2"))) == Counter(
        {(i, 0, 0, 0, empty): 1 for i in (1, 2)}
    )


@pytest.mark.parametrize("alphabet, window", [(2, 50), (2, 16), (3, 9), (200, 50), (1, 30)])
def test_classes_are_the_equal_windows(alphabet, window):
    """The order by dictionary and parse tells exactly the different windows apart."""
    rng = np.random.default_rng(alphabet * window)
    pool = [bytes(rng.integers(0, alphabet, 200, np.uint8)) for _ in range(4)]
    texts = []
    for _ in range(300):
        source, size = pool[rng.integers(4)], int(rng.integers(window, window + 27))
        at = int(rng.integers(0, 200 - size))
        text = bytearray(source[at : at + size])
        if rng.random() < 0.3:
            text[rng.integers(size)] = rng.integers(0, alphabet)
        texts.append(bytes(text))
    texts = sorted(set(texts), key=texts.index)
    joined = b"".join(texts)
    first, kind = suffix_dedup.window_classes(texts, window)
    ends = np.cumsum([len(t) for t in texts])
    wanted = [s for a, b in zip([0, *ends[:-1]], ends) for s in range(a, b - window + 1)]
    assert sorted(first.tolist()) == wanted
    of, by = defaultdict(set), defaultdict(set)
    for s, k in zip(first.tolist(), kind.tolist()):
        of[k].add(joined[s : s + window])
        by[joined[s : s + window]].add(k)
    assert all(len(v) == 1 for v in of.values()) and all(len(v) == 1 for v in by.values())


def test_suffix_arrays_are_in_text_order():
    rng = np.random.default_rng(5)
    phrases = sorted({bytes(rng.integers(0, 3, rng.integers(1, 40), np.uint8)) for _ in range(200)}, key=hash)
    words = suffix_dedup.Dictionary(phrases, 50)
    suffixes = [(p[i:], words.rank[a + i]) for p, a in zip(phrases, words.start) for i in range(len(p) + 1)]
    in_order = sorted(suffixes)
    assert [r for _, r in in_order] == sorted(r for _, r in suffixes)
    assert len({s for s, _ in suffixes}) == len({r for _, r in suffixes})


def test_rolling_hash():
    body = np.frombuffer(b"abcabcabcd" * 5, np.uint8)
    for n in (1, 2, 3, 4, 7, 24, 50, 51):
        hashes = suffix_dedup.rolling(body, n)
        assert len(hashes) == max(50 - n + 1, 0)
        same = defaultdict(set)
        for i, h in enumerate(hashes.tolist()):
            same[body[i : i + n].tobytes()].add(h)
        assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)
