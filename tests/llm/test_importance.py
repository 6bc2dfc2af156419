"""Target-distribution resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

from daybook.llm import common, importance

SAMPLE = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORDS.findall(lower(text))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def expected(docs, target, percent=5, min_words=20):
    found = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10_000.0)) / ((s[b] + 1.0) * (all_t + 10_000.0))))
        for b in s
    }
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted(
        (r for r in rows if r[1] >= min_words),
        key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]),
    )
    k = percent * len(can) // 100
    rank = {}
    for place, r in enumerate(can[:k], 1):
        rank.setdefault(r, []).append(place)
    return Counter((*r, rank[r].pop(0) if rank.get(r) else None) for r in rows)


def result(df):
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_sample_tables(spark):
    docs, target = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert result(importance.resample(docs, target)) == wanted
    assert sum(r[-1] is not None for r in wanted) == 5 * sum(r[1] >= 20 for r in wanted) // 100


def test_odd_rows(spark, odd_rows, odd_docs):
    target = ["the same text, with words in it", None, "", "w1 w2 w3 w4"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "bucket int, text string")
    for percent, at_least in ((5, 20), (60, 1), (100, 0)):
        found = importance.resample(odd_docs, items, percent, at_least)
        assert result(found) == expected(odd_rows, target, percent, at_least)


def test_empty_tables(spark, odd_rows, odd_docs):
    none = odd_docs.filter("false")
    assert importance.resample(none, odd_docs).collect() == []
    assert result(importance.resample(odd_docs, none)) == expected(odd_rows, [])


def test_pieces_of_a_long_text(monkeypatch):
    text = b"one two, three. four five;six " * 20 + b"seven" * 100
    whole = [b for _, found in importance.bucket_lists(text, 3, 1 << 32) for b in found.tolist()]
    monkeypatch.setattr(common.word_lists, "__defaults__", (7,))
    pieces = list(importance.bucket_lists(text, 3, 1 << 32))
    assert len(pieces) > 50 and sum(n for n, _ in pieces) == 121
    assert Counter(b for _, found in pieces for b in found.tolist()) == Counter(whole)


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id % 7 <> 0 AS eligible", "(id % 3) * 100000 AS score", "0 AS n_features", "0 AS weight")
    found = {r.doc_id: r["rank"] for r in importance.draw(rows, 300).collect() if r["rank"]}
    order = sorted((i for i in range(1000) if i % 7), key=lambda i: (-(i % 3), i))[:300]
    assert found == {i: n for n, i in enumerate(order, 1)}
