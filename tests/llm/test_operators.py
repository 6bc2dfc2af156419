"""Training-data operators against brute force, on odd rows and sample tables."""

import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import blocks, chat, components, exact_dedup, line_dedup, lm, mixing, queries, quality, search
from daybook.llm import sentencepiece, simhash, substring
from daybook.llm.blocks import NO_ID
from daybook.llm.common import running_total, small_batches
from daybook.llm.elias_fano import EliasFano, Levels

SAMPLE = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row int, pos int,"
    " h1 int, copy int, size int, rank int, score int, fp int, part int, _digest int, block_id int, class int, key int"
)
LINE = "A line that is long enough to be deduplicated, surely"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return (text or "").encode().split()


ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "Éa b C"), (5, "éa b c"), (6, "Éa B c"), (6, "Éa B c"),
    (None, "lone text"), (None, None), (7, "x" * 200_000), (8, "long word " * 60_000),
    *((i, f"start {i}\n{LINE}\n  {LINE.upper()} \nend {i}") for i in range(10, 17)),
    *((i, " ".join(f"w{j}" for j in range(30)) + f" tail {i}") for i in (20, 21, 22)),
    (23, "\r\n\x0b\x0c odd \x00 bytes \U0001f600 ▁ mark <s> </s>"), (24, "the the the The THE"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, (None if n % 5 == 0 else f"s{n % 3}"), 1, "x", *[n % 4] * 13) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


# --- helpers ------------------------------------------------------------------------


def test_running_total_in_pieces(spark):
    df = spark.range(100).selectExpr("id", "if(id % 3 = 0, NULL, id % 2) AS k", "id div 10 AS piece")
    out = running_total(df, ["k"], "piece", [F.col("id")], total="id").collect()
    for r in out:
        assert r.total == sum(x.id for x in out if x.k == r.k and x.id <= r.id)


@pytest.mark.parametrize("n, universe", [(0, 1), (1, 1), (50, 50), (1000, 1 << 20), (3, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n)) if universe > 50 else np.arange(n)
    asked = np.r_[values, rng.integers(0, universe, 200)]
    with Levels() as levels:
        held = EliasFano(values, universe, levels)
        place, hit = held.successor(asked)
        assert (place == np.searchsorted(values, asked)).all()
        assert (hit == np.isin(asked, values)).all()
        assert (held[np.arange(len(values))] == values).all()


def test_components_of_a_chain(spark):
    links = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b").unionByName(
        spark.createDataFrame([(1000, 900), (950, 900), (7, 7)], "a bigint, b bigint")
    )
    root = {r.node: r.root for r in components.components(links).collect()}
    assert root == {**{i: 0 for i in range(1, 300)}, 1000: 900, 950: 900}


# --- exact dedup ----------------------------------------------------------------------


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out, kept = Counter(), set()
    for body, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for i in ids:
            first = i == keep and body not in kept
            if first:
                kept.add(body)
            out[(i, keep, len(ids), first, sha(body))] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_dedup(odd, sample, digest):
    for docs in (odd, sample):
        got = exact_dedup.exact_dedup(docs, digest, salts=3).drop("digest")
        assert multiset(got) == exact_expected(texts(docs))


def test_exact_dedup_rows(odd):
    out = exact_dedup.keep_one(odd)
    assert out.columns == odd.columns
    assert Counter(lower(t) for _, t in texts(out)) == Counter({lower(t): 1 for _, t in texts(odd)})


# --- line dedup -------------------------------------------------------------------------


def lines_expected(rows, min_chars=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: lower(line.strip(space))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add((i is not None, i or 0))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [
            len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != (i is not None, i or 0) for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[(i, len(lines), sum(gone), kept)] += 1
    return out


@pytest.mark.parametrize("batches, fanout, min_docs", [(4, 2, 5), (1, 3, 2), (5, 2, 1)])
def test_line_dedup(odd, sample, batches, fanout, min_docs):
    for docs in (odd, sample):
        got = line_dedup.dedup_lines(docs, min_docs=min_docs, batches=batches, fanout=fanout)
        assert multiset(got) == lines_expected(texts(docs), min_docs=min_docs)


def test_line_runs_level_up(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.range(10 * i, 10 * i + 15).selectExpr(f"{i} AS doc_id", "id AS h1", "id AS h2"))
    assert [n for _, n in runs.levels] == [1, 0, 1]
    seen = {r.h1: (r.docs, r.last) for r in runs.seen().collect()}
    assert len(seen) == 55 and seen[12] == (2, 1) and seen[54] == (1, 4)
    fresh = runs.unseen(spark.range(50, 60).selectExpr("9 AS doc_id", "id AS h1", "id AS h2"))
    assert {r.h1 for r in fresh.collect()} == set(range(55, 60))
    runs.drop()


# --- chat ---------------------------------------------------------------------------------


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 5, "assistant", "yo"),
        (2, 6, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"),
        (4, 0, "user", "hi"), (5, None, None, None), (6, 0, "user", "x" * 50), (6, 1, "user", "y" * 50),
        (None, 0, "user", "who"), (8, 0, "user", "hi"), (8, 1, "assistant", "other"),
    ]
    logged = spark.createDataFrame(
        [(*r, 0, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int, part int"
    )
    out = chat.format_chats(logged, max_chars=60).collect()
    whole = defaultdict(str)
    for r in sorted(out, key=lambda r: r.part):
        whole[r.conv_id] += r.text
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert dict(whole) == {
        2: turn("user", "hi") + turn("assistant", "yo") + turn("user", "more"),
        5: turn("", ""), 6: turn("user", "x" * 50) + turn("user", "y" * 50), None: turn("user", "who"),
        8: turn("user", "hi") + turn("assistant", "other"),
    }
    assert {r.part for r in out if r.conv_id == 6} == {0, 1}
    assert chat.format_chats(logged.filter("false")).count() == 0


# --- sentencepiece ------------------------------------------------------------------------


def test_sentencepiece(odd, sample):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=queries.model_path())
    for docs in (odd, sample):
        got = multiset(sentencepiece.encode_documents(docs, queries.model_path()))
        expected = Counter()
        for i, t in texts(docs):
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            expected[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids)))] += 1
        assert got == expected


# --- language model -----------------------------------------------------------------------


def model_expected(rows, discount=lm.DISCOUNT):
    tokens = [[w.lower() for w in words(t)] + ["end"] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two, contexts = Counter(), Counter(), Counter()
    for ts, out in zip(tokens, held):
        if not out:
            one.update(ts)
            two.update(zip([None, *ts], ts))
            contexts.update([None, *ts[:-1]])
    after = Counter(h for h, _ in two)
    total, kinds = sum(one.values()), len(one)
    rows_out = {}
    for n, ((i, _), ts, out) in enumerate(zip(rows, tokens, held)):
        base = [(one[t] + 0.5) / (total + 0.5 * (kinds + 1)) for t in ts]
        score = sum(
            math.log10(max(two[h, t] - discount, 0) / contexts[h] + discount * after[h] / contexts[h] * b)
            if contexts[h] else math.log10(b)
            for h, t, b in zip([None, *ts], ts, base)
        )
        rows_out[n] = (i, out, len(ts), sum(one[t] > 0 for t in ts), total, sum(map(math.log10, base)), score)
    return sorted(rows_out.values(), key=repr)


def test_lm_scores(odd, sample, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 50)  # frequent contexts in several slices
    for docs in (odd, sample):
        got = sorted((tuple(r) for r in lm.score(docs).collect()), key=repr)
        expected = model_expected(texts(docs))
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        for g, e in zip(got, expected):
            assert g[5] == pytest.approx(e[5], rel=1e-9)
            # Probabilities are quantised to 255 values.
            assert g[6] == pytest.approx(e[6], rel=0.02, abs=0.05)


def test_packed_words(spark):
    """Words are what white space of ASCII leaves, whatever else a text has; numbers of
    words go by first place."""
    every = "".join(map(chr, range(256)))
    rows = [(1, every), (None, None), (3, ""), (4, "  Éa\x0b\x0cB\r\n b\x1cb\x85 "), (5, "B b\x00 B É"), (6, " "), (7, every)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for lowered in (False, True):
        found = []
        for batch in blocks.pack(docs, lower=lowered).toArrow().to_batches():
            for row in range(batch.num_rows):
                block = blocks.unpack(batch, row)
                assert list(dict.fromkeys(block.tokens.tolist())) == list(range(len(block.words)))
                of_block = [block.words[t] for t in block.tokens]
                cuts = itertools.pairwise([0, *block.ends.tolist()])
                found += [(None if i == NO_ID else i, of_block[a:b]) for i, (a, b) in zip(block.ids.tolist(), cuts)]
        assert found == [(i, words(lower(t) if lowered else t)) for i, t in rows]


def test_words_are_looked_up_in_packed_rows(spark):
    """A block asks each part of the vocabulary once; odd words and words without a row."""
    texts_ = ["a b \u00e9t\u00e9 a \U0001f600", None, "", "c a \x00 zz " + "w " * 50, "b", " ".join(f"w{i}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string").repartition(3)
    packed = blocks.pack(docs, lower=False).localCheckpoint()
    known = {w: (n, n * n + (1 << 33)) for n, w in enumerate(["a", "\u00e9t\u00e9", "\U0001f600", "\x00", "b", "x", *(f"w{i}" for i in range(0, 3000, 2))])}
    words_ = spark.createDataFrame([(w, *x) for w, x in known.items()], "word string, id bigint, c bigint")
    parts = 7
    rows = blocks.answered(packed, blocks.looked_up(packed, words_, parts)).toArrow()
    seen = set()
    for row, batch in enumerate(rows.to_batches(max_chunksize=1)):
        block = blocks.unpack(batch, 0)
        found = batch.column(5)[0]
        assert len(found.as_py() or ()) <= parts
        ids, counts = blocks.of_words(block.words, found, parts)
        got = [None if i < 0 else (i, c) for i, c in zip(ids.tolist(), counts.tolist())]
        assert got == [known.get(w.decode()) for w in block.words]
        seen.update(block.words)
    assert len(seen) > 3000
    assert blocks.looked_up(packed.filter("false"), words_, parts).count() == 0
    assert blocks.looked_up(packed, words_.filter("false"), parts).count() == packed.filter("length(words) > 0").count()


def test_batches_of_blocks_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(20, numPartitions=1).selectExpr("id", "repeat('x', 3000000) AS word")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(key, None)
    with small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 20 and max(got) <= 4
    assert spark.conf.get(key, None) == before


def test_pairs_of_a_shard_need_bounded_memory():
    """What a shard is asked is not held several times over."""
    import tracemalloc

    rng = np.random.default_rng(4)
    sizes, rows = lm.Sizes(10**8, 10**6, 10**5, 0, 1, 1), []
    for b in range(60):
        contexts = np.unique(rng.integers(0, 10**6, 5_000)).astype(np.uint64)
        held = np.full(len(contexts), 4, np.uint32)
        asked = rng.integers(0, 10**6, 4 * len(contexts)).astype(np.uint64)
        train = rng.integers(0, 3, len(asked)).astype(np.uint32)
        totals = contexts % np.uint64(50) + np.uint64(20)
        rows.append((0, b, *map(blocks.planes, (contexts, totals, held, asked, train))))
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), lm._ASK.types)], schema=lm._ASK)
    tracemalloc.start()
    out = lm._answer(sizes, lm.DISCOUNT)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 60
    assert peak < 90 << 20


# --- simhash ------------------------------------------------------------------------------


def fingerprint(text):
    ws = [w.lower() for w in words(text)]
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return Counter((i, f"{f:016x}", least.get(find(n))) for n, ((i, _), f) in enumerate(zip(rows, fps)))


def test_near_dedup(odd, sample):
    for docs in (odd, sample):
        got = simhash.near_dedup(docs).select("doc_id", "fingerprint", "component_id")
        assert multiset(got) == near_expected(texts(docs))
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.keep_one(sample).count() == len({c for _, _, c in near_expected(texts(sample))})


def test_near_links_in_small_pages(spark, monkeypatch):
    """Clusters over many pages and chunks connect as all pairs would."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)) for c in centres for _ in range(60)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "PAGE", 8)
    monkeypatch.setattr(simhash, "CHUNK", 40)
    links = list(simhash._index_partition(_sorted_rows(spark, signed), 4))
    found = _pairs_of_pages(links)
    label = {f: f for f in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        assert (a ^ b) & ((1 << 64) - 1) != 0
        label[find(a)] = find(b)
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 4:
                assert find(signed[i]) == find(signed[j])


def test_rest_of_a_bucket_wider_than_a_chunk(monkeypatch):
    """In a single table ``t``, the few rows of a bucket left after its chunk still meet its other pages."""
    monkeypatch.setattr(simhash, "PAGE", 8)
    monkeypatch.setattr(simhash, "CHUNK", 40)
    flips = [1 << i | 1 << j for i in range(12) for j in range(i)]
    sizes = {0: 10, 1: 43, 2: 60}
    rows = [(key, (key << 40) ^ flips[n]) for key, size in sizes.items() for n in range(size)]
    for batch_size in (1, 7, 10, 17):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([0] * len(x), pa.int32()), pa.array([k for k, _ in x]), pa.array([f for _, f in x])],
                names=["t", "key", "fp"],
            )
            for x in (rows[i : i + batch_size] for i in range(0, len(rows), batch_size))
        ]
        label = {f: f for _, f in rows}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in _pairs_of_pages(list(simhash._index_partition(iter(batches), 4))):
            label[find(a)] = find(b)
        for key in sizes:
            assert len({find(f) for k, f in rows if k == key}) == 1, (batch_size, key)


def _sorted_rows(spark, signed):
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    rows = simhash.bucketed(frame, 4).withColumn("rank", simhash.gray_rank(F.col("fp")))
    table = rows.orderBy("t", "key", "rank").select("t", "key", "fp").toArrow()
    return table.combine_chunks().to_batches(max_chunksize=17)


def _pairs_of_pages(batches):
    found, pages = [], defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            if r["fps"] is None:
                found.append((r["a"], r["b"]))
            else:
                pages[r["t"], r["key"]].append(np.frombuffer(r["fps"], np.uint64))
    for group in pages.values():
        for i, one in enumerate(group):
            for two in group[:i]:
                a, b = simhash._cross_links(one, two, 4)
                found += list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))
    return found


# --- substring dedup ----------------------------------------------------------------------


def substrings_expected(rows, window=13):
    first = {}
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = Counter()
    for i, t in rows:
        ws = words(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        out[(i, len(ws), sum(gone), sha(b" ".join(w for w, g in zip(ws, gone) if not g)))] += 1
    return out


def test_substring_dedup(odd, sample, monkeypatch):
    monkeypatch.setattr(substring, "TASK_WORDS", 200)
    for docs in (odd, sample):
        assert multiset(substring.dedup_substrings(docs)) == substrings_expected(texts(docs))


def test_automaton_matches():
    automaton = substring.Automaton()
    automaton.add(list("abcabdabc"), 5)
    automaton.add(list("bcabd"), 3)
    automaton.add(list("xbcabdy"), 9)
    automaton.finish()
    assert automaton.matches(list("zbcabdabz"), 3, 4) == [4, 5, 6]
    assert automaton.matches(list("zbcabdabz"), 3, 6) == [4, 5, 6, 7, 8]
    assert automaton.matches(list("abc"), 3, 5) == []


# --- search -------------------------------------------------------------------------------


def search_expected(rows, asked, k=10):
    tf = [Counter(w.lower() for w in words(t)) for _, t in rows]
    size = [sum(c.values()) for c in tf]
    mean = sum(size) / len(rows)
    df = Counter(w for c in tf for w in c)
    out = Counter()
    for q, t in asked:
        query = Counter(w.lower() for w in words(t))
        scored = []
        for (i, _), c, n in zip(rows, tf, size):
            s = sum(
                m * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean))
                for w, m in query.items() if w in c
            )
            if s > 0:
                scored.append((-round(s, 6), i is not None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[(q, rank, i, -s)] += 1
    return out


def test_search(odd, sample, monkeypatch):
    monkeypatch.setattr(search, "DOC_BLOCK", 4)
    monkeypatch.setattr(search, "GROUP", 1)
    for docs, asked in ((odd, odd), (sample, sample.filter("doc_id % 20 = 0"))):
        got = search.search(docs, asked).withColumn("score", F.round("score", 6))
        assert multiset(got) == search_expected(texts(docs), texts(asked))


def test_small_query_blocks_share_a_round(spark, odd, monkeypatch):
    """Shards are sent once for each round, so query blocks of a few words are no rounds
    of their own; when queries need several rounds, results are the same."""
    rounds = []
    sequence = F.sequence
    monkeypatch.setattr(search.F, "sequence", lambda a, b: rounds.append(b) or sequence(a, b))
    asked = odd.filter("doc_id <> 8").repartition(40)
    got = search.search(odd, asked).withColumn("score", F.round("score", 6))
    assert multiset(got) == search_expected(texts(odd), texts(asked))
    assert str(rounds[0]) == str(F.lit(0))
    monkeypatch.setattr(search, "BLOCK_WORDS", 20)
    monkeypatch.setattr(search, "FIRST", 0)
    again = search.search(odd, asked).withColumn("score", F.round("score", 6))
    assert str(rounds[2]) != str(F.lit(0))
    assert multiset(again) == multiset(got)


def test_groups_find_few_rows(spark, monkeypatch):
    """Groups know the score that a query has reached in the waves before: what they find
    does not grow with their number. Of copies, those with the smallest ids are found."""
    rng = np.random.default_rng(5)
    chance = 1 / np.arange(1, 301)
    texts_of = [" ".join(f"w{w}" for w in rng.choice(300, n, p=chance / chance.sum())) for n in rng.integers(5, 60, 1280)]
    rows = [(i, texts_of[7 if i % 9 == 4 else i]) for i in range(1280)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(32, "doc_id")
    asked = docs.filter("doc_id % 40 = 0 OR doc_id = 13").coalesce(1)
    found = spark.sparkContext.accumulator(0)
    make = search._search

    def counted(*settings):
        work = make(*settings)

        def count(shards, queries):
            result = work(shards, queries)
            found.add(result.num_rows)
            return result

        return count

    monkeypatch.setattr(search, "_search", counted)
    monkeypatch.setattr(search, "GROUP", 1)
    monkeypatch.setattr(search, "DOC_BLOCK", 8)
    got = search.search(docs, asked).withColumn("score", F.round("score", 6))
    assert multiset(got) == search_expected(rows, texts(asked))
    assert found.value < 33 * search.K * 10


def test_an_index_is_made_once_for_many_query_words(spark, monkeypatch):
    """Twelve blocks' worth of query words meet an index in one round; queries that are
    answered some at a time, in any order, have the same results."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, 30) % 90)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6, "doc_id")
    asked = docs.filter("doc_id % 2 = 0").repartition(16, "doc_id")
    made = spark.sparkContext.accumulator(0)
    make = search._search

    def counted(*settings):
        work = make(*settings)

        def count(shards, queries):
            made.add(int(shards.num_rows > 0 and queries.num_rows > 0))
            return work(shards, queries)

        return count

    monkeypatch.setattr(search, "_search", counted)
    monkeypatch.setattr(search, "BLOCK_WORDS", 200)  # for 2400 query words
    want = search_expected(rows, texts(asked))
    assert multiset(search.search(docs, asked).withColumn("score", F.round("score", 6))) == want
    assert made.value == 1
    monkeypatch.setattr(search, "AT_ONCE", 100)
    monkeypatch.setattr(search, "DOC_BLOCK", 8)
    assert multiset(search.search(docs, asked).withColumn("score", F.round("score", 6))) == want


def test_an_index_takes_little_memory():
    """Groups are as large as their indexes allow: what an index takes while it is made."""
    rng = np.random.default_rng(9)
    rows, entries = [], 0
    for shard in range(4):
        n, terms = 500, np.sort(rng.choice(20_000, 5_000, replace=False))
        held = rng.integers(1, 40, len(terms))
        docs = np.concatenate([np.sort(rng.choice(n, h, replace=False)) for h in held])
        arrays = {
            "ids": np.arange(n) + n * shard, "lengths": np.bincount(docs, minlength=n) * 2, "tops": rng.integers(0, 9, n),
            "terms": terms, "frequency": held * 4, "held": held.astype(np.uint32), "docs": docs.astype(np.uint32),
            "counts": np.full(len(docs), 2, np.uint32),
        }
        rows.append({"shard": shard} | {name: blocks.squeeze(a) for name, a in arrays.items()})
        entries += len(docs)
    search.Index(rows, 8_000, 400.0)
    tracemalloc.start()
    index = search.Index(rows, 8_000, 400.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.ids) == 2_000 and peak < 60 * entries


def test_search_in_empty_texts(spark):
    """A shard without a term, a query without a word."""
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id bigint, text string").coalesce(1)
    both = docs.union(spark.createDataFrame([(4, "a b")], "doc_id bigint, text string"))
    assert search.search(docs, both).count() == 0
    assert [r.doc_id for r in search.search(both, both).collect()] == [4]


def test_squeezed_numbers():
    for values in (np.zeros(0, np.int64), np.arange(-5, 2000), np.array([NO_ID, 7, -1]), np.arange(9, dtype=np.uint32)):
        raw = blocks.squeeze(values)
        assert blocks.unsqueeze(raw, values.dtype).tolist() == values.tolist()
    assert len(blocks.squeeze(np.arange(1 << 16) % 100)) < 1 << 17


# --- mixing ---------------------------------------------------------------------------------


def fill(sizes, weights, copies):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, got = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if got[s] + weight[s] * level >= copies * sizes[s]}
        for s in full or open_:
            take = copies * sizes[s] - got[s] if full else weight[s] * level
            got[s] += take
            left -= take
        open_ -= full if full else open_
    return got


def test_mixing(odd, sample):
    for docs in (odd, sample):
        rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(words(t))
        target = fill(sizes, mixing.WEIGHTS, 3)
        out = mixing.allot(docs).collect()
        assert Counter((r.doc_id, r.size, r.source) for r in out) == Counter((i, len(words(t)), s) for i, t, s in rows)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in out:
            assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
            assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(target[r.source]))
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 1.5 * largest[s]
        again = mixing.allot(docs.repartition(3))
        assert multiset(again) == Counter(tuple(r) for r in out)
        whole = mixing.mixed(docs)
        assert whole.columns == docs.columns
        assert sum(len(words(t)) for _, t in texts(whole)) == sum(taken.values())


def test_targets_share_what_is_over(spark):
    sizes = {f"s{i}": n for i, n in enumerate([10, 1000, 5, 0, 2000, 30, 7])} | {None: 400}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(frame, mixing.WEIGHTS, 3).collect()}
    assert got == pytest.approx(fill(sizes, mixing.WEIGHTS, 3))


# --- quality --------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    """Junk goes and clean documents stay, of labels that the models have not seen."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(10)) < 7
    out = quality.resample(docs, labels.filter(known))
    rates = {
        (r.quality, r.toxic): r.kept
        for r in out.join(labels.filter(~known), "doc_id")
        .groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    }
    assert rates[1, 0] > 0.9
    assert rates[0, 0] < 0.05


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (10, 1, 0), (None, 1, 0), (11, None, 1), (8, 0, 0), (8, 1, 0), (24, 1, 1), (24, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    out = quality.resample(odd, labels)
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in texts(odd))
    assert multiset(out) == multiset(quality.resample(odd.repartition(2), labels))
    assert quality.resample(odd, labels.filter("false")).filter("kept").count() == odd.count()
    assert quality.resample(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
    sample = {r.doc_id: r["class"] for r in quality.label_sample(labels).collect()}
    assert sample == {1: 0, 10: 0, 8: 1, 24: 2}
    assert quality.label_sample(labels, 2).count() == 2


@pytest.mark.parametrize("k", [0, 1, 37, 999, 1000, 5000])
def test_kth_largest(spark, k):
    df = spark.range(1000).selectExpr("CAST(pow(id % 500, 3) AS DOUBLE) AS x")
    got = quality.kth_largest(df, "x", k, bins=7, few=3)
    values = sorted((float((i % 500) ** 3) for i in range(1000)), reverse=True)
    assert got == (values[min(k, 1000) - 1] if k else None)


# --- empty tables, pipeline, queries ----------------------------------------------------------


def test_empty_tables(none):
    frames = [
        exact_dedup.exact_dedup(none), exact_dedup.keep_one(none), line_dedup.dedup_lines(none),
        sentencepiece.encode_documents(none, queries.model_path()), lm.score(none), simhash.near_dedup(none),
        simhash.keep_one(none), substring.dedup_substrings(none), search.search(none, none),
        mixing.allot(none), mixing.mixed(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark, sample):
    """Every stage does to what it gets as the brute-force versions say."""
    docs, held = sample, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SAMPLE)
        if name != "encoding":
            assert out.columns == sample.columns
        held.append((name, docs, out))
        docs = out
    by = {name: (texts(before), after) for name, before, after in held}
    before, after = by["exact_dedup"]
    assert Counter(i for i, _ in texts(after)) == Counter(
        i for (i, _, _, kept, _), n in exact_expected(before).items() if kept for _ in range(n)
    )
    before, after = by["near_dedup"]
    assert Counter(i for i, _ in texts(after)) == Counter({c for _, _, c in near_expected(before)})
    before, after = by["mixing"]
    assert max(Counter(texts(after)).values()) <= 3
    before, after = by["encoding"]
    assert Counter(r.doc_id for r in after.collect()) == Counter(i for i, _ in before)
    assert {r.decoded for r in after.collect()} == {t for _, t in before}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SAMPLE}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SAMPLE)
    found = connection.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert multiset(got.select(*names)) == Counter(found.fetchall())


def test_dense_pages_need_bounded_memory():
    """Of a chunk of pages whose rows are all near each other, a few are open at a time."""
    import tracemalloc

    rng = np.random.default_rng(8)
    pages = 24
    centres = rng.integers(0, 1 << 63, pages, np.uint64)
    pairs = [(i, j) for i in range(64) for j in range(i)]
    flips = np.array([0] + [1 << i | 1 << j for i, j in pairs[: simhash.PAGE - 1]], np.uint64)
    fps = np.concatenate([np.sort(c ^ flips) for c in centres])
    page = np.repeat(np.arange(pages), simhash.PAGE)
    tracemalloc.start()
    a, b = simhash._page_links(page, fps, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 << 20
    assert len(a) == len(fps) - pages and set(b.tolist()) <= {int(x[0]) for x in np.split(fps, pages)}
