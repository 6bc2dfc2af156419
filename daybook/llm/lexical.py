"""Ranked lexical search, term at a time with limited accumulators.

Every task packs its documents into shards: an inverted index of the terms that any
item asks for, with the number of terms of each document. Counts over all shards give
the statistics of the collection. Each shard then answers all items: terms are
taken rarest first, a posting opens an accumulator for its document, and once the terms
left cannot lift a new document to the score of the k-th accumulator, no more are opened
and only those that exist are brought up to their exact score. The best of all shards
are merged.

Items are searched in rounds whose terms have a bounded size, so what goes to all tasks
does not grow with the items; a round costs two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.blocks import NO_ID, from_planes, id_array, planes
from daybook.llm.common import store, word_lists

TOP = 10
# Scale of the term weights, of the impact, and the saturation of term frequencies.
WEIGHT_SCALE, IMPACT_SCALE, K_ONE_SCALED, K_ONE_PART = 1000, 1_000_000_000, 1000, 8
# Length normalisation: this many hundredths follow the length.
LENGTH_PERCENT = 90
# Words in a shard, and documents: a shard is one row and one inverted index in memory.
SHARD_WORDS, SHARD_DOCS = 4_000_000, 50_000
# Bytes of the terms of the items that are searched at once.
ROUND_BYTES = 8 << 20


# --- items ----------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` (binary), each pair once."""

    def work(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {word for words in word_lists(text.as_py() or b"") for word in words}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found), pa.int64()), pa.array(sorted(found), pa.binary())],
                    names=["item_id", "term"],
                )

    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
    return rows.mapInArrow(work, "item_id bigint, term binary").distinct()


def rounds(terms: DataFrame, round_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items, with their terms, in rounds of some ``round_bytes``."""
    total = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    number = -(-total // round_bytes)
    dealt = F.pmod(F.xxhash64(F.col("item_id")), F.lit(max(number, 1)))
    for n in range(number):
        rows = terms.filter(dealt == n).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        some = [(r.item_id, [bytes(t) for t in r.terms]) for r in rows.collect()]
        if some:
            yield some


# --- index ----------------------------------------------------------------------------


SHARD_DDL = (
    "n_docs bigint, n_terms bigint, ids binary, sizes binary, held binary, cuts binary, postings binary,"
    " times binary"
)


def _packed(ids: list, sizes: list, found: list[np.ndarray]) -> pa.RecordBatch:
    """One shard: ``held`` lists the terms, ``cuts`` the ends of their postings."""
    size = np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(ids)), [len(f) for f in found])
    key, times = np.unique(np.concatenate(found).astype(np.int64) * len(ids) + doc, return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    held, cuts = np.unique(term, return_index=True)
    columns = (
        np.array([NO_ID if i is None else i for i in ids], np.int64), size, held, np.r_[cuts[1:], len(key)],
        doc.astype(np.uint32), times.astype(np.uint32),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())]
        + [pa.array([planes(c)], pa.binary()) for c in columns],
        names=["n_docs", "n_terms", "ids", "sizes", "held", "cuts", "postings", "times"],
    )


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs``: postings of the terms in ``vocabulary``, length of each document."""

    def work(batches):
        ids: list[int | None] = []
        sizes: list[int] = []
        found: list[np.ndarray] = []
        words = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size, parts = 0, [np.zeros(0, np.int32)]
                for some in word_lists(text.as_py() or b""):
                    number = np.fromiter(map(vocabulary.get, some, repeat(-1)), np.int32, len(some))
                    parts.append(number[number >= 0])
                    size += len(some)
                ids.append(doc)
                sizes.append(size)
                found.append(np.concatenate(parts))
                words += size
                if words >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                    yield _packed(ids, sizes, found)
                    ids, sizes, found, words = [], [], [], 0
        if ids:
            yield _packed(ids, sizes, found)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(work, SHARD_DDL)


def _document_counts(shards: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each of the ``terms`` numbered terms."""

    def work(batches):
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            for held, cuts in zip(batch.column(0), batch.column(1)):
                counts[from_planes(held.as_py(), np.int64)] += np.diff(from_planes(cuts.as_py(), np.int64), prepend=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    rows = shards.select("held", "cuts").mapInArrow(work, "term bigint, n bigint")
    counts = np.zeros(terms, np.int64)
    for row in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row.term] = row.n
    return counts


# --- search ---------------------------------------------------------------------------


class Shard:
    """The inverted index of one shard with the impact of every posting."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = from_planes(row["ids"], np.int64)
        sizes = from_planes(row["sizes"], np.int64)
        self.held = from_planes(row["held"], np.int64)
        ends = from_planes(row["cuts"], np.int64)
        self.start, self.end = np.r_[0, ends[:-1]] if len(ends) else ends, ends
        self.docs = from_planes(row["postings"], np.uint32).astype(np.int64)
        times = from_planes(row["times"], np.uint32).astype(np.int64)
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * sizes * n_docs) // max(n_terms, 1)
        self.impact = (IMPACT_SCALE * times) // (K_ONE_SCALED * times + K_ONE_PART * m[self.docs])
        self.best = np.maximum.reduceat(self.impact, self.start) if len(ends) else ends
        self.total = np.zeros(len(self.ids), np.int64)
        self.read = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best documents for a set of terms, best first."""
        place = np.searchsorted(self.held, terms)
        known = place < len(self.held)
        known[known] = self.held[place[known]] == terms[known]
        place, weight = place[known], weights[terms[known]]
        rarest = np.lexsort((place, self.end[place] - self.start[place]))
        place, weight = place[rarest], weight[rarest]
        bound = weight * self.best[place]
        left = np.cumsum(bound[::-1])[::-1] - bound
        total = self.total
        opened = np.zeros(len(total), bool)
        opening = True
        for at, w, rest in zip(place, weight, left):
            docs, gain = self.docs[self.start[at] : self.end[at]], self.impact[self.start[at] : self.end[at]]
            if not opening:
                old = opened[docs]
                docs, gain = docs[old], gain[old]
            total[docs] += w * gain
            if opening:
                opened[docs] = True
                self.read += len(docs)
                # A document without an accumulator can still reach ``rest``.
                held = total[opened]
                opening = len(held) < k or rest >= np.partition(held, len(held) - k)[len(held) - k]
        some = np.flatnonzero(opened)
        score = total[some]
        total[some] = 0
        some, score = some[score > 0], score[score > 0]
        if len(score) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            some, score = some[near], score[near]
        order = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some[order]], score[order]


def _search(items: list, terms: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                found = [shard.search(t, weights, k) for t in terms]
                sizes = [len(ids) for ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, n in zip(items, sizes) for _ in range(n)], pa.int64()),
                        id_array(np.concatenate([ids for ids, _ in found])),
                        pa.array(np.concatenate([score for _, score in found])),
                    ],
                    names=["item_id", "doc_id", "score"],
                )

    return work


def search(docs: DataFrame, items: DataFrame, k: int = TOP, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    * Equal scores go by the smaller id, a NULL id first. Documents of score 0 are
      not found, so an item without terms, or with none that a document has, has no row.
    * NULL and empty texts have no terms and are no part of the statistics.
    * Rows of ``docs`` that repeat an id are documents of their own; rows of ``items`` that
      repeat an id, NULL among them, are one item with the terms of all.
    * Empty tables give an empty result. Only the id and the text are read.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for some in rounds(store(item_terms(items), "item_terms"), round_bytes):
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in some for t in terms}))}
        shards = store(index(docs, vocabulary), "shards", compression="zstd")
        counted = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = counted[0] or 0, counted[1] or 0
        df = _document_counts(shards, len(vocabulary))
        weights = np.array(
            [math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64
        )
        numbers = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in some]
        work = _search([i for i, _ in some], numbers, weights, n_docs, n_terms, k)
        found = found.unionByName(
            shards.drop("n_docs", "n_terms").mapInArrow(work, "item_id bigint, doc_id bigint, score bigint")
        )
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
