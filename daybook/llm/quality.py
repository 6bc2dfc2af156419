"""Quality classifier by importance resampling of hashed n-grams.

Three generative models are counted over hashed n-grams of labelled documents:
good ones (the target), junk and toxic ones. Words count once in a document, pairs
of words and pairs of word shapes each time. Raw text is a mixture of the three in
the labels' proportions. The importance of a document is the ratio of its
probability as target text to its probability as raw text; the sample is the top k
of log importance plus Gumbel noise, which draws without replacement in proportion
to importance. By default k is the number of documents that are target text more
likely than not.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.blocks import distinct
from daybook.llm.common import pick_rows, row_digest, store

CLASSES = ("good", "junk", "toxic")
# Buckets of words, of pairs of words, and of pairs of word shapes.
WORDS, PAIRS, SHAPES = 1 << 18, 1 << 12, 1 << 12
FAMILIES = (slice(0, WORDS), slice(WORDS, WORDS + PAIRS), slice(WORDS + PAIRS, WORDS + PAIRS + SHAPES))
BUCKETS = WORDS + PAIRS + SHAPES
# Labelled documents that the models are counted over at most.
MAX_LABELLED = 20_000
# Added to counts and expected counts. A class differs from the mixture in a bucket
# only where its count is this many standard deviations off.
SMOOTHING = 5.0
DEVIATIONS = 7.0
# Log importance is divided by this before noise is added: at 1 the sample draws in
# proportion to importance, below it prefers the important more.
TEMPERATURE = 0.1
SEED = 0
# Words hashed at a time; words remembered by a worker.
CHUNK = 500_000
MEMORY = 1_000_000

_SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(
        97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        for c in range(256)
    ),
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL).sub


class _Words(dict):
    """Word to its hash and, above 32 bits, the hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        shape = crc32(_RUN(rb"\1", word.translate(_SHAPE)))
        code = self[word] = crc32(word) | (shape & 0x7FFFFFFF) << 32
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of consecutive documents, and each one's document."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    word = codes & np.uint64(0xFFFFFFFF)
    shape = codes >> np.uint64(32)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    first, second = word[inner], word[inner + 1]
    # A word said again is one n-gram, whichever the word.
    pair = np.where(first == second, np.uint64(1), _mix(first * np.uint64(31) + second))
    kinds = _mix(shape[inner] * np.uint64(31) + shape[inner + 1])
    once = distinct(doc * WORDS + (_mix(word) % np.uint64(WORDS)).astype(np.int64))
    found = np.concatenate([
        once % WORDS,
        WORDS + (pair % np.uint64(PAIRS)).astype(np.int64),
        WORDS + PAIRS + (kinds % np.uint64(SHAPES)).astype(np.int64),
    ])
    return found, np.concatenate([once // WORDS, doc[inner], doc[inner]])


def _chunks(texts):
    """(codes, starts) of consecutive documents with some ``CHUNK`` words. Documents
    are not cut. The words remembered go with the task."""
    words = _Words()
    codes: list[int] = []
    starts = [0]
    for text in texts:
        codes += map(words.__getitem__, (text.as_py() or "").encode().split())
        starts.append(len(codes))
        if len(codes) >= CHUNK:
            yield np.array(codes, np.uint64), np.array(starts)
            codes, starts = [], [0]
    yield np.array(codes, np.uint64), np.array(starts)


def label_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, class`` of at most ``limit`` labelled documents, drawn by hash.

    Toxic goes before junk where labels of a document differ; labels without an id
    or a value do not count.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    each = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    kind = F.when(F.col("toxic") > 0, 2).when(F.col("quality") < 1, 1).otherwise(0)
    drawn = each.select("doc_id", kind.alias("class")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
    return drawn.limit(limit)


def first_copies(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample with one document of most groups of near copies: in a class, those
    with the same least hash of a pair of words. Copies of one document would make
    its chance words look telling."""

    def work(batches):
        for batch in batches:
            least = []
            for codes, starts in _chunks(batch.column(2)):
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                word = codes & np.uint64(0xFFFFFFFF)
                inner = np.flatnonzero(doc[1:] == doc[:-1])
                pair = _mix(_mix(word[inner] * np.uint64(31) + word[inner + 1]) + np.uint64(5))
                keys = np.zeros(len(starts) - 1, np.uint64)
                new = np.flatnonzero(np.r_[True, doc[inner][1:] != doc[inner][:-1]]) if len(inner) else inner
                if len(new):
                    keys[doc[inner][new]] = np.minimum.reduceat(pair, new)
                least.append(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(least).view(np.int64))],
                names=["doc_id", "class", "key"],
            )

    # Other columns of the documents may be called like the sample's.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "class", "text")
    keyed = labelled.mapInArrow(work, "doc_id bigint, class int, key bigint")
    return keyed.groupBy("class", "key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "class")


def count_ngrams(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``class, bucket, n`` over the texts of the sampled documents, and in bucket -1
    the number of documents."""

    def work(batches):
        counts = np.zeros((len(CLASSES), BUCKETS), np.int64)
        documents = np.zeros(len(CLASSES), np.int64)
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            at = 0
            for codes, starts in _chunks(batch.column(1)):
                found, doc = _features(codes, starts)
                kind = kinds[at : at + len(starts) - 1]
                at += len(starts) - 1
                flat = kind[doc].astype(np.int64) * BUCKETS + found
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
                documents += np.bincount(kind, minlength=len(CLASSES))
        kind, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[kind, np.arange(len(CLASSES))].astype(np.int32)),
            pa.array(np.r_[bucket, np.full(len(CLASSES), -1)].astype(np.int32)),
            pa.array(np.r_[counts[kind, bucket], documents]),
        ], names=["class", "bucket", "n"])

    # The sample is bounded by MAX_LABELLED rows of an id and a class.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("class", "text")
    counted = labelled.mapInArrow(work, "class int, bucket int, n bigint")
    return counted.groupBy("class", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each bucket to the mixture, and log share, of the classes.

    The model has ``len(CLASSES) * BUCKETS`` numbers whatever the input, and so have
    the counts that the driver gets.
    """
    counts = np.zeros((len(CLASSES), BUCKETS))
    documents = np.zeros(len(CLASSES))
    sample = store(first_copies(docs, label_sample(labels, limit)), "sample")
    found = count_ngrams(docs, sample).toArrow()
    kind, bucket, n = (found.column(c).to_numpy() for c in ("class", "bucket", "n"))
    documents[kind[bucket < 0]] = n[bucket < 0]
    counts[kind[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    logs = np.zeros_like(counts)
    for part in FAMILIES:
        mine = counts[:, part]
        expected = mine.sum(1, keepdims=True) * (mine.sum(0) / max(mine.sum(), 1))
        telling = np.abs(mine - expected) > DEVIATIONS * np.sqrt(expected + 1)
        logs[:, part] = np.where(telling, np.log((mine + SMOOTHING) / (expected + SMOOTHING)), 0)
    with np.errstate(divide="ignore"):
        shares = np.log(documents / max(documents.sum(), 1))
    return logs, shares


def weigh(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], seed: int = SEED) -> DataFrame:
    """``doc_id, digest, log_weight, p_good, sample_key`` of every row."""
    table, shares = model
    usable = bool(np.isfinite(shares[0]))
    context = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def work(batches):
        logs = context.value
        for batch in batches:
            weights = []
            for codes, starts in _chunks(batch.column(2)):
                found, doc = _features(codes, starts)
                n = len(starts) - 1
                each = np.stack([np.bincount(doc, logs[found, c], n) for c in range(len(CLASSES))])
                if usable:
                    raw = np.logaddexp.reduce(each + shares[:, None], axis=0)
                    weights.append(each[0] - raw)
                else:  # no target is known: nothing is preferred
                    weights.append(np.zeros(n))
            weight = np.concatenate(weights)
            good = np.exp(weight + shares[0]) if usable else np.ones(len(weight))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weight), pa.array(np.minimum(good, 1.0))],
                names=["doc_id", "digest", "log_weight", "p_good"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), row_digest(docs).alias("digest"), "text")
    scored = rows.mapInArrow(work, "doc_id bigint, digest bigint, log_weight double, p_good double")
    # Uniform in (0, 1) from the row itself, so that a rerun draws alike.
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "digest", "doc_id"), 12) + 0.5) / float(1 << 52)
    return scored.withColumn("sample_key", F.col("log_weight") / TEMPERATURE - F.log(-F.log(draw)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1000, few: int = 10_000) -> float | None:
    """The k-th largest value of a column without NULL or NaN; NULL where k is 0.

    Counts by bins narrow the range until few rows or one value are left, so that
    no task and no driver sees the rows in order.
    """
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not rows or k < 1:
        return None
    k = min(k, rows)
    while rows > few and low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = df.filter(F.col(column).between(low, high)).groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: -r["bin"]):
            if k <= row["n"]:
                low, high, rows = row["low"], row["high"], row["n"]
                break
            k -= row["n"]
    if low == high:
        return low
    held = df.filter(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k)
    return held.agg(F.min(column)).first()[0]


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, limit: int = MAX_LABELLED, seed: int = SEED
) -> DataFrame:
    """``doc_id, log_weight, p_good, sample_key, kept, digest`` for every row of ``docs``.

    * ``kept`` marks the ``k`` rows with the largest ``sample_key``, and any that tie
      with the last of them; rows that repeat tie. ``k`` is by default the number of
      rows whose probability of being target text, ``p_good``, is above one half.
    * Models are counted over whole texts of at most ``limit`` labelled documents;
      all documents are weighed by their whole texts. NULL texts have no n-grams.
    * Without labels of good documents every weight is 0 and every row is kept.
    * An empty table gives an empty result; other columns are not looked at.
    """
    scored = store(weigh(docs, fit(docs, labels, limit), seed), "weights")
    if k is None:
        k = scored.filter("p_good > 0.5").count()
    cut = kth_largest(scored, "sample_key", k)
    kept = F.lit(False) if cut is None else F.col("sample_key") >= F.lit(cut)
    return scored.select("doc_id", "log_weight", "p_good", "sample_key", kept.alias("kept"), "digest")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns."""
    return pick_rows(docs, resample(docs, labels).filter("kept"), copies=True)
