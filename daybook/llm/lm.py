"""Language-model scoring with Elias-Fano tries of word pairs.

The model gives a word after a word the probability

    max(c(h w) - d, 0) / c(h)  +  d * n(h) / c(h) * p(w)

with counts c of the training tokens, n(h) the different words seen after h, d the
discount, and p the smoothed single-word probability (c + 0.5) / (N + 0.5 * (V + 1)).
A context that training has not shown gives p(w).

The pairs are dealt by context over shards, a frequent context over several. A
shard is a two-level trie: the contexts, monotone pointers to their successors, the
successors made monotone by an offset for each context, all in Elias-Fano form, and
one quantised probability for each pair, in memory-mapped levels. Documents are
packed in blocks; a block asks each shard once for its different pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.blocks import (
    NO_ID, Block, answered, distinct, from_planes, gather, id_array, in_order, looked_up, numbered, of_words, pack, planes,
    unpack,
)
from daybook.llm.common import Shelf, shuffle_partitions, small_batches, store
from daybook.llm.elias_fano import EliasFano, Levels

DISCOUNT = 0.75
CODES = 255
# Training occurrences of a context for each slice of it, pairs for each shard.
SLICE = 200_000
SHARD_PAIRS = 2_000_000
# The end of a text; no word holds a space.
END = "\n"


def held_out_ids(ids: np.ndarray) -> np.ndarray:
    """Whether crc32 of the id as text leaves 1 when divided by 5; NULL is ""."""
    return np.array([zlib.crc32(b"" if i == NO_ID else b"%d" % i) % 5 == 1 for i in ids.tolist()], bool)


# --- single words -------------------------------------------------------------------


def _dictionary(batches):
    """Words of each block with their training counts; the end under number -1."""
    for batch in batches:
        for row in range(batch.num_rows):
            block = unpack(batch, row)
            train = ~held_out_ids(block.ids)
            counts = np.bincount(block.tokens[train[block.doc_of]], minlength=len(block.words))
            n = len(block.words)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n + 1, block.block_id)),
                pa.array(np.r_[np.arange(n), -1].astype(np.int32)),
                pa.array([*(w.decode() for w in block.words), END], pa.string()),
                pa.array(np.r_[counts, train.sum()].astype(np.int64)),
            ], names=["block_id", "number", "word", "n"])


def vocabulary(entries: DataFrame) -> DataFrame:
    """``word, id, c`` of the words of the training tokens, ids dense from 0."""
    counts = entries.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")

    def number(batches):
        from daybook.llm.blocks import task_numbers

        numbers = task_numbers()
        for batch in batches:
            given = [next(numbers) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g >> 32 for g in given], pa.int32()),
                 pa.array([g & 0xFFFFFFFF for g in given], pa.int64())],
                names=["word", "c", "part", "place"],
            )

    numbered = store(counts.mapInArrow(number, "word string, c bigint, part int, place bigint"), "words")
    # One row for each task that counted: small whatever the words.
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = numbered.sparkSession.createDataFrame(starts, "part int, start bigint")
    return numbered.join(F.broadcast(offsets), "part").select(
        "word", (F.col("place") + F.col("start")).alias("id"), "c"
    )


# --- pairs ----------------------------------------------------------------------------


class Sizes:
    """What every task knows of the training tokens."""

    def __init__(self, tokens: int, words: int, documents: int, end: int, shards: int, parts: int):
        """``end`` is the id of the end of a text, ``parts`` those of the vocabulary."""
        self.tokens, self.words, self.documents, self.end = tokens, words, documents, end
        self.shards, self.parts = shards, parts

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def slices(self, counts: np.ndarray) -> np.ndarray:
        return 1 + counts // SLICE

    def shard(self, context: np.ndarray, part: np.ndarray) -> np.ndarray:
        mixed = (context.astype(np.uint64) * np.uint64(64) + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)


class Pairs:
    """The pairs of a block: tokens with ends as vocabulary ids, contexts, and what is
    asked of each shard. Built alike when asking and when reading the answers."""

    def __init__(self, block: Block, found: pa.ListScalar, sizes: Sizes):
        n = len(block.words)
        ids, counts = of_words(block.words, found, sizes.parts)
        ids, counts = np.r_[ids, sizes.end], np.r_[counts, sizes.documents]
        # Every document is its words and one end, which has the last number.
        self.lengths = np.diff(np.r_[0, block.ends]) + 1
        stops = np.cumsum(self.lengths)
        tokens = np.full(stops[-1] if len(stops) else 0, n, np.int64)
        inner = np.ones(len(tokens), bool)
        inner[stops - 1] = False
        tokens[inner] = block.tokens
        self.starts = stops - self.lengths
        self.doc_of = np.repeat(np.arange(len(block.ids), dtype=np.int32), self.lengths)
        self.held_out = held_out_ids(block.ids)
        self.count = counts[tokens]
        word = ids[tokens]
        del inner, tokens, ids, counts
        # The context of a first word is the start of a text, numbered after all words.
        context = np.r_[np.int64(-1), word[:-1]]
        context[self.starts] = sizes.words
        known = np.r_[np.int64(0), self.count[:-1]]
        known[self.starts] = sizes.documents
        # Tokens after a context that training has; of these, the words it has too.
        self.live = np.flatnonzero((context >= 0) & (known > 0))
        self.contexts, first, self.live_context = numbered(context[self.live])
        self.totals = known[self.live[first]]
        del context, known, first
        span = np.int64(sizes.words + 1)
        self.paired = np.flatnonzero(word[self.live] >= 0)
        asked = self.live[self.paired]
        keys, _, self.place = numbered(self.live_context[self.paired] * span + word[asked])
        del word
        train = ~self.held_out[self.doc_of[asked]]
        self.train = np.bincount(self.place[train], minlength=len(keys)).astype(np.uint32)
        del asked, train
        at_context, self.pair_word = keys // span, keys % span
        del keys
        # A context is asked for in all its slices, a word in its own.
        slices = sizes.slices(self.totals)
        self.owner = np.repeat(np.arange(len(self.contexts)), slices)
        begin = np.cumsum(slices) - slices
        self.slice_shard = sizes.shard(
            self.contexts[self.owner], np.arange(len(self.owner)) - np.repeat(begin, slices)
        )
        slice_of = begin[at_context] + self.pair_word % slices[at_context]
        self.held = np.bincount(slice_of, minlength=len(self.owner))
        # By shard, then slice, then word.
        self.slice_order = in_order(self.slice_shard)[0]
        rank = np.empty(len(self.owner), np.int64)
        rank[self.slice_order] = np.arange(len(self.owner))
        del at_context
        self.pair_order = in_order(rank[slice_of] * span + self.pair_word)[0]
        self.shards = distinct(self.slice_shard)
        ends = [*self.shards, self.shards[-1] + 1] if len(self.shards) else [0]
        self.slice_cut = np.searchsorted(self.slice_shard[self.slice_order], ends)
        self.pair_cut = np.searchsorted(self.slice_shard[slice_of][self.pair_order], ends)

    def _of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Slices and pairs asked of the i-th shard, in order."""
        return (
            self.slice_order[self.slice_cut[i] : self.slice_cut[i + 1]],
            self.pair_order[self.pair_cut[i] : self.pair_cut[i + 1]],
        )

    def requests(self):
        """(shard, contexts, their totals, pairs of each, words, training counts)."""
        for i, shard in enumerate(self.shards):
            s, p = self._of(i)
            owners = self.owner[s]
            yield shard, self.contexts[owners], self.totals[owners], self.held[s], self.pair_word[p], self.train[p]

    def read(self, answers: list) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each pair; different successors of each context."""
        seen = np.zeros(len(self.pair_word))
        after = np.zeros(len(self.contexts), np.int64)
        for answer in answers or ():
            s, p = self._of(int(np.searchsorted(self.shards, answer["shard"])))
            book = np.frombuffer(answer["book"], np.float64)
            seen[p] = book[np.frombuffer(answer["codes"], np.uint8)]
            np.add.at(after, self.owner[s], from_planes(answer["after"], np.uint32))
        return seen, after


_ASK = pa.schema([
    ("shard", pa.int32()), ("block_id", pa.int64()), ("contexts", pa.binary()), ("totals", pa.binary()),
    ("held", pa.binary()), ("words", pa.binary()), ("train", pa.binary()),
])
_ASK_DDL = "shard int, block_id bigint, contexts binary, totals binary, held binary, words binary, train binary"


def _ask(sizes: Sizes):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                pairs = Pairs(block, batch.column(5)[row], sizes)
                for shard, contexts, totals, held, words, train in pairs.requests():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block.block_id], pa.int64()),
                        *(pa.array([planes(x)], pa.binary()) for x in (
                            contexts.astype(np.uint64), totals.astype(np.uint64), held.astype(np.uint32),
                            words.astype(np.uint64), train.astype(np.uint32),
                        )),
                    ], schema=_ASK)

    return work


class Trie:
    """Contexts and their successors of one shard."""

    def __init__(self, context, total, word, count, words: int, levels: Levels, discount: float):
        """The pairs of training, sorted by context and word, all different; ``total``
        is the count of the pair's context."""
        self.span = words + 1
        # Contexts are sorted.
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        self.own = context[first]
        ends = np.r_[first[1:], len(context)].astype(np.int64)
        self.contexts = EliasFano(self.own, self.span + 1, levels)
        # Where the successors of a context end.
        self.pointers = EliasFano(ends, len(context) + 1, levels)
        offset = np.repeat(np.arange(len(self.own)), np.diff(np.r_[0, ends])).astype(np.uint64) * np.uint64(self.span)
        self.successors = EliasFano(offset + word, max(1, len(self.own)) * self.span, levels)
        chance = (count - discount) / total
        logs = np.log10(chance)
        # Equal steps of the logarithm bound the error of every pair; a code stands for
        # the mean of its pairs.
        low, high = (logs.min(), logs.max()) if len(logs) else (0.0, 0.0)
        code = np.minimum((logs - low) / max(high - low, 1e-9) * CODES, CODES - 1).astype(np.int64)
        means = np.bincount(code, logs, CODES) / np.maximum(np.bincount(code, minlength=CODES), 1)
        # Code 0 is for pairs that training does not have.
        self.book = np.r_[0.0, 10.0 ** means]
        self.codes = levels.map((code + 1).astype(np.uint8))

    def look_up(self, contexts: np.ndarray, held: np.ndarray, words: np.ndarray):
        """Codes of the words, ``held`` of them after each context; and the number of
        successors of each context."""
        place, known = self.contexts.successor(contexts)
        safe = np.where(known, place, 0)
        if not len(self.own):
            return np.zeros(len(words), np.uint8), np.zeros(len(contexts), np.uint32)
        stop = self.pointers[safe].astype(np.int64)
        start = np.where(safe > 0, self.pointers[np.maximum(safe, 1) - 1].astype(np.int64), 0)
        after = np.where(known, stop - start, 0).astype(np.uint32)
        owner = np.repeat(safe, held).astype(np.uint64)
        at, hit = self.successors.successor(owner * np.uint64(self.span) + words)
        hit &= np.repeat(known, held)
        codes = np.where(hit, self.codes[np.minimum(at, len(self.codes) - 1)], 0).astype(np.uint8)
        return codes, after


def _answer(sizes: Sizes, discount: float):
    def work(table: pa.Table) -> pa.Table:
        def read(name, row, dtype):
            return from_planes(table.column(name)[row].as_buffer(), dtype)

        span = np.uint64(sizes.words + 1)
        keys, train = [], []
        for row in range(table.num_rows):
            n = read("train", row, np.uint32)
            have = n > 0
            context = np.repeat(read("contexts", row, np.uint64), read("held", row, np.uint32))
            keys.append(context[have] * span + read("words", row, np.uint64)[have])
            train.append(n[have])
        keys, train = np.concatenate(keys), np.concatenate(train)
        order = in_order(keys)[0]
        keys, train = keys[order], train[order]
        del order
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        count = np.add.reduceat(train.astype(np.int64), new) if len(keys) else train.astype(np.int64)
        keys = keys[new]
        del train, new
        context, word = keys // span, keys % span
        del keys
        # Every block that asks for a context gives its count.
        own, _, place = numbered(context)
        total = np.zeros(len(own) + 1)
        for row in range(table.num_rows):
            contexts = read("contexts", row, np.uint64)
            at = np.searchsorted(own, contexts)
            at[own[np.minimum(at, len(own) - 1)] != contexts if len(own) else slice(None)] = len(own)
            total[at] = read("totals", row, np.uint64)
        total = total[place]
        del own, place
        out = []
        with Levels() as levels:
            trie = Trie(context, total, word, count, sizes.words, levels, discount)
            del context, total, word, count
            book = trie.book.tobytes()
            for row in range(table.num_rows):
                codes, after = trie.look_up(
                    read("contexts", row, np.uint64), read("held", row, np.uint32), read("words", row, np.uint64)
                )
                out.append((
                    table.column("block_id")[row].as_py(), table.column("shard")[row].as_py(), codes.tobytes(), book, planes(after),
                ))
        return pa.table(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            names=["block_id", "shard", "codes", "book", "after"],
        )

    return work


def _score(sizes: Sizes, discount: float):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                pairs = Pairs(block, batch.column(5)[row], sizes)
                seen, after = pairs.read(batch.column(6)[row].as_py())
                base = sizes.base(pairs.count)
                chance = base.copy()
                back_off = discount * after / np.maximum(pairs.totals, 1)
                chance[pairs.live] *= back_off[pairs.live_context]
                chance[pairs.live[pairs.paired]] += seen[pairs.place]
                n = len(block.ids)
                del seen, back_off
                yield pa.RecordBatch.from_arrays([
                    id_array(block.ids), pa.array(pairs.held_out), pa.array(pairs.lengths),
                    pa.array(np.bincount(pairs.doc_of, pairs.count > 0, n).astype(np.int64)),
                    pa.array(np.bincount(pairs.doc_of, np.log10(base), n)),
                    pa.array(np.bincount(pairs.doc_of, np.log10(chance), n)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work


def score(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every
    row of ``docs``.

    * A-Z are lower-cased. Tokens are the words and one end of text, which NULL and
      empty texts have too.
    * The model learns from the rows whose crc32(doc_id as text) leaves another
      remainder than 1 when divided by 5; a NULL id counts as "" and is learned from.
    * ``n_known`` counts the tokens that training has; ``base_score`` sums log10 of the
      single-word probabilities, ``score`` log10 of the model's.
    * Rows that repeat are learned and scored each. An empty table gives an empty
      result; without training rows ``train_tokens`` is 0 and both scores use p(w).
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "block_id")
    with small_batches(spark):
        blocks = shelf.store(pack(docs, lower=True), "blocks")
        entries = blocks.mapInArrow(_dictionary, "block_id bigint, number int, word string, n bigint")
        words = store(vocabulary(entries), "vocabulary")
        end = F.col("word") == END
        tokens, kinds, documents, end_id = words.agg(
            F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(end, F.col("c"))), F.lit(0)),
            F.coalesce(F.max(F.when(end, F.col("id"))), F.lit(-1)),
        ).first()
        parts = shuffle_partitions(spark)
        sizes = Sizes(tokens, kinds, documents, end_id, max(parts, -(-tokens // SHARD_PAIRS)), parts)
        found = shelf.store(looked_up(blocks, words, parts), "found")
        asked = answered(blocks, found).mapInArrow(_ask(sizes), _ASK_DDL)
        ddl = "block_id bigint, shard int, codes binary, book binary, after binary"
        replies = asked.groupBy("shard").applyInArrow(_answer(sizes, discount), ddl)
        replies = gather(replies, "shard", "codes", "book", "after")
        scored = answered(blocks, found, replies).mapInArrow(
            _score(sizes, discount),
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
        )
        scored = store(scored.withColumn("train_tokens", F.lit(tokens).cast("bigint")), "scores")
    shelf.clear()
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
