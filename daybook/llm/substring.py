"""Substring dedup with suffix automata of reference shards.

A window of ``window`` words that also starts in a document with a smaller id is
found in three steps over blocks of packed documents:

1. short hashes of all windows, as wide as the corpus asks for, are dealt over
   shards by value; those that two documents hold are candidates;
2. the candidates' 64-bit hashes find the smallest document of each, their home;
3. the homes' passages make up the reference shards. A suffix automaton is built
   of each shard, every state with the smallest document that holds it, and the
   other documents' passages are streamed through it for matching statistics. A
   window goes when a match of its length is held by a smaller document.

An automaton goes to those tasks that have passages for its shard, to several if
one shard has many: sending each to all tasks would read the corpus once for each
shard. Hashes only choose what is compared; the automaton compares words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.blocks import NO_ID, Block, answered, from_planes, gather, id_array, pack, planes, unpack
from daybook.llm.common import Shelf, shuffle_partitions, store

WINDOW = 13
# Windows for each shard of hashes, words of passages for each task of a reference shard.
SHARD_WINDOWS = 2_000_000
TASK_WORDS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


# --- windows ------------------------------------------------------------------------


class Windows:
    """Hashes of all windows of a block and where they start."""

    def __init__(self, block: Block, window: int):
        import xxhash

        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in block.words), np.uint64, len(block.words))
        words = hashes[block.tokens]
        n = max(len(words) - window + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for i in range(window):
            rolled = rolled * _PRIME + words[i : i + n]
        rolled ^= rolled >> np.uint64(32)
        rolled *= _PRIME
        rolled ^= rolled >> np.uint64(29)
        doc_of = block.doc_of
        self.start = np.flatnonzero(doc_of[:n] == doc_of[window - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = doc_of[self.start]
        self.hash = rolled[self.start]


class Asked:
    """The different values of a block, dealt over shards by range of the value."""

    def __init__(self, values: np.ndarray, shards: int, bits: int):
        self.values, self.place = np.unique(values, return_inverse=True)
        width = -(-(1 << bits) // shards)
        self.shard = (self.values // np.uint64(width)).astype(np.int64)
        self.present = np.unique(self.shard)
        self.cut = np.searchsorted(self.shard, [*self.present, shards])

    def __iter__(self):
        for i, shard in enumerate(self.present):
            yield int(shard), slice(self.cut[i], self.cut[i + 1])

    def of(self, shard: int) -> slice:
        i = int(np.searchsorted(self.present, shard))
        return slice(self.cut[i], self.cut[i + 1])


def _extremes(place: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, place, ids)
    np.maximum.at(high, place, ids)
    return low, high


def _deltas(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def _values(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


# --- candidates -----------------------------------------------------------------------


def _short(found: Windows, shards: int, bits: int) -> Asked:
    return Asked(found.hash >> np.uint64(64 - bits), shards, bits)


def _ask_short(window: int, shards: int, bits: int):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                found = Windows(block, window)
                asked = _short(found, shards, bits)
                low, high = _extremes(asked.place, block.ids[found.doc], len(asked.values))
                for shard, part in asked:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block.block_id], pa.int64()),
                        pa.array([_deltas(asked.values[part])], pa.binary()),
                        pa.array([np.packbits(low[part] != high[part]).tobytes()], pa.binary()),
                        pa.array([int(low[part].min())], pa.int64()),
                        pa.array([planes((low[part] - low[part].min()).astype(np.uint64))], pa.binary()),
                    ], names=["shard", "block_id", "values", "several", "least", "low"])

    return work


def _answer_short(table: pa.Table) -> pa.Table:
    """Marks of the values that documents of two ids hold."""
    rows = table.to_pylist()
    values = [_values(r["values"]) for r in rows]
    lows = [r["least"] + from_planes(r["low"], np.uint64).astype(np.int64) for r in rows]
    several = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(v)).astype(bool) for r, v in zip(rows, values)]
    every, place = np.unique(np.concatenate(values), return_inverse=True)
    low, high = _extremes(place, np.concatenate(lows), len(every))
    twice = (low != high) | (np.bincount(place, np.concatenate(several), len(every)) > 0)
    marks = np.split(twice[place], np.cumsum([len(v) for v in values])[:-1])
    return pa.table([
        pa.array([r["block_id"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int32()),
        pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
    ], names=["block_id", "shard", "marks"])


# --- homes -----------------------------------------------------------------------------


class Candidates:
    """Windows of a block whose short hash two documents hold, by 64-bit hash."""

    def __init__(self, block: Block, answers: list, window: int, shards: int, bits: int):
        found = Windows(block, window)
        asked = _short(found, shards, bits)
        mark = np.zeros(len(asked.values), bool)
        for answer in answers or ():
            part = asked.of(answer["shard"])
            mark[part] = np.unpackbits(np.frombuffer(answer["marks"], np.uint8), count=part.stop - part.start)
        keep = np.flatnonzero(mark[asked.place]) if len(asked.values) else found.start
        self.start, self.doc = found.start[keep], found.doc[keep]
        self.asked = Asked(found.hash[keep], shards, 64)
        self.low, self.high = _extremes(self.asked.place, block.ids[self.doc], len(self.asked.values))


def _ask_home(window: int, shards: int, bits: int):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                found = Candidates(block, batch.column(5)[row].as_py(), window, shards, bits)
                for shard, part in found.asked:
                    low = found.low[part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block.block_id], pa.int64()),
                        pa.array([_deltas(found.asked.values[part])], pa.binary()),
                        pa.array([np.packbits(low != found.high[part]).tobytes()], pa.binary()),
                        pa.array([int(low.min())], pa.int64()),
                        pa.array([planes((low - low.min()).astype(np.uint64))], pa.binary()),
                    ], names=["shard", "block_id", "values", "several", "least", "low"])

    return work


def _answer_home(table: pa.Table) -> pa.Table:
    """The smallest document of each value, and whether another one holds it."""
    rows = table.to_pylist()
    values = [_values(r["values"]) for r in rows]
    lows = np.concatenate([r["least"] + from_planes(r["low"], np.uint64).astype(np.int64) for r in rows])
    several = np.concatenate([
        np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(v)) for r, v in zip(rows, values)
    ])
    every, place = np.unique(np.concatenate(values), return_inverse=True)
    low, high = _extremes(place, lows, len(every))
    twice = (low != high) | (np.bincount(place, several, len(every)) > 0)
    cuts = np.cumsum([len(v) for v in values])[:-1]
    homes, marks = np.split(low[place], cuts), np.split(twice[place], cuts)
    return pa.table([
        pa.array([r["block_id"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int32()),
        pa.array([int(h.min()) for h in homes], pa.int64()),
        pa.array([planes((h - h.min()).astype(np.uint64)) for h in homes], pa.binary()),
        pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
    ], names=["block_id", "shard", "least", "homes", "marks"])


# --- passages -----------------------------------------------------------------------------


def _runs(start: np.ndarray, doc: np.ndarray, home: np.ndarray, window: int):
    """(document, home, first word, end) of windows that follow each other."""
    if not len(start):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero(
        np.r_[True, (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (home[1:] != home[:-1])]
    )
    last = np.r_[new[1:], len(start)] - 1
    return np.c_[doc[new], home[new], start[new], start[last] + window]


def _passages(window: int, shards: int, bits: int):
    """References (``refers``) and passages of each block, packed by reference shard."""

    def rows(block, runs, refers):
        if not len(runs):
            return
        dealt = (runs[:, 1].astype(np.uint64) * _PRIME >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(dealt, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1):
            held = [b" ".join([block.words[t] for t in block.tokens[a:b]]) for _, _, a, b in runs[part]]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(dealt[part[0]])], pa.int32()), pa.array([block.block_id], pa.int64()),
                pa.array([refers]), pa.array([int((runs[part, 3] - runs[part, 2]).sum())], pa.int64()),
                pa.array([block.ids[runs[part, 0]].tobytes()], pa.binary()),
                pa.array([runs[part, 2].tobytes()], pa.binary()),
                pa.array([b"\n".join(held)], pa.binary()),
            ], names=["shard", "block_id", "refers", "words", "ids", "starts", "texts"])

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                found = Candidates(block, batch.column(5)[row].as_py(), window, shards, bits)
                home = np.zeros(len(found.asked.values), np.int64)
                twice = np.zeros(len(found.asked.values), bool)
                for answer in batch.column(6)[row].as_py() or ():
                    part = found.asked.of(answer["shard"])
                    home[part] = answer["least"] + from_planes(answer["homes"], np.uint64).astype(np.int64)
                    twice[part] = np.unpackbits(
                        np.frombuffer(answer["marks"], np.uint8), count=part.stop - part.start
                    )
                if not len(found.start):
                    continue
                home, twice = home[found.asked.place], twice[found.asked.place]
                own = block.ids[found.doc]
                for refers, chosen in ((True, twice & (home == own)), (False, twice & (home < own))):
                    runs = _runs(found.start[chosen], found.doc[chosen], home[chosen], window)
                    yield from rows(block, runs, refers)

    return work


PASSAGE_DDL = "shard int, block_id bigint, refers boolean, words bigint, ids binary, starts binary, texts binary"


# --- automata -------------------------------------------------------------------------------


class Automaton:
    """Suffix automaton of several word sequences, each of a document; a state knows
    the smallest document that holds its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of ``q`` for what is one word longer than ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list, doc: int) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = following[last].get(word)
            if q is not None:  # known from another sequence
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """Give every state the smallest document of those that end in it."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1].tolist()
        least, link = self.least, self.link
        for state in order:
            up = link[state]
            if up > 0 and (least[up] is None or least[state] < least[up]):
                least[up] = least[state]

    def matches(self, words: list, window: int, doc: int) -> list[int]:
        """Ends of the windows of ``words`` that a document before ``doc`` holds."""
        following, link, length, least = self.next, self.link, self.length, self.least
        state = size = 0
        found = []
        for end, word in enumerate(words, 1):
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            to = following[state].get(word)
            if to is None:
                continue
            state, size = to, size + 1
            # Longer matches say no more: keep to the state of the last words.
            if size >= window:
                size = window
                while length[link[state]] >= window:
                    state = link[state]
                if least[state] < doc:
                    found.append(end)
        return found


def _match(window: int):
    def work(references: pa.Table, passages: pa.Table) -> pa.Table:
        automaton = Automaton()
        if passages.num_rows:
            seen: set[tuple[int, bytes]] = set()
            for row in references.to_pylist():
                for doc, text in zip(np.frombuffer(row["ids"], np.int64).tolist(), row["texts"].split(b"\n")):
                    if (doc, text) not in seen:
                        seen.add((doc, text))
                        automaton.add(text.split(b" "), doc)
            automaton.finish()
        out = []
        for row in passages.to_pylist():
            spans: list[tuple[int, int]] = []
            each = zip(
                np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["starts"], np.int64).tolist(),
                row["texts"].split(b"\n"),
            )
            for doc, start, text in each:
                for end in automaton.matches(text.split(b" "), window, doc):
                    a, b = start + end - window, start + end
                    if spans and spans[-1][1] >= a >= spans[-1][0]:
                        spans[-1] = (spans[-1][0], b)
                    else:
                        spans.append((a, b))
            out.append((row["block_id"], np.array(spans, np.int64).tobytes()))
        ids, spans = zip(*out) if out else ((), ())
        return pa.table([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["block_id", "spans"])

    return work


def _remove(keep_text: bool):
    import hashlib

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = unpack(batch, row)
                cover = np.zeros(len(block.tokens) + 1, np.int64)
                for answer in batch.column(5)[row].as_py() or ():
                    spans = np.frombuffer(answer["spans"], np.int64).reshape(-1, 2)
                    np.add.at(cover, spans[:, 0], 1)
                    np.add.at(cover, spans[:, 1], -1)
                gone = np.cumsum(cover)[:-1] > 0
                begins = np.r_[0, block.ends[:-1]]
                removed = np.bincount(block.doc_of, gone, len(block.ids)).astype(np.int64)
                texts = [
                    b" ".join([block.words[t] for t in block.tokens[a:b][~gone[a:b]]])
                    for a, b in zip(begins, block.ends)
                ]
                columns = [
                    id_array(block.ids), pa.array(block.ends - begins), pa.array(removed),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array([t.decode() for t in texts]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``, and with
    ``keep_text`` the ``kept_text``.

    * Words are compared as they are. A word goes when a window of ``window`` words
      over it also starts in a document with a smaller id; windows are those of the
      input. Kept words are joined by one space.
    * NULL and empty texts have no words; texts shorter than a window stay whole.
    * Rows of one id are one document and do not remove each other's words; a NULL
      id is the smallest. An empty table gives an empty result.

    Two windows with one 64-bit hash but different words, met in smaller documents,
    could hide a repeat; no words are removed without being compared.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "block_id")
    blocks = shelf.store(pack(docs, lower=False), "blocks")
    total = blocks.agg(F.coalesce(F.sum(F.expr("length(tokens) div 4")), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), -(-total // SHARD_WINDOWS))
    # Some 1 in 256 windows meets another one's short hash.
    bits = min(64, max(16, int(total).bit_length() + 8))
    ask_ddl = "shard int, block_id bigint, values binary, several binary, least bigint, low binary"
    short = blocks.mapInArrow(_ask_short(window, shards, bits), ask_ddl).groupBy("shard").applyInArrow(
        _answer_short, "block_id bigint, shard int, marks binary"
    )
    short = shelf.store(gather(short, "shard", "marks", name="short"), "short")
    homes = answered(blocks, short).mapInArrow(_ask_home(window, shards, bits), ask_ddl)
    homes = homes.groupBy("shard").applyInArrow(
        _answer_home, "block_id bigint, shard int, least bigint, homes binary, marks binary"
    )
    homes = gather(homes, "shard", "least", "homes", "marks", name="homes")
    passages = store(
        answered(blocks, short, homes).mapInArrow(_passages(window, shards, bits), PASSAGE_DDL), "passages",
        compression="zstd",
    )
    # A shard with many passages is matched by several tasks, each with the automaton.
    sizes = passages.filter("NOT refers").groupBy("shard").agg(
        (F.lit(1) + F.floor(F.sum("words") / TASK_WORDS)).cast("int").alias("tasks")
    )
    dealt = passages.join(sizes, "shard")
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    references = dealt.filter("refers").withColumn("task", F.explode(every)).drop("tasks")
    streamed = dealt.filter("NOT refers").withColumn(
        "task", F.pmod(F.xxhash64("block_id"), F.col("tasks")).cast("int")
    ).drop("tasks")
    # New names for one side: both come from one table.
    references = references.select(*(F.col(c).alias(c) for c in references.columns))
    streamed = streamed.select(*(F.col(c).alias(c) for c in streamed.columns))
    spans = references.groupBy("shard", "task").cogroup(streamed.groupBy("shard", "task")).applyInArrow(
        _match(window), "block_id bigint, spans binary"
    )
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    kept = store(answered(blocks, gather(spans, "spans")).mapInArrow(_remove(keep_text), ddl), "kept")
    shelf.clear()
    return kept
