"""Byte-level substring dedup by prefix-free parsing and suffix arrays.

A window of ``WINDOW`` bytes is anchored at the ``GRAM`` bytes in it whose rolling hash
is smallest, so equal windows have equal anchors at equal places, and consecutive windows
mostly share one. Three steps over blocks of packed documents:

1. the hashes of the anchors are dealt over shards by value; an anchor that occurs in one
   document only cannot be that of a repeated window and is left out from here on;
2. the stretches of text around the other anchors are dealt by anchor, so that all equal
   windows come to one shard, each different stretch of a block once;
3. a shard is put into corpus order by prefix-free parsing: rolling-hash triggers cut the
   stretches into phrases that overlap by a trigger; the suffix array of the dictionary of
   different phrases orders the rest of a phrase after any place, the suffix array of the
   parse orders what follows a phrase. Together they order all windows without sorting
   the text itself, which repeats. Neighbours in that order that agree for ``WINDOW`` bytes
   are one class, whose smallest document keeps its bytes.

Texts are compared in step 3 only and byte by byte; the hashes before it choose what
is compared, and equal bytes have equal hashes, so none is missed.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.blocks import (
    NO_ID, _Numbers, answered, from_planes, gather, id_array, in_order, numbered, planes, task_numbers,
)
from daybook.llm.common import Shelf, shuffle_partitions, store

WINDOW = 50
GRAM = 24
# Bytes of text in a block, and for each shard of anchors.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
# Inside a shard: bytes of a trigger, and one place in so many is one.
TRIGGER, SPACING = 4, 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B1


# --- blocks -----------------------------------------------------------------------


def pack_bytes(docs: DataFrame) -> DataFrame:
    """Blocks of ``doc_id, text``: ids, ends and the bytes of whole documents."""

    def work(batches):
        numbers = task_numbers()
        ids: list[int] = []
        ends: list[int] = []
        parts: list[bytes] = []
        size = 0

        def block():
            return pa.RecordBatch.from_arrays([
                pa.array([next(numbers)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([np.array(ends, np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(parts)], pa.binary()),
            ], names=["block_id", "ids", "ends", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or b""
                if parts and size + len(raw) > BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 8:
                    yield block()
                    ids, ends, parts, size = [], [], [], 0
                size += len(raw)
                ids.append(NO_ID if doc_id is None else doc_id)
                ends.append(size)
                parts.append(raw)
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return rows.mapInArrow(work, "block_id bigint, ids binary, ends binary, body binary")


class Block:
    def __init__(self, batch: pa.RecordBatch, row: int):
        self.block_id = batch.column(0)[row].as_py()
        self.ids = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
        self.ends = np.frombuffer(batch.column(2)[row].as_py(), np.int64)
        self.body = batch.column(3)[row].as_py()


def rolling(body: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every ``n`` bytes in a row, joined from hashes of halves."""
    size = len(body) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    done, length = None, 0
    power, half = _BASE, body.astype(np.uint32) + np.uint32(1)
    step = 1
    while True:
        if n & step:
            # half[i] covers step bytes from i; done[i] the ``length`` bytes before them.
            done = half if done is None else done[: len(half) - length] * np.uint32(power) + half[length:]
            length += step
        step *= 2
        if step > n:
            return done[:size]
        half = half[: len(half) - step // 2] * np.uint32(power) + half[step // 2 :]
        power = power * power % (1 << 32)


def _content_hash(body: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes, 8 at least, from each place on."""
    out = np.zeros(len(places), np.uint64)
    if len(places):
        # The 8 bytes from any place on, read in steps that cover n.
        words = np.ndarray(len(body) - 7, np.uint64, body, strides=(1,))
        for at in [*range(0, n - 8, 8), n - 8]:
            out ^= words[places + at]
            out *= _PRIME
            out ^= out >> np.uint64(29)
    out *= _EVEN
    return (out ^ (out >> np.uint64(32))) * _PRIME


def window_anchors(body: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the runs that share an anchor, and the anchors, for all windows of
    ``body``. Slices that fit the processor's cache are worked on in turn."""
    gram = min(GRAM, window)
    wide = window - gram + 1
    # 16 bits of hash before 16 bits of place: the leftmost of the smallest comes first.
    slice_ = (1 << 16) - wide
    place = np.arange(1 << 16, dtype=np.uint32)
    firsts, anchors = [], []
    for at in range(0, len(body) - window + 1, slice_):
        least = rolling(body[at : at + slice_ + window - 1], gram)
        least = least * np.uint32(_BASE) & np.uint32(0xFFFF0000) | place[: len(least)]
        step = 1
        while step * 2 <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if wide > step:
            least = np.minimum(least[: step - wide], least[wide - step :])
        least &= np.uint32(0xFFFF)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        firsts.append(new + at)
        anchors.append(least[new].astype(np.int64) + at)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    return first[new], anchor[new]


class Anchors:
    """Runs of windows of a block that share an anchor: ``first`` and ``last`` window
    by their first byte, the document, and a hash of the anchor's bytes."""

    def __init__(self, block: Block, window: int):
        body = np.frombuffer(block.body, np.uint8)
        first, anchor = window_anchors(body, window)
        total = len(block.body) - window + 1
        # Cut where documents begin and where their last windows end.
        begins = np.r_[0, block.ends[:-1]]
        long = block.ends - begins >= window
        opens, shuts = begins[long], block.ends[long] - window + 1
        cuts = np.sort(np.concatenate([first, opens, shuts[shuts < total]]))
        cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]] if len(cuts) else cuts
        run = np.searchsorted(first, cuts, "right") - 1
        last = np.r_[cuts[1:], max(total, 0)][: len(cuts)] - 1
        inside = np.searchsorted(opens, cuts, "right") > np.searchsorted(shuts, cuts, "right")
        self.first, self.last = cuts[inside], last[inside]
        self.doc = np.searchsorted(block.ends, self.first, "right")
        # The order of hashes chose the anchors; dealt by another hash they spread evenly.
        self.hash = _content_hash(body, anchor, min(GRAM, window))[run[inside]]


class Dealt:
    """Different values in order, cut into shards of equal ranges."""

    def __init__(self, values: np.ndarray, shards: int, bits: int):
        self.values, _, self.place = numbered(values >> np.uint64(64 - bits))
        width = np.uint64(-(-(1 << bits) // shards))
        shard = (self.values // width).astype(np.int64)
        cut = np.searchsorted(shard, np.arange(shards + 1)).tolist()
        self.part = {s: slice(a, b) for s, (a, b) in enumerate(itertools.pairwise(cut)) if a < b}
        self.shard = shard[self.place]


def _packed_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _extremes(place: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least ``low`` and greatest ``high`` of the rows of each place below ``n``."""
    if not n:
        return low[:0], high[:0]
    order, ranked = in_order(place)
    cut = np.searchsorted(ranked, np.arange(n))
    return np.minimum.reduceat(low[order], cut), np.maximum.reduceat(high[order], cut)


# --- step 1: anchors of several documents ---------------------------------------------


def _ask(window: int, shards: int, bits: int):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                found = Anchors(block, window)
                dealt = Dealt(found.hash, shards, bits)
                ids = block.ids[found.doc]
                low, high = _extremes(dealt.place, ids, ids, len(dealt.values))
                for shard, part in dealt.part.items():
                    values = dealt.values[part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block.block_id], pa.int64()),
                        pa.array([planes(np.diff(values, prepend=np.uint64(0)))], pa.binary()),
                        pa.array([_packed_bits(low[part] != high[part])], pa.binary()),
                    ], names=["shard", "block_id", "values", "several"])

    return work


def _answer(table: pa.Table) -> pa.Table:
    """Marks of the values of two blocks, or of two documents in one."""
    rows = table.to_pylist()
    values = [np.cumsum(from_planes(r["values"], np.uint64), dtype=np.uint64) for r in rows]
    several = np.concatenate([_bits(r["several"], len(v)) for r, v in zip(rows, values)])
    every, _, place = numbered(np.concatenate(values))
    often = np.bincount(place, several + 1, len(every)) > 1
    marks = np.split(often[place], np.cumsum([len(v) for v in values])[:-1])
    return pa.table([
        pa.array([r["block_id"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int32()),
        pa.array([_packed_bits(m) for m in marks], pa.binary()),
    ], names=["block_id", "shard", "marks"])


# --- step 2: stretches around them ------------------------------------------------------


class Stretches:
    """Runs of windows whose anchor several documents may hold, by shard and text:
    ``texts[shard]`` has each different stretch once, ``run[shard]`` the runs of the block
    and ``number[shard]`` the stretch of each."""

    def __init__(self, block: Block, answers: list | None, window: int, shards: int, bits: int):
        found = Anchors(block, window)
        dealt = Dealt(found.hash, shards, bits)
        mark = np.zeros(len(dealt.values), bool)
        for answer in answers or ():
            part = dealt.part[answer["shard"]]
            mark[part] = _bits(answer["marks"], part.stop - part.start)
        keep = np.flatnonzero(mark[dealt.place])
        keep = keep[in_order(dealt.shard[keep])[0]]
        self.first, self.last, self.id = found.first[keep], found.last[keep], block.ids[found.doc[keep]]
        shard = dealt.shard[keep]
        self.texts, self.run, self.number = {}, {}, {}
        body = block.body
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for run in np.split(np.arange(len(keep)), cuts) if len(keep) else ():
            numbers = _Numbers()
            spans = zip(self.first[run].tolist(), (self.last[run] + window).tolist())
            number = np.fromiter((numbers[body[a:b]] for a, b in spans), np.int64, len(run))
            here = int(shard[run[0]])
            self.texts[here], self.run[here], self.number[here] = list(numbers), run, number


def _send(window: int, shards: int, bits: int):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                found = Stretches(block, batch.column(4)[row].as_py(), window, shards, bits)
                for shard, texts in found.texts.items():
                    ids = found.id[found.run[shard]]
                    low, high = _extremes(found.number[shard], ids, ids, len(texts))
                    body = b"".join(texts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block.block_id], pa.int64()),
                        pa.array([planes(np.array([len(t) for t in texts], np.uint32))], pa.binary()),
                        pa.array([planes(low)], pa.binary()), pa.array([planes(high - low)], pa.binary()),
                        pa.array([len(body)], pa.int64()),
                        pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary()),
                    ], names=["shard", "block_id", "sizes", "low", "above", "size", "body"])

    return work


SENT = "shard int, block_id bigint, sizes binary, low binary, above binary, size bigint, body binary"


# --- step 3: corpus order of a shard ------------------------------------------------------


def _first_of(values: np.ndarray) -> np.ndarray:
    """For each of sorted ``values`` the place of the first equal one."""
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _refine(rank: np.ndarray, depth: int, left: np.ndarray) -> np.ndarray:
    """Ranks by twice the ``depth``. A rank is the number of suffixes in front of its class;
    ``left`` is the symbols before the end, and suffixes that end sooner are done."""
    open_ = np.flatnonzero(left >= depth)
    if not len(open_):
        return rank
    order, key = in_order(rank[open_] * (len(rank) + 1) + rank[open_ + depth])
    old = rank[open_][order]
    out = rank.copy()
    out[open_[order]] = old + _first_of(key) - _first_of(old)
    return out


def _ranks(key: np.ndarray) -> np.ndarray:
    order, values = in_order(key)
    out = np.empty(len(key), np.int64)
    out[order] = _first_of(values)
    return out


def _padded(values: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([values, np.zeros(n, values.dtype)])


class Dictionary:
    """The different phrases, and the suffix array of them as the rank of every suffix;
    equal suffixes, to the end of their phrases, have equal ranks."""

    def __init__(self, phrases: list[bytes], window: int):
        sizes = np.array([len(p) for p in phrases], np.int64)
        self.start = np.cumsum(sizes + 1) - sizes - 1
        total = int((sizes + 1).sum())
        # Symbols are bytes + 1; 0 ends a phrase.
        symbol = np.ones(total, np.int64)
        symbol[self.start + sizes] = 0
        symbol[symbol > 0] = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
        left = np.repeat(self.start + sizes, sizes + 1) - np.arange(total)

        def after(values, n):
            return np.where(left >= n, _padded(values[n:], n)[:total], 0)

        two = symbol << 9 | after(symbol, 1)
        three = two << 9 | after(symbol, 2)
        seven = (two << 18 | after(two, 2)) << 27 | after(three, 4)
        depth, rank = 7, _ranks(seven)
        while depth * 2 <= window:
            rank = _refine(rank, depth, left)
            depth *= 2
        # Two overlapping halves tell the windows apart that a phrase holds whole.
        self.half, self.depth = rank, depth
        self.rank = _refine(rank, depth, left)


class Parse:
    """Phrases of the stretches in order, with the suffix array of their ranks."""

    def __init__(self, body: np.ndarray, ends: np.ndarray):
        begins = np.r_[0, ends[:-1]]
        grams = rolling(body, TRIGGER)
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(_BASE) >> np.uint32(16)
        cut = np.zeros(len(body) + 1, bool)
        cut[np.flatnonzero(grams % np.uint32(SPACING) == 0)] = True
        # A trigger lies in one stretch; every stretch begins a phrase.
        for back in range(1, TRIGGER):
            cut[np.maximum(ends - back, begins)] = False
        cut[begins] = True
        self.start = np.flatnonzero(cut[:-1])
        self.piece = np.searchsorted(ends, self.start, "right")
        follows = np.r_[self.piece[1:] == self.piece[:-1], False]
        self.follows = follows
        self.end = np.where(follows, np.r_[self.start[1:], 0] + TRIGGER, ends[self.piece])
        self.stop = ends[self.piece]

    def order(self, rank: np.ndarray) -> np.ndarray:
        """Suffix array as the rank of each suffix of the parse, ``rank`` that of a phrase.
        Equal suffixes, to the end of their stretches, have equal ranks."""
        last = np.flatnonzero(~self.follows)
        left = last[np.searchsorted(last, np.arange(len(rank)))] - np.arange(len(rank)) + 1
        # The symbol after the last phrase is smaller than all.
        spread = np.arange(len(rank)) + np.searchsorted(last, np.arange(len(rank)))
        symbols = np.zeros(len(rank) + len(last), np.int64)
        symbols[spread] = rank + 1
        remaining = np.zeros(len(symbols), np.int64)
        remaining[spread] = left
        ranks, depth = _ranks(symbols), 1
        while depth < int(left.max()) + 1:
            ranks = _refine(ranks, depth, remaining)
            depth *= 2
        return ranks[spread]


def _common(body: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that agree from the places ``a`` and ``b`` on, up to ``limit``."""
    wide = _padded(body, limit + 16).astype(np.uint64)
    for n in (1, 2, 4):
        wide = wide[:-n] << np.uint64(8 * n) | wide[n:]
    agree = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, limit, 8):
        differ = wide[a[live] + at] ^ wide[b[live] + at]
        same = differ == 0
        agree[live[same]] += 8
        rest, differ = live[~same], differ[~same]
        for n in range(7, 0, -1):
            agree[rest] += differ >> np.uint64(8 * n) == 0
        live = live[same]
    return np.minimum(agree, limit)


def window_classes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte, in the joined ``texts``, and class of each of their windows; two windows
    are of one class if their bytes are equal. Classes are numbered in corpus order, those
    of windows that lie inside one phrase after the others."""
    joined = b"".join(texts)
    body = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    parse = Parse(body, ends)
    numbers = _Numbers()
    phrase = np.fromiter(
        (numbers[joined[a:b]] for a, b in zip(parse.start.tolist(), parse.end.tolist())), np.int64, len(parse.start)
    )
    words = Dictionary(list(numbers), window)
    place = words.start[phrase]
    size = parse.end - parse.start
    ranks = parse.order(words.rank[place])
    # The parse in corpus order, and the bytes that each suffix shares with the one before.
    order = np.argsort(ranks, kind="stable")
    shared = np.r_[0, _common(body, parse.start[order[:-1]], parse.start[order[1:]], window)]
    room = parse.stop - parse.start
    shared[1:] = np.minimum(shared[1:], np.minimum(room[order[:-1]], room[order[1:]]))
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))

    firsts, keys = [], []
    base = len(words.rank) + len(order) + 1
    fits = parse.stop - window
    overlap = np.where(parse.follows, TRIGGER, 0)
    # Windows that reach beyond their phrase: the rest of the phrase, then the parse.
    for d in range(TRIGGER + 1, window):
        has = np.flatnonzero(parse.follows & (size >= d))
        first = parse.end[has] - d
        some = first <= fits[has]
        has, first = has[some], first[some]
        depth = window - d + TRIGGER
        run = np.cumsum(shared < depth)
        firsts.append(first)
        keys.append(words.rank[place[has] + size[has] - d] * base + run[at[has + 1]])
    # Windows inside one phrase.
    count = np.maximum(np.minimum(size - window, size - overlap - 1) + 1, 0)
    has = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(has)) - np.repeat(np.cumsum(count) - count, count)
    firsts.append(parse.start[has] + offset)
    inner = place[has] + offset
    keys.append((words.half[inner] + len(words.rank)) * base + words.half[inner + window - words.depth])
    return np.concatenate(firsts), _ranks(np.concatenate(keys)) if sum(map(len, keys)) else np.zeros(0, np.int64)


def _runs_of(first: np.ndarray, value: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in a sorted list, of runs of neighbours with one value and piece."""
    new = np.flatnonzero(
        np.r_[True, (np.diff(first) != 1) | (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])]
    )
    return new, np.r_[new[1:], len(first)]


def _order(window: int):
    """The repeated windows of each stretch and the smallest document that has them."""

    def work(table: pa.Table) -> pa.Table:
        numbers = _Numbers()
        blocks, sent, low, high = [], [], [], []
        for row in table.to_pylist():
            sizes = from_planes(row["sizes"], np.uint32).tolist()
            body = pa.decompress(row["body"], row["size"], "zstd", asbytes=True)
            at, found = 0, []
            for size in sizes:
                found.append(numbers[body[at : at + size]])
                at += size
            blocks.append(row["block_id"])
            sent.append(np.array(found, np.int64))
            low.append(from_planes(row["low"], np.int64))
            high.append(low[-1] + from_planes(row["above"], np.int64))
        texts = list(numbers)
        least, most = _extremes(np.concatenate(sent), np.concatenate(low), np.concatenate(high), len(texts))
        ends = np.cumsum([len(t) for t in texts])
        first, kind = window_classes(texts, window)
        piece = np.searchsorted(ends, first, "right")
        order = np.argsort(kind)
        cut = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0])
        low_of, high_of = np.minimum.reduceat(least[piece[order]], cut), np.maximum.reduceat(most[piece[order]], cut)
        size = np.diff(np.r_[cut, len(order)])
        holder = np.empty(len(order), np.int64)
        holder[order] = np.repeat(low_of, size)
        often = np.empty(len(order), bool)
        often[order] = np.repeat(low_of != high_of, size)
        chosen = np.flatnonzero(often)
        chosen = chosen[np.argsort(first[chosen])]
        first, holder, piece = first[chosen], holder[chosen], piece[chosen]
        out = []
        if len(first):
            a, b = _runs_of(first, holder, piece)
            begin = (first[a] - np.r_[0, ends[:-1]][piece[a]]).astype(np.uint32)
            length, keeper = (b - a).astype(np.uint32), holder[a]
            from_, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            of, at, n = np.unique(piece[a], return_index=True, return_counts=True)
            from_[of], count[of] = at, n
            for block, numbers_ in zip(blocks, sent):
                n = count[numbers_]
                which = np.repeat(from_[numbers_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(which):
                    number = np.repeat(np.arange(len(n)), n).astype(np.uint32)
                    out.append((block, *(planes(v) for v in (number, begin[which], length[which], keeper[which]))))
        shard = table.column("shard")[0].as_py()
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array([shard] * len(out), pa.int32())]
            + [pa.array(c, pa.binary()) for c in columns[1:]],
            names=["block_id", "shard", "number", "begin", "length", "keeper"],
        )

    return work


ORDERED = "block_id bigint, shard int, number binary, begin binary, length binary, keeper binary"


# --- step 4: what is left ----------------------------------------------------------------


def _covered(found: Stretches, answers: list | None, size: int, window: int) -> np.ndarray:
    """Marks of the bytes of a block that a window of a smaller document covers."""
    cover = np.zeros(size + 1, np.int32)
    for answer in answers or ():
        number, begin, length = (from_planes(answer[c], np.uint32).astype(np.int64) for c in ("number", "begin", "length"))
        keeper = from_planes(answer["keeper"], np.int64)
        run, of = found.run[answer["shard"]], found.number[answer["shard"]]
        order = np.argsort(of, kind="stable")
        from_ = np.searchsorted(of[order], number)
        n = np.searchsorted(of[order], number, "right") - from_
        which = np.repeat(np.arange(len(number)), n)
        run = run[order[np.repeat(from_, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        gone = keeper[which] < found.id[run]
        start = found.first[run[gone]] + begin[which[gone]]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length[which[gone]] - 1 + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _remove(window: int, shards: int, bits: int, keep_text: bool):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                answers = batch.column(5)[row].as_py()
                if answers:
                    found = Stretches(block, batch.column(4)[row].as_py(), window, shards, bits)
                    gone = _covered(found, answers, len(block.body), window)
                else:
                    gone = np.zeros(len(block.body), bool)
                begins = np.r_[0, block.ends[:-1]]
                doc = lambda at: np.searchsorted(block.ends, at, "right")
                opens = gone & ~np.r_[False, gone[:-1]]
                opens[begins[begins < len(gone)]] |= gone[begins[begins < len(gone)]]
                n = len(block.ids)
                removed = np.bincount(doc(np.flatnonzero(gone)), minlength=n)
                spans = np.bincount(doc(np.flatnonzero(opens)), minlength=n)
                kept = np.frombuffer(block.body, np.uint8)[~gone].tobytes()
                cut = np.cumsum(block.ends - begins - removed)
                texts = [kept[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
                columns = [
                    id_array(block.ids), pa.array(block.ends - begins), pa.array(removed), pa.array(spans),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(texts, pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def dedup_bytes(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``, and
    with ``keep_text`` the ``kept_bytes``.

    * Texts are UTF-8 bytes. A byte goes when a string of ``window`` bytes over it also
      starts in a document with a smaller id; strings are those of the input, lie in one
      document, and may cut a character. ``n_spans`` counts maximal runs of bytes that go.
    * NULL and empty texts have no bytes; texts shorter than ``window`` stay whole.
    * Rows of one id are one document and do not remove each other's bytes; a NULL id is
      the smallest. An empty table gives an empty result. Only ``doc_id`` and ``text``
      are read, whatever other columns are called.

    A task holds one block, or the different stretches that blocks send to one shard: a
    passage that every document has is sent once a block.
    """
    if window < 8:
        raise ValueError("a window has at least 8 bytes")
    shelf = Shelf(docs.sparkSession, "block_id")
    try:
        blocks = shelf.store(pack_bytes(docs), "blocks")
        total = blocks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
        shards = max(shuffle_partitions(docs.sparkSession), -(-total // SHARD_BYTES))
        # Some 1 in 256 anchors meets another one's short hash.
        bits = min(60, max(16, int(total).bit_length() + 5))
        asked = blocks.mapInArrow(_ask(window, shards, bits), "shard int, block_id bigint, values binary, several binary")
        marks = asked.groupBy("shard").applyInArrow(_answer, "block_id bigint, shard int, marks binary")
        marks = shelf.store(gather(marks, "shard", "marks", name="marks"), "marks")
        sent = answered(blocks, marks).mapInArrow(_send(window, shards, bits), SENT)
        ordered = sent.groupBy("shard").applyInArrow(_order(window), ORDERED)
        ordered = gather(ordered, "shard", "number", "begin", "length", "keeper", name="ordered")
        ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        kept = answered(blocks, marks, ordered).mapInArrow(
            _remove(window, shards, bits, keep_text), ddl + ", kept_bytes binary" * keep_text
        )
        return store(kept, "kept")
    finally:
        shelf.clear()
