"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` bits agree in two of
``distance + 2`` blocks at least, so each different fingerprint goes to a bucket
for every pair of blocks. Buckets are range-partitioned in Gray order, in which
neighbours share most bits. Over each page of a bucket an index is built from
the leaves up: a node holds the bits that all below it share. The self-join of
the index carries the differences found so far down to the children, counts only
bits not yet compared, and drops a pair of groups as soon as the sum is too large.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import pick_rows, row_digest, shuffle_partitions, store
from daybook.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
# Fingerprints in an index page, children of a node, rows indexed at a time.
PAGE = 1024
FANOUT = 4
CHUNK = 200_000
# Rows whose pages are joined at once.
GROUP = 4 * PAGE
# Shingles hashed at a time.
SHINGLES = 200_000


# --- fingerprints -----------------------------------------------------------------


def _hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, SEED)]
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: len(words) - shingle]]
    return [digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def _majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; no hash gives zero."""
    out = np.zeros(len(sizes), np.uint64)
    filled = [i for i, n in enumerate(sizes) if n]
    if not filled:
        return out
    n = np.array([sizes[i] for i in filled])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little")
    out[filled] = over.view("<u8").ravel()
    return out


def _one_majority(hashes: list[int]) -> np.uint64:
    """The fingerprint of one long text, summed in pieces."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES):
        part = np.array(hashes[i : i + SHINGLES], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, digest, fp`` (64 bits as a bigint) of every row; 0 for texts without words."""

    def work(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            hashes: list[int] = []
            sizes: list[int] = []
            for text in batch.column(2):
                mine = _hashes((text.as_py() or "").encode(), shingle)
                if len(mine) > SHINGLES:
                    found += [_majority(hashes, sizes), np.array([_one_majority(mine)], np.uint64)]
                    hashes, sizes = [], []
                    continue
                hashes += mine
                sizes.append(len(mine))
                if len(hashes) >= SHINGLES:
                    found.append(_majority(hashes, sizes))
                    hashes, sizes = [], []
            found.append(_majority(hashes, sizes))
            fps = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "digest", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), row_digest(docs).alias("digest"), "text")
    return rows.mapInArrow(work, "doc_id bigint, digest bigint, fp bigint")


# --- index ------------------------------------------------------------------------


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit code in the reflected Gray sequence, as an ordered bigint."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_bits(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks of a fingerprint."""
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def bucketed(fps: DataFrame, distance: int) -> DataFrame:
    """``fp, t, key``: a row for each pair of blocks (``t``) with the blocks' bits."""
    pairs = itertools.combinations(block_bits(distance), 2)

    def bits(low: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.struct(F.lit(t).alias("t"), (F.shiftleft(bits(*x), y[1]) + bits(*y)).alias("key"))
        for t, (x, y) in enumerate(pairs)
    ]
    return fps.select("fp", F.inline(F.array(*keys)))


class Index:
    """Hierarchies over sorted pages: every level groups up to ``FANOUT`` nodes of one
    page; a node has the bits shared below it and the mask of where they are."""

    def __init__(self, page: np.ndarray, fps: np.ndarray, level: bool = False):
        """``page``: ascending page numbers of the rows. With ``level`` all pages get
        the same height."""
        self.levels = []  # (page, shared bits, mask, first child, end of children)
        ones, zeros = fps, fps
        rows = np.arange(len(fps))
        first, end = rows, rows + 1
        self.roots = []  # nodes that are the only one of their page, by level
        while len(page):
            self.levels.append((page, ones, ~(ones ^ zeros), first, end))
            new = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
            sizes = np.diff(np.r_[new, len(page)])
            if level and sizes.max() > 1:
                sizes = np.maximum(sizes, 2)  # none ends before the highest
            single = sizes == 1
            self.roots.append(new[single])
            place = np.arange(len(page)) - np.repeat(new, np.diff(np.r_[new, len(page)]))
            going = np.repeat(~single, np.diff(np.r_[new, len(page)]))
            cut = np.flatnonzero((place % FANOUT == 0) & going)
            if not len(cut):
                break
            stop = np.minimum(cut + FANOUT, np.repeat(np.r_[new[1:], len(page)], np.diff(np.r_[new, len(page)]))[cut])
            # Rows of finished pages lie between the groups: reduce over both edges.
            edges = np.c_[cut, stop].ravel()
            pad = lambda x: np.r_[x, x[-1:]]  # noqa: E731  reduceat needs an edge below the length
            ones = np.bitwise_and.reduceat(pad(ones), edges)[::2]
            zeros = np.bitwise_or.reduceat(pad(zeros), edges)[::2]
            page, first, end = page[cut], cut, stop

    def join(self, pairs: list[tuple[np.ndarray, np.ndarray]], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within ``distance``, from the pairs of nodes given by level."""
        a = b = np.zeros(0, np.int64)
        compared, found = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for depth in reversed(range(len(self.levels))):
            page, bits, mask, first, end = self.levels[depth]
            if depth < len(pairs):
                x, y = pairs[depth]
                a, b = np.r_[a, x], np.r_[b, y]
                compared = np.r_[compared, np.zeros(len(x), np.uint64)]
                found = np.r_[found, np.zeros(len(x), np.int64)]
            # Bits that both nodes share and that no pair above has compared.
            common = mask[a] & mask[b]
            found = found + np.bitwise_count((bits[a] ^ bits[b]) & common & ~compared)
            near = found <= distance
            a, b, compared, found = a[near], b[near], common[near], found[near]
            if depth:
                parts = []
                for i in range(FANOUT):
                    for j in range(FANOUT):
                        x, y = first[a] + i, first[b] + j
                        ok = (x < end[a]) & (y < end[b]) & (x <= y)
                        parts.append((x[ok], y[ok], compared[ok], found[ok]))
                a, b, compared, found = (np.concatenate(p) for p in zip(*parts))
        yield a[a < b], b[a < b]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row the least row that it is linked to, through others as well."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _page_links(page: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within pages, each row to the first of its component in the page.

    Pages are joined some ``GROUP`` rows at a time: where all rows of a page are near each
    other, its pairs are all open at once, and this bounds how many pages have theirs so.
    """
    if not len(page):
        return fps, fps
    begins = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    cuts = begins[np.flatnonzero(np.r_[False, begins[1:] // GROUP != begins[:-1] // GROUP])]
    moved, first = [], []
    for some, rows in zip(np.split(page, cuts), np.split(fps, cuts)):
        index = Index(some, rows)
        # Pages of one row have nothing to join.
        roots = [(r, r) for r in index.roots]
        roots[0] = (roots[0][0][:0],) * 2
        for x, y in index.join(roots, distance):
            label = _forest(len(rows), x, y)
            linked = np.flatnonzero(label != np.arange(len(rows)))
            moved.append(rows[linked])
            first.append(rows[label[linked]])
    return np.concatenate(moved), np.concatenate(first)


def _cross_links(one: np.ndarray, two: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two pages, enough to join what they connect."""
    fps = np.r_[one, two]
    index = Index(np.r_[np.zeros(len(one), int), np.ones(len(two), int)], fps, level=True)
    top = len(index.levels) - 1
    pairs = [(np.zeros(0, int), np.zeros(0, int))] * top + [(np.array([0]), np.array([1]))]
    for x, y in index.join(pairs, distance):
        label = _forest(len(fps), x, y)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return fps[moved], fps[label[moved]]
    return fps[:0], fps[:0]


FOUND = pa.schema([
    ("t", pa.int32()), ("key", pa.int64()), ("page", pa.int64()), ("mask", pa.int64()),
    ("bits", pa.int64()), ("fps", pa.binary()), ("a", pa.int64()), ("b", pa.int64()),
])
FOUND_DDL = "t int, key bigint, page bigint, mask bigint, bits bigint, fps binary, a bigint, b bigint"


def _index_partition(batches, distance: int):
    """Pages of a sorted partition: links inside them, and as rows those pages whose
    bucket may go on in another page."""
    task = TaskContext.get()
    numbers = itertools.count((task.partitionId() if task else 0) << 32)

    def out(t, key, fps, a, b) -> pa.RecordBatch:
        """Rows of open pages, and links."""
        n, m = len(fps), len(a)
        ones = [np.bitwise_and.reduce(x) for x in fps]
        mask = [~(o ^ np.bitwise_or.reduce(x)) for o, x in zip(ones, fps)]
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        none = lambda k, kind: pa.nulls(k, kind)
        columns = [
            (pa.array(t, pa.int32()), none(m, pa.int32())), (pa.array(key, pa.int64()), none(m, pa.int64())),
            (pa.array([next(numbers) for _ in fps], pa.int64()), none(m, pa.int64())),
            (signed(mask), none(m, pa.int64())), (signed(ones), none(m, pa.int64())),
            (pa.array([x.tobytes() for x in fps], pa.binary()), none(m, pa.binary())),
            (none(n, pa.int64()), signed(a)), (none(n, pa.int64()), signed(b)),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], schema=FOUND)

    def finish(t, key, fps, first: bool, last: bool):
        """Whole buckets, the first of which may have begun before and the last go on."""
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(t)])
        place = np.arange(len(t)) - np.repeat(new, sizes)
        page = np.cumsum((place % PAGE == 0)) - 1
        a, b = _page_links(page, fps, distance)
        wide = sizes > PAGE
        if first:
            wide[0] = True
        if last:
            wide[-1] = True
        rows: list[tuple] = []
        for s, n in zip(new[wide], sizes[wide]):
            rows += [(t[s], key[s], fps[i : min(i + PAGE, s + n)]) for i in range(s, s + n, PAGE)]
        return out([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], a, b)

    held: list[tuple] = []
    rows, first = 0, True
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        rows += len(held[-1][0])
        if rows < CHUNK:
            continue
        t, key, fps = (np.concatenate(x) for x in zip(*held))
        fps = fps.view(np.uint64)
        start = np.flatnonzero((t != t[-1]) | (key != key[-1]))
        start = start[-1] + 1 if len(start) else 0
        if start:
            yield finish(t[:start], key[:start], fps[:start], first, False)
            first = False
        elif rows >= CHUNK:  # one bucket fills the chunk: its whole pages are open
            start = rows // PAGE * PAGE
            yield finish(t[:start], key[:start], fps[:start], True, True)
            first = True  # what follows may be the rest of this bucket
        held = [(t[start:], key[start:], fps[start:].view(np.int64))]
        rows -= start
    if rows:
        t, key, fps = (np.concatenate(x) for x in zip(*held))
        yield finish(t, key, fps.view(np.uint64), first, True)


def _join_pages(batches, distance: int):
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1)):
            a, b = _cross_links(*(np.frombuffer(x.as_py(), np.uint64) for x in (one, two)), distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``fp`` (all different) as the
    pairs within ``distance`` do. Inside a page every fingerprint is linked to the
    first of its component only, so no group gives all its pairs."""
    spark = fps.sparkSession
    rows = bucketed(fps, distance).withColumn("rank", gray_rank(F.col("fp")))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "t", "key", "rank")
    ordered = dealt.sortWithinPartitions("t", "key", "rank").select("t", "key", "fp")
    found = store(ordered.mapInArrow(lambda x: _index_partition(x, distance), FOUND_DDL), "index")
    pages = found.filter("fps IS NOT NULL")
    one, two = pages.alias("one"), pages.alias("two")
    apart = F.expr("bit_count((one.bits ^ two.bits) & one.mask & two.mask)")
    met = one.join(
        two,
        (F.col("one.t") == F.col("two.t")) & (F.col("one.key") == F.col("two.key"))
        & (F.col("one.page") < F.col("two.page")) & (apart <= distance),
    )
    spread = met.select(F.col("one.fps").alias("x"), F.col("two.fps").alias("y")).repartition(
        shuffle_partitions(spark)
    )
    across = spread.mapInArrow(lambda x: _join_pages(x, distance), "a bigint, b bigint")
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(across)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id, root, digest`` for every row of ``docs``.
    ``root`` is the least fingerprint of the component.

    * Words are runs of characters outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. Shingles
      of ``shingle`` words, repeats included; fewer words are one shingle.
    * Texts without words, NULL too, have fingerprint 0, linked like any other.
    * Documents link at ``distance`` or fewer different bits. ``component_id`` is the
      smallest ``doc_id`` reachable over links; NULL ids are not counted, and a
      component of NULL ids only has NULL.
    * Rows that repeat are in one component. An empty table gives an empty result.
    """
    each = store(fingerprints(docs, shingle), "fingerprints")
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(least.select("fp"), distance))
    of = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return each.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "digest"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id, with all its columns."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("least")
    chosen = near_dedup(docs).groupBy("root").agg(least).select("least.doc_id", "least.digest")
    return pick_rows(docs, chosen)
