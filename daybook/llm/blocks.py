"""Documents packed as blocks of word numbers.

A block holds whole documents with some ``BLOCK_WORDS`` words: the different words
once, and every document as numbers into them. Steps over a corpus send what they
ask of it by block, get the answers back by block, and leave the texts in place.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 1_000_000
# Stands for a NULL id, which goes before all others.
NO_ID = -(1 << 63)

_SCHEMA = pa.schema([
    ("block_id", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()),
    ("words", pa.binary()), ("tokens", pa.binary()),
])
DDL = "block_id bigint, ids binary, ends binary, words binary, tokens binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def task_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives out."""
    task = TaskContext.get()
    return itertools.count((task.partitionId() if task else 0) << 32)


def _split(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where the words of each begin."""
    texts = texts.fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = split.flatten()
    # There is an empty word before and behind outer white space.
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    return words.filter(pa.array(full)), np.r_[0, np.cumsum(full)][np.r_[0, ends]]


def pack(docs: DataFrame, lower: bool) -> DataFrame:
    """Blocks of ``doc_id, text``; NULL texts have no words."""

    def work(batches):
        numbers = task_numbers()
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        tokens: list[pa.Array] = []
        n_ids = size = 0

        def block():
            of_words = pa.chunked_array(tokens, tokens[0].type).combine_chunks().dictionary_encode()
            words = pa.ListArray.from_arrays(pa.array([0, len(of_words.dictionary)], pa.int32()), of_words.dictionary)
            return pa.RecordBatch.from_arrays([
                pa.array([next(numbers)], pa.int64()),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([np.concatenate(ends).tobytes()], pa.binary()),
                pc.binary_join(words, "\n").cast(pa.binary()),
                pa.array([of_words.indices.to_numpy().astype(np.uint32).tobytes()], pa.binary()),
            ], schema=_SCHEMA)

        for batch in batches:
            of_batch = batch.column(0).fill_null(NO_ID).to_numpy()
            split, cut = _split(batch.column(1), lower)
            start = 0
            while start < len(of_batch):
                # Up to the document that fills the block.
                full = int(np.searchsorted(cut, cut[start] + max(BLOCK_WORDS - size, 1)))
                end = min(max(full, start + 1), start + BLOCK_WORDS - n_ids, len(of_batch))
                ids.append(of_batch[start:end])
                ends.append(cut[start + 1 : end + 1] - cut[start] + size)
                tokens.append(split[cut[start] : cut[end]])
                n_ids, size, start = n_ids + end - start, int(ends[-1][-1]), end
                if size >= BLOCK_WORDS or n_ids >= BLOCK_WORDS:
                    yield block()
                    ids, ends, tokens, n_ids, size = [], [], [], 0, 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, DDL)


@dataclass
class Block:
    block_id: int
    ids: np.ndarray  # int64, NO_ID for NULL
    ends: np.ndarray  # words up to the end of each document
    words: list[bytes]
    tokens: np.ndarray  # uint32 numbers of words

    @property
    def doc_of(self) -> np.ndarray:
        """The document, by its place in the block, of every word."""
        return np.repeat(np.arange(len(self.ids)), np.diff(np.r_[0, self.ends]))


def unpack(batch: pa.RecordBatch, row: int) -> Block:
    raw = [batch.column(i)[row].as_py() for i in range(5)]
    return Block(
        raw[0], np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.int64),
        raw[3].split(b"\n") if raw[3] else [], np.frombuffer(raw[4], np.uint32),
    )


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def answered(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with the columns of their answers, NULL where there are none."""
    for answer in answers:
        blocks = blocks.join(answer, "block_id", "left")
    return blocks


def gather(answers: DataFrame, *columns: str, name: str = "answers") -> DataFrame:
    """One row for each block with the list of its answers. A block asks a bounded
    number of things, so its answers fit one row."""
    return answers.groupBy("block_id").agg(F.collect_list(F.struct(*columns)).alias(name))


def planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, all first bytes, then all second ones: compresses well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed planes, for rows that wait in memory in numbers."""
    raw = planes(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return from_planes(pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b"", dtype)


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` (0 and up) in ascending order, equal ones as they stand, and the
    sorted values. Where value and place fit one number, those are sorted: faster than
    sorting places by what stands there."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()) < 1 << 62 - bits:
        both = values.astype(np.int64)
        both <<= bits
        both |= np.arange(len(values))
        both.sort()
        order = both & (1 << bits) - 1
        both >>= bits
        return order, both.astype(values.dtype, copy=False)
    order = np.argsort(values, kind="stable")
    return order, values[order]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    ranked = np.sort(values)
    return ranked[np.r_[True, ranked[1:] != ranked[:-1]]] if len(ranked) else ranked


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, ascending; where each stands first; and for every value the
    number of its own."""
    order, ranked = in_order(values)
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], order[new], place


# --- words looked up ------------------------------------------------------------------


def _by_part(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, part by part, and where each part begins."""
    order, ranked = in_order(np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words)))
    return order, np.searchsorted(ranked, np.arange(parts + 1))


def _ask_words(parts: int):
    def work(batches):
        for batch in batches:
            for block_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = raw.split(b"\n") if raw else []
                order, cut = _by_part(words, parts)
                asked = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked, pa.int32()), pa.array(np.full(len(asked), block_id), pa.int64()),
                    pa.array([b"\n".join(map(words.__getitem__, order[cut[p] : cut[p + 1]].tolist())) for p in asked], pa.binary()),
                ], names=["part", "block_id", "words"])

    return work


def _answer_words(asked: pa.Table, words: pa.Table) -> pa.Table:
    split = pc.split_pattern(asked.column("words").combine_chunks().cast(pa.large_binary()), b"\n")
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    have = words.column("word").combine_chunks().cast(pa.large_binary())
    place = pc.fill_null(pc.index_in(split.flatten(), have), -1).to_numpy(zero_copy_only=False)
    # The last one is for words that the table does not have.
    ids = np.r_[words.column("id").to_numpy() + 1, 0].astype(np.uint64)[place]
    counts = np.r_[words.column("c").to_numpy(), 0].astype(np.uint64)[place]
    cuts = list(itertools.pairwise([0, *ends.tolist()]))
    return pa.table([
        asked.column("block_id"), asked.column("part"),
        *(pa.array([planes(a[i:j]) for i, j in cuts], pa.binary()) for a in (ids, counts)),
    ], names=["block_id", "part", "ids", "counts"])


def looked_up(blocks: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """``block_id, found``: the numbers ``id`` and ``c`` that the table ``words`` has for the
    words of each block, to be read by ``of_words``.

    Words are dealt over ``parts`` by hash; a block asks each part once for all its
    words there, so no row is made for a word of a block."""
    asked = blocks.select("block_id", "words").mapInArrow(_ask_words(parts), "part int, block_id bigint, words binary")
    word = F.col("word").cast("binary")
    held = words.select((F.crc32(word) % parts).cast("int").alias("part"), word.alias("word"), "id", "c")
    replies = asked.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(
        _answer_words, "block_id bigint, part int, ids binary, counts binary"
    )
    return gather(replies, "part", "ids", "counts", name="found")


def of_words(words: list[bytes], found: pa.ListScalar, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``id`` of each word, -1 for those that the table does not have, and ``c``."""
    ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    order, cut = _by_part(words, parts)
    for answer in found.as_py() or ():
        at = order[cut[answer["part"]] : cut[answer["part"] + 1]]
        ids[at] = from_planes(answer["ids"], np.int64) - 1
        counts[at] = from_planes(answer["counts"], np.int64)
    return ids, counts
