"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is encoded by an agenda of adjacent symbol pairs: the pair whose joined
piece has the best score is merged first, of equal ones the leftmost. No merge
reaches across two neighbouring characters that no piece holds side by side at
a word mark, so the agenda runs over one segment (a word with the marks before
it) at a time, and segments met before are looked up. Every newly encoded
segment is compared with the sentencepiece library.

The model file is read on the driver and its bytes (half a megabyte for 32,000
pieces) go to the tasks with the function.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Segments remembered by a worker; when full, the table is emptied.
MEMORY = 1_000_000
# Characters encoded and decoded at a time.
BATCH_CHARS = 4_000_000


class Agenda:
    """Encodes with the pieces and scores of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.library
        every = range(sp.get_piece_size())
        self.ids = {
            sp.id_to_piece(i): i for i in every
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        self.scores = {piece: -sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.ends = np.array([sp.bos_id()], "<u4").tobytes(), np.array([sp.eos_id()], "<u4").tobytes()
        # The properties that segments rest on; a model without them is taken whole.
        across = re.compile(f"[^{MARK}]{MARK}|\n")
        split = not any(across.search(piece) for piece in self.ids)
        self.segments = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if split else r"(?s:.+)").findall
        self.known: dict[str, bytes] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment."""
        scores = self.scores
        parts = list(segment)
        n = len(parts)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None:
                agenda.append((score, i, parts[i], parts[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, first, second = heappop(agenda)
            j = right[i]
            # A pair is stale when either side has been merged since.
            if parts[i] != first or j >= n or parts[j] != second:
                continue
            joined = parts[i] = first + second
            parts[j] = ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                score = scores.get(joined + parts[k])
                if score is not None:
                    heappush(agenda, (score, i, joined, parts[k]))
            h = left[i]
            if h >= 0:
                score = scores.get(parts[h] + joined)
                if score is not None:
                    heappush(agenda, (score, h, parts[h], joined))
        ids: list[int] = []
        for part in parts:
            if part:
                known = self.ids.get(part)
                if known is None:
                    ids.extend(self.bytes[b] for b in part.encode())
                else:
                    ids.append(known)
        return ids

    def learn(self, segments: set[str]) -> None:
        """Encode new segments, and compare each with the library."""
        if len(self.known) + len(segments) > MEMORY:
            self.known.clear()
        new = list(segments)
        mine = [self.merge(s) for s in new]
        # A line break stays by itself, and keeps the library's first mark apart.
        theirs = self.library.encode(["\n" + s.replace(MARK, " ") for s in new], num_threads=1)
        for segment, ids, other in zip(new, mine, theirs):
            if ids != other[2:]:
                raise ValueError(f"the library encodes {segment!r} otherwise: {other[2:]}, not {ids}")
            self.known[segment] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, ends included."""
        first, last = self.ends
        cut = [self.segments(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            held = len(self.known)
            self.learn(new)
            if len(self.known) < held + len(new):  # emptied: learn what else is needed
                self.learn(set().union(*cut).difference(self.known))
        known = self.known
        return [first + b"".join([known[s] for s in segments]) + last for segments in cut]


_agendas: dict[int, Agenda] = {}


def agenda(model: bytes) -> Agenda:
    """The agenda of a model, kept by the worker between batches and tasks."""
    key = hash(model)
    if key not in _agendas:
        _agendas.clear()
        _agendas[key] = Agenda(model)
    return _agendas[key]


def _pieces(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of some ``BATCH_CHARS`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``, and
    with ``keep`` the ``ids`` (int array) and the ``decoded`` text.

    * Every whole text is encoded exactly as the sentencepiece library does, with
      begin and end ids and without sampling, then decoded by the library.
    * NULL is the empty text, which has the two end ids and decodes to "".
    * ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers.
    * Rows that repeat are encoded each; an empty table gives an empty result.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    types = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
             ("decoded_sha256", pa.string())]
    if keep:
        schema += ", ids array<int>, decoded string"
        types += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def work(batches):
        coder = agenda(model)
        for batch in batches:
            doc_ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for piece in _pieces(texts):
                encoded = coder.encode(texts[piece])
                decoded = [
                    coder.library.decode(np.frombuffer(e, "<u4").tolist()) for e in encoded
                ]
                columns = [
                    doc_ids.slice(piece.start, len(encoded)),
                    pa.array([len(e) // 4 for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ]
                if keep:
                    columns.append(pa.array([np.frombuffer(e, "<i4") for e in encoded], types[4][1]))
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(types))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, schema)
