"""Harmonic packing of token sequences.

Lengths are partitioned into classes 1/k of the capacity: class k holds the lengths above capacity / (k + 1) and up to
capacity / k, and its bins take exactly k documents, whole.  Documents beyond the capacity first give off pieces of the
whole capacity.  Workers fill bins on their own, with fewer than k open documents per class.  The gap that a bin's k
documents leave waits for the next document that is no longer than all waiting gaps together: it is cut along them,
longest gap first, and stays whole where it fits.  So a sequence costs one cut at most, and no full sequence is padded.
At a worker's end the documents of open bins, at most some of them cut, fill whole bins and then bins whose sizes are
powers of two, which need no padding either.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tokens import gather, load_vocabulary, make_encoder, slices

FIELDS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
#: Fields of a piece: document, place in it, length, ids as bytes, length of the document.
Piece = tuple[object, int, int, bytes, int]


def cut(piece: Piece, length: int) -> tuple[Piece, Piece | None]:
    """The first `length` ids of a piece, and the rest if there is one."""
    name, start, size, ids, whole = piece
    if size <= length:
        return piece, None
    return (name, start, length, ids[:4 * length], whole), (name, start + length, size - length, ids[4 * length:], whole)


class Bins:
    """The open bins of one worker: by class those with fewer than k documents, and those that wait for a filled gap.

    Waiting gaps are shorter than one and a half capacities together, so the documents held are bounded too.
    """

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next, self.open = capacity, worker << 40, {}
        self.waiting, self.gaps, self.tickets = [], 0, count()

    def add(self, piece: Piece) -> Iterator[tuple]:
        """Yields (piece, sequence, offset) of the bins that this piece makes full; its ids may be any buffer."""
        name, start, length, ids, whole = piece
        size = length % self.capacity
        full = length - size
        for at in range(0, full, self.capacity):
            yield from self._placed([(name, start + at, self.capacity, bytes(ids[4 * at:4 * (at + self.capacity)]), whole)])
        if not size:
            return
        piece = (name, start + full, size, bytes(ids[4 * full:]), whole)
        if size <= self.gaps:
            yield from self._fill(piece)
            return
        k = self.capacity // size
        members = self.open.setdefault(k, [])
        members.append(piece)
        if len(members) == k:
            yield from self._wait(self.open.pop(k), self.capacity - sum(m[2] for m in members))

    def _placed(self, members: list[Piece]) -> Iterator[tuple]:
        sequence, offset = self.next, 0
        self.next += 1
        for member in members:
            yield member, sequence, offset
            offset += member[2]

    def _wait(self, members: list[Piece], gap: int) -> Iterator[tuple]:
        if gap:
            heappush(self.waiting, (-gap, next(self.tickets), members))
            self.gaps += gap
        else:
            yield from self._placed(members)

    def _fill(self, piece: Piece | None) -> Iterator[tuple]:
        """Cuts a piece no longer than all gaps along them."""
        while piece is not None:
            gap, _, members = heappop(self.waiting)
            self.gaps += gap
            first, piece = cut(piece, -gap)
            members.append(first)
            yield from self._wait(members, -gap - first[2])

    def close(self) -> Iterator[tuple]:
        """The documents of open bins: waiting gaps, whole bins, then bins whose sizes are powers of two."""
        loose = []
        for piece in sorted((p for members in self.open.values() for p in members), key=lambda p: p[2]):
            if piece[2] <= self.gaps:
                yield from self._fill(piece)
            else:
                loose.append(piece)
        loose += [p for *_, members in sorted(self.waiting, key=lambda w: w[:2]) for p in members]
        rest = sum(p[2] for p in loose)
        while rest:
            size = min(self.capacity, 1 << (rest.bit_length() - 1))
            members, room = [], size
            while room:
                first, after = cut(loose.pop(), room)
                members.append(first)
                room -= first[2]
                if after is not None:
                    loose.append(after)
            yield from self._placed(members)
            rest -= size


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0,
    added: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of all documents in sequences of at most `capacity`.

    A document is its text's ids and `end_id`; null and empty texts are that one id.  `ids` are little-endian unsigned
    32-bit.  Each id is in one piece; repeated rows are packed each for itself.  `capacity` is a power of two.
    `vocabulary` is a rank or tokenizer file; with `added` its added tokens are found in texts.  Nothing is shuffled; other columns are not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    known = load_vocabulary(docs.sparkSession, vocabulary, pattern, added)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, id_type = make_encoder(known), Bins(TaskContext.get().partitionId(), capacity), None
        for batch in batches:
            id_type = batch.column(0).type
            for at, texts in slices(batch.column(1)):
                yield from placed(packed(at, batch.column(0), *encode(texts), bins), id_type)
        if id_type is not None:
            yield from placed(bins.close(), id_type)

    def packed(at, doc_ids, ids, sizes, bins):
        whole = np.full(len(ids) + len(sizes), end_id, "<u4")
        own = gather(np.arange(len(whole)), np.cumsum(sizes + 1) - sizes - 1, sizes)
        whole[own] = ids
        names, data, end = doc_ids.slice(at, len(sizes)).to_pylist(), memoryview(whole.tobytes()), 0
        for name, size in zip(names, (sizes + 1).tolist()):
            yield from bins.add((name, 0, size, data[4 * end:4 * (end + size)], size))
            end += size

    def placed(found, id_type):
        found = [(*piece, sequence, offset) for piece, sequence, offset in found]
        types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], list(FIELDS))

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
