"""Byte-level BPE of a corpus: pre-tokens exploded with positions, each distinct one encoded once, ids joined back.

A chunk of documents keeps its distinct pre-tokens once and its text as their numbers in order.  Pre-tokens go to the
bucket of their hash, where each distinct one of all chunks is encoded once; the ids go back to the chunks, which put
them together by position.  What moves is grouped by chunk and bucket before the shuffle, so a pre-token that occurs in
every text is one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from caseloom.llm.tokens import gather, load_vocabulary, pretokens, slices

#: Characters of text in a chunk, and bytes of text per bucket of pre-tokens.
CHUNK, BUCKET = 5 << 19, 16 << 20
#: Rows decoded before they are handed on.
DECODED = 256


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings and unsigned 32-bit arrays, compressed as one."""
    parts = [a if isinstance(a, bytes) else a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, "<u4", count, 4).tolist()
    out, at = [], 4 + 4 * count
    for size in sizes:
        out.append(raw[at:at + size])
        at += size
    return out


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _words(lengths: np.ndarray, data: bytes) -> pa.BinaryArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _joined(words: pa.BinaryArray) -> tuple[np.ndarray, bytes]:
    return np.asarray(pc.binary_length(words)), b"".join(words.to_pylist())


def exploded(docs: pa.Array, texts: list[str], classes: np.ndarray, buckets: int, chunk: int) -> Iterator[tuple]:
    """Rows (route, chunk, docs, data) of a chunk: its distinct pre-tokens by bucket, and its texts as their numbers.

    Numbers follow the frequency in the chunk, so that most are small.
    """
    words, per_text = pretokens(texts, classes)
    coded = pc.dictionary_encode(words)
    indices = np.asarray(coded.indices)
    order = np.argsort(-np.bincount(indices, minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    distinct = coded.dictionary.take(pa.array(order))
    bucket = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct)) % np.uint64(buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
        if len(own):
            lengths, data = _joined(distinct.take(pa.array(own)))
            yield int(bucket[own[0]]), chunk, None, _pack(np.diff(own, prepend=0), lengths, data)
    yield -1 - chunk, chunk, docs.to_pylist(), _pack(per_text, number[indices] if len(indices) else indices)


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bucket_bytes: int = BUCKET,
) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, one array per row; null and empty texts have none.

    `vocabulary` is a rank or tokenizer file, `pattern` splits texts before the merges; special tokens are ordinary
    text.  Repeated rows are encoded each for itself; other columns are not read.
    """
    known = load_vocabulary(docs.sparkSession, vocabulary, pattern)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    names = ["route", "chunk", "docs", "data"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at, texts in slices(batch.column(1), chunk):
                made = exploded(batch.column(0).slice(at, len(texts)), texts, known.classes(), buckets, TaskContext.get().partitionId() << 32 | number)
                number += 1
                pa.default_memory_pool().release_unused()
                for row in made:
                    kinds = [pa.int64(), pa.int64(), pa.list_(batch.column(0).type), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    def encode_bucket(table: pa.Table) -> pa.Table:
        if table.column("route")[0].as_py() < 0:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["route", "reply"])
        parts = [_unpack(d) for d in table.column("data").to_pylist()]
        lists = [_words(_numbers(lengths), data) for _, lengths, data in parts]
        coded = pc.dictionary_encode(pa.concat_arrays(lists))
        single = known.encode()
        ids = [single(word) for word in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum()))
        starts, indices, at, replies = np.cumsum(sizes) - sizes, np.asarray(coded.indices), 0, []
        for (numbers, _, _), words in zip(parts, lists):
            which = indices[at:at + len(words)]
            at += len(words)
            replies.append(_pack(_numbers(numbers), sizes[which], gather(flat, starts[which], sizes[which])))
        return pa.table([pa.array(-1 - np.asarray(table.column("chunk"))), pa.array(replies, pa.binary())], ["route", "reply"])

    def assemble(chunk_rows: pa.Table, replies: pa.Table) -> pa.Table:
        id_type = chunk_rows.schema.field("docs").type.value_type
        doc_ids, lists = [pa.array([], id_type)], [pa.array([], pa.list_(pa.int32()))]
        for docs_of, data, route in zip(chunk_rows.column("docs"), chunk_rows.column("data"), chunk_rows.column("route").to_pylist()):
            if route >= 0:
                continue
            per_text, sequence = map(_numbers, _unpack(data.as_py()))
            size = int(sequence.max(initial=-1)) + 1
            counts, starts, flat, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [np.empty(0, np.int64)], 0
            for reply in replies.column("reply").to_pylist():
                numbers, sizes, ids = map(_numbers, _unpack(reply))
                numbers = np.cumsum(numbers)
                counts[numbers], starts[numbers] = sizes, at + np.cumsum(sizes) - sizes
                flat.append(ids)
                at += len(ids)
            ids = gather(np.concatenate(flat), starts[sequence], counts[sequence])
            ends = np.concatenate([[0], np.cumsum(counts[sequence])])[np.cumsum(per_text)]
            doc_ids.append(docs_of.values)
            lists.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)))
        return pa.table([pa.concat_arrays(doc_ids), pa.concat_arrays(lists)], ["doc_id", "ids"])

    sent = rows.mapInArrow(explode, f"route bigint, chunk bigint, docs array<{kind}>, data binary").repartition(buckets, "route")
    replies = sent.groupBy("route").applyInArrow(encode_bucket, "route bigint, reply binary")
    return sent.groupBy("route").cogroup(replies.groupBy("route")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded` (binary) added: each id joined with the token-byte table, in order.

    The table is bounded by the vocabulary and joined inside the tasks.  Null ids decode to null, no ids to no bytes; an
    id outside the table raises an error.
    """
    known = load_vocabulary(encoded.sparkSession, vocabulary, pattern)
    rows = encoded.drop("decoded")
    names = [f"c{i}" for i in range(len(rows.columns))]
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, ends = known.token_bytes()
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch, out = whole.slice(at, DECODED), []
                for ids in batch.column(place):
                    own = None if not ids.is_valid else np.asarray(ids.values)
                    out.append(None if own is None else gather(data, ends[own], ends[own + 1] - ends[own]).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    given = rows.toDF(*names)
    return given.mapInArrow(run, StructType([*given.schema, *StructType.fromDDL("decoded binary")])).toDF(*rows.columns, "decoded")
