"""Removal of repeated passages: every window of a fixed number of words is hashed and counted over all documents.

The documents are dealt into chunks once.  A chunk sends each bucket the distinct Rabin-Karp hashes of its windows,
counted before the shuffle, so a passage that a third of all documents share costs one hash per chunk.  A bucket answers
each chunk with one bit per hash: whether another chunk has it too.  The chunk, whose exchange is reused, then knows its
repeated windows and merges them into maximal intervals of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Odd multipliers of the two rolling hashes, modulo 2^64: one names the window, the other its bucket.
NAME_BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text in a chunk and, at some six bytes a word, in the windows of a bucket.
CHUNK, BUCKET = 8 << 20, 12 << 20
ANSWER = "chunk bigint, bucket bigint, flags binary"


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def rolling(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each window of word hashes, from prefix sums: hash(i) = (P(i + window) - P(i)) * base^i."""
    n = len(words)
    if n < window:
        return np.empty(0, np.uint64)
    power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * inverse, out=prefix[1:])
    return _mixed((prefix[window:] - prefix[:-window]) * power[:n - window + 1])


def chunk_windows(texts: pa.ChunkedArray, window: int, buckets: int) -> dict:
    """All windows of a chunk: distinct ones by bucket and hash, which window is which, and where each begins."""
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = words_of(text.as_py())
        sizes[i] = len(words)
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    words = np.concatenate([np.empty(0, np.uint64), *parts])
    ends = np.cumsum(sizes)
    names = rolling(words, window, NAME_BASE)
    at = np.arange(len(names))
    inside = at + window <= ends[np.searchsorted(ends, at, side="right")] if len(names) else np.zeros(0, bool)
    at, names = at[inside], names[inside]
    bucket = (rolling(words, window, BUCKET_BASE)[inside] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((names, bucket))
    names, bucket = names[order], bucket[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (bucket[1:] != bucket[:-1])
    which = np.empty(len(names), np.int64)
    which[order] = np.cumsum(new) - 1
    return {"sizes": sizes, "at": at, "which": which, "names": names[new], "bucket": bucket[new], "times": np.diff(np.append(np.flatnonzero(new), len(names)))}


def _packed(names: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that leading zeros compress in the shuffle."""
    return np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def covered(starts: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [from, to) of the words of n that windows beginning at `starts` (ascending) cover."""
    if len(starts) == 0:
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + window


def find_repeats(
    docs: DataFrame, text_col: str = "text", window: int = 35, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET,
) -> DataFrame:
    """The rows of `docs` with n_words, n_removed, removed and kept_text added (they replace columns of those names).

    A word goes if a window of `window` words covers it whose word sequence also begins elsewhere, in the same text
    or another; windows are judged on the input.  `removed` holds the maximal intervals [from, to) of word numbers,
    kept_text the other words joined by one space.  Null and empty texts have no words; a repeated row is a repetition
    like any other.  Two windows count as equal if two 64-bit hashes agree, one of them modulo the number of buckets;
    as that number grows with the input, a false match stays unlikely at every size (about 1 in 10 million per bucket).
    """
    rows = docs.drop("n_words", "n_removed", "removed", "kept_text")
    # A data-dependent count of chunks: their number follows the bytes of text, so a chunk's memory does not grow.
    total = rows.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    others = [c for c in rows.columns if c != text_col]
    kept = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    text = F.col(f"`{text_col}`").cast("string")
    dealt = (
        rows.select(text.alias("text"), kept.alias("row"))
        # Rows that repeat as a whole are dealt by the partition they lie in too, so that their copies share no chunk.
        .withColumn("chunk", F.pmod(F.xxhash64("text", F.to_json("row"), F.spark_partition_id()), F.lit(chunks)))
        .repartition(chunks, "chunk")
    )

    def send(table: pa.Table) -> pa.Table:
        found, chunk = chunk_windows(table.column("text"), window, buckets), table.column("chunk")[0].as_py()
        names = found["names"]
        cut = np.searchsorted(found["bucket"], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        blobs = [_packed(names[cut[b]:cut[b + 1]]) for b in full]
        return pa.table([pa.array(np.full(len(full), chunk)), pa.array(full), pa.array(blobs, pa.binary())], ["chunk", "bucket", "names"])

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in table.column("names").to_pylist()]
        order = np.argsort(names := np.concatenate(parts), kind="stable")
        same = names[order][1:] == names[order][:-1]
        shared = np.zeros(len(names), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        flags = [np.packbits(f).tobytes() for f in np.split(shared, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(flags, pa.binary())], ["chunk", "bucket", "flags"])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = chunk_windows(table.column("text"), window, buckets)
        repeated = found["times"] > 1
        for bucket, flags in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist()):
            a, b = np.searchsorted(found["bucket"], [bucket, bucket + 1])
            repeated[a:b] |= np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a).astype(bool)
        starts = found["at"][repeated[found["which"]]]
        ends = np.cumsum(found["sizes"])
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        removed, counts, texts = [], [], []
        for i, text in enumerate(table.column("text")):
            size, words = int(found["sizes"][i]), words_of(text.as_py())
            begin, end = covered(starts[bounds[i]:bounds[i + 1]] - (ends[i] - size), window, size)
            keep, at = [], 0
            for b, e in zip(begin.tolist(), end.tolist()):
                keep += words[at:b]
                at = e
            texts.append(b" ".join(keep + words[at:]).decode("utf-8", "surrogatepass"))
            removed.append([{"from": b, "to": e} for b, e in zip(begin.tolist(), end.tolist())])
            counts.append(int((end - begin).sum()))
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table(
            [table.column("row"), table.column("text"), pa.array(found["sizes"]), pa.array(counts, pa.int64()), pa.array(removed, span), pa.array(texts, pa.string())],
            ["row", "text", "n_words", "n_removed", "removed", "kept_text"])

    sent = dealt.groupBy("chunk").applyInArrow(send, "chunk bigint, bucket bigint, names binary")
    # As many partitions as buckets: what a task reads does not grow with the input.
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, ANSWER)
    added = "text string, n_words bigint, n_removed bigint, removed array<struct<from: bigint, to: bigint>>, kept_text string"
    schema = StructType([dealt.schema["row"], *StructType.fromDDL(added)])
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, schema)
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in rows.columns]
    return out.select(*columns, "n_words", "n_removed", "removed", "kept_text")
