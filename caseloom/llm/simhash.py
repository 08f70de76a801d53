"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that agree more often than chance are put into the same partition.  For each fingerprint a dynamic program
spreads `units` over the partitions: a partition with u units is probed up to radius u - 1, one without is not
probed.  With max_distance + 1 units no pair within max_distance is missed, since the distances to a pair's partner
cannot exceed every radius.  The program minimises the number of candidates, estimated from counts over all
fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from caseloom.llm.graph import components
from caseloom.session import cut_lineage

#: Shingles hashed at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 15
#: Members of a bucket compared in one place; a larger bucket is cut into blocks and each pair of blocks compared.
BUCKET = 100_000


def _hashes(data: bytes, size: int, words_from: int, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    last = min(words_from + BLOCK, max(1, len(starts) - size + 1))
    stop = [int(ends[min(i + size, len(ends)) - 1]) for i in range(words_from, last)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[i:j], 42) for i, j in zip(starts[words_from:last].tolist(), stop)), np.uint64, last - words_from)


def _spread(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The hashes widened to `bits` bits: the hash itself, then mixed copies of it."""
    parts = [hashes]
    for k in range(1, bits // 64):
        z = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        parts.append(z ^ (z >> np.uint64(31)))
    return np.stack(parts, axis=1)


def fingerprint(text: str | None, shingle: int, bits: int = 64) -> bytes:
    """Big-endian fingerprint of a whole text; without words all bits are 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(bits // 8)
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    counts, total = np.zeros(bits, np.int64), max(1, len(words) - shingle + 1)
    for i in range(0, total, BLOCK):
        wide = np.ascontiguousarray(_spread(_hashes(data, shingle, i, ends, ends - lengths), bits)).astype(">u8")
        flags = np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1)
        for j in range(0, len(flags), 255):
            counts += np.add.reduce(flags[j:j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp) of every row; words are lower-cased (A-Z) runs without ASCII white space, shingles keep repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *StructType.fromDDL("fp binary")]))


def _bits(column: pa.Array) -> np.ndarray:
    size = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(size, -1)
    return np.unpackbits(data, axis=1)


def bit_statistics(fps: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set; bits x bits figures reach the driver."""
    def run(batches):
        total, n = np.zeros((bits, bits), np.int64), 0
        for batch in batches:
            b = _bits(batch.column(0)).astype(np.float32)
            total += (b.T @ b).astype(np.int64)
            n += len(b)
        i, j = np.triu_indices(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * bits + j, -1)), pa.array(np.append(total[i, j], n))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both, n = np.zeros((bits, bits)), 0
    for cell, count in zip(rows["cell"], rows["n"]):
        if cell < 0:
            n = int(count)
        else:
            both[cell // bits, cell % bits] = both[cell % bits, cell // bits] = count
    return n, both


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of equal width; each takes, one at a time, the free bit that correlates most with its own bits."""
    bits = len(both)
    share = both / max(n, 1)
    p = np.diag(share).copy()
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(bits)), []
    for k in range(partitions):
        width = (bits - sum(map(len, out))) // (partitions - k)
        chosen = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(chosen[0])
        while len(chosen) < width:
            best = max(free, key=lambda b: (corr[b, chosen].sum(), -b))
            chosen.append(best)
            free.discard(best)
        out.append(chosen)
    return out


def _value(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    value = np.zeros(len(bits), np.int64)
    for b in chosen:
        value = (value << 1) | bits[:, b]
    return value


def _pieces(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each partition cut into pieces of at most 10 bits, whose value counts fit a small table."""
    return [[g[i:i + -(-len(g) // -(-len(g) // 10))] for i in range(0, len(g), -(-len(g) // -(-len(g) // 10)))] for g in groups]


def value_counts(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """How often each value of each piece of a partition occurs, over all fingerprints."""
    pieces = _pieces(groups)

    def run(batches):
        tables = {(i, k): np.zeros(1 << len(p), np.int64) for i, ps in enumerate(pieces) for k, p in enumerate(ps)}
        for batch in batches:
            b = _bits(batch.column(0))
            for (i, k), table in tables.items():
                table += np.bincount(_value(b, pieces[i][k]), minlength=len(table))
        for (i, k), table in tables.items():
            v = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), i)), pa.array(np.full(len(v), k)), pa.array(v), pa.array(table[v])], ["part", "piece", "value", "n"])

    rows = fps.select("fp").mapInArrow(run, "part bigint, piece bigint, value bigint, n bigint")
    rows = rows.groupBy("part", "piece", "value").agg(F.sum("n").alias("n")).toPandas()
    tables = {(i, k): np.zeros(1 << len(p)) for i, ps in enumerate(pieces) for k, p in enumerate(ps)}
    for (i, k), part in rows.groupby(["part", "piece"]):
        tables[i, k][part["value"].to_numpy()] = part["n"]
    return tables


def _balls(table: np.ndarray, radius: int) -> np.ndarray:
    """Row r: how many fingerprints differ from each value in exactly r of the piece's bits."""
    width, values = len(table).bit_length() - 1, np.arange(len(table))
    return np.stack([
        sum((table[values ^ sum(1 << b for b in flip)] for flip in combinations(range(width), r)), np.zeros(len(table)))
        for r in range(min(radius, width) + 1)
    ])


def candidate_costs(n: int, tables: dict, groups: list[list[int]], radius: int) -> list[list[np.ndarray]]:
    """Per partition and piece: share of fingerprints at each distance from a value; pieces count as independent."""
    return [[_balls(tables[i, k], radius) / max(n, 1) for k in range(len(ps))] for i, ps in enumerate(_pieces(groups))]


def allocate(bits: np.ndarray, n: int, shares: list[list[np.ndarray]], groups: list[list[int]], units: int, radius: int) -> np.ndarray:
    """Units of each partition for each fingerprint (rows): the cheapest way to spend exactly `units`."""
    pieces, rows = _pieces(groups), len(bits)
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for i, group in enumerate(groups):
        at = np.zeros((rows, radius + 1))
        at[:, 0] = 1
        for k, piece in enumerate(pieces[i]):
            own, new = shares[i][k][:, _value(bits, piece)], np.zeros_like(at)
            for r in range(radius + 1):
                for s in range(min(r, len(own) - 1) + 1):
                    new[:, r] += at[:, r - s] * own[s]
            at = new
        cost = np.cumsum(at, axis=1) * n + np.cumsum([comb(len(group), r) for r in range(radius + 1)])
        options = [best] + [np.concatenate([np.full((rows, u), np.inf), best[:, :units + 1 - u] + cost[:, u - 1:u]], axis=1) for u in range(1, radius + 2)]
        stacked = np.stack(options)
        choices.append(stacked.argmin(axis=0))
        best = stacked.min(axis=0)
    out, left = np.zeros((rows, len(groups)), np.int64), np.full(rows, units)
    for i in reversed(range(len(groups))):
        out[:, i] = choices[i][np.arange(rows), left]
        left -= out[:, i]
    return out


def _flips(group: list[int], distance: int) -> list[int]:
    return [sum(1 << b for b in f) for f in combinations(range(len(group)), distance)]


def bucket_rows(fps: DataFrame, n: int, shares: list, groups: list[list[int]], units: int, radius: int) -> DataFrame:
    """(part, key, probe, fp): an index row in each partition, and a probe row for each value within a radius.

    A probe of radius 0 is the index row itself, marked 1; other probes are marked 2, plain index rows 0.
    """
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            b = _bits(column)
            given = allocate(b, n, shares, groups, units, radius)
            for i, group in enumerate(groups):
                own = _value(b, group)
                yield _rows(i, own, (given[:, i] > 0).astype(np.int8), column)
                for r in range(1, int(given[:, i].max(initial=0))):
                    wide = np.flatnonzero(given[:, i] > r)
                    if len(wide):
                        some = column.take(pa.array(wide))
                        for flip in _flips(group, r):
                            yield _rows(i, own[wide] ^ flip, np.full(len(wide), 2, np.int8), some)

    def _rows(part, keys, probe, column):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(probe), column], ["part", "key", "probe", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key bigint, probe tinyint, fp binary")


def _forest(words: np.ndarray, probe: np.ndarray, most: int) -> tuple[list, list]:
    """Spanning forest of the links between a bucket's probes and index rows: fewer links than members."""
    left, right, todo = [], [], np.arange(len(words))
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = np.bitwise_count(words[todo] ^ words[at]).sum(axis=1) <= most
            near &= ((probe[at] < 2) & (probe[todo] > 0)) | ((probe[at] > 0) & (probe[todo] < 2))
            found = todo[near]
            left += [at] * len(found)
            right += found.tolist()
            queue += found.tolist()
            todo = todo[~near]
    return left, right


def _links(words: np.ndarray, probe: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each bucket [starts[i], starts[i+1]): small ones side by side, large ones one at a time."""
    sizes, left, right = np.diff(starts), [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
        first = starts[:-1][sizes == size]
        for i, j in combinations(range(size), 2):
            a, b = first + i, first + j
            ok = ((probe[a] < 2) & (probe[b] > 0)) | ((probe[a] > 0) & (probe[b] < 2))
            a, b = a[ok], b[ok]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= most
            left.append(a[near])
            right.append(b[near])
    for i in np.flatnonzero(sizes > 8):
        a, b = _forest(words[starts[i]:starts[i + 1]], probe[starts[i]:starts[i + 1]], most)
        left.append(np.array(a, np.int64) + starts[i])
        right.append(np.array(b, np.int64) + starts[i])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _cells(rows: DataFrame, bucket: int) -> DataFrame:
    """Buckets over `bucket` rows cut into blocks; a row goes to the cell of its block with each other block."""
    sizes = rows.groupBy("part", "key").count().where(F.col("count") > bucket)
    blocks = (F.ceil(F.col("count") / bucket) + 1).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(blocks, F.lit(1))).cast("int")
    rows = rows.join(sizes, ["part", "key"], "left").withColumn("own", own)
    other = F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    return (
        rows.withColumn("other", other)
        .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "probe", "fp")
    )


def links(rows: DataFrame, max_distance: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): verified links that connect whatever the buckets connect, fewer than a bucket has members."""
    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            key = np.stack([np.asarray(table.column(c), np.int64) for c in ("part", "key", "i", "j")], axis=1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(change) == 0:
                kept = table
                continue
            kept = table.slice(int(change[-1]))
            yield from linked(table.slice(0, int(change[-1])), np.concatenate([[0], change]))
        if kept is not None:
            yield from linked(kept, np.array([0, kept.num_rows]))

    def linked(table, starts):
        values = table.column("fp").combine_chunks()
        data = b"".join(values.to_pylist())
        words = np.frombuffer(data, np.uint64).reshape(table.num_rows, -1)
        a, b = _links(words, np.asarray(table.column("probe")), starts, max_distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([values.take(pa.array(a)), values.take(pa.array(b))], ["a", "b"])

    cells = _cells(rows, bucket)
    dealt = cells.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def near_groups(
    fps: DataFrame, max_distance: int, bits: int = 64, partitions: int = 3, units: int | None = None, radius: int = 2, bucket: int = BUCKET,
) -> DataFrame:
    """(fp, root) of distinct fingerprints linked to another within `max_distance` bits, by their components.

    With `units` = max_distance + 1 (the default) every link is found.  Fewer units give a wide fingerprint's links
    with certainty up to units - 1 bits and with growing odds the nearer a pair is; every link is verified.  Equal
    fingerprints come as one row, so copies cost nothing.  A bucket's links form a spanning forest: a group of n
    near copies gives fewer than n links per partition, never all pairs.
    """
    units = max_distance + 1 if units is None else units
    n, both = bit_statistics(fps, bits)
    groups = group_bits(n, both, partitions)
    radius = min(radius, units - 1)
    shares = candidate_costs(n, value_counts(fps, groups), groups, radius)
    rows = bucket_rows(fps, n, shares, groups, units, radius)
    return components(links(rows, max_distance, bucket)).withColumnsRenamed({"node": "fp"})


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, max_distance: int = 2,
    partitions: int = 3, units: int | None = None, radius: int = 2, bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id its fingerprint can reach.

    Null and empty texts have the zero fingerprint, linked like any other.  Rows with equal texts share a fingerprint;
    rows that repeat an id keep one row each.  A null id gets the smallest id of its group, or null if there is none.
    Other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle, bits))
    own = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = near_groups(own, max_distance, bits, partitions, units, radius, bucket)
    rooted = own.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def document_key(id_col: str, text_col: str) -> Column:
    """Rows in the order of their ids, nulls last, then of their text's digest."""
    missing, digest = F.col(f"`{id_col}`").isNull(), F.sha1(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return F.struct(missing.alias("missing"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))


def stand_for(docs: DataFrame, key: Column, groups: DataFrame) -> DataFrame:
    """One row of `docs` for each document_key in `component_id` of `groups`.  Texts are shuffled once, by id and digest."""
    stay = groups.select("component_id.*").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k")).select("row", "k.*")
    same = whole["missing"].eqNullSafe(stay["missing"]) & whole["id"].eqNullSafe(stay["id"]) & (whole["digest"] == stay["digest"])
    first = F.row_number().over(Window.partitionBy("missing", "id", "digest").orderBy(F.lit(0)))
    return whole.join(stay, same, "left_semi").withColumn("n", first).where("n = 1").select("row.*")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that stand for their group of near fingerprints: those with the smallest id, then text digest.

    A null id comes last.  Of rows that agree in id and text one stays.
    """
    key = document_key(id_col, text_col)
    groups = simhash_components(docs.select(key.alias("doc_key"), F.col(f"`{text_col}`").alias("doc_text")), "doc_key", "doc_text", **settings)
    return stand_for(docs, key, groups)
