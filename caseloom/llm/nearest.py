"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are laid on a sphere by one more coordinate, so that the largest inner product is the smallest distance.  Each
of many random projections is a sorted array.  A query opens a window around its own projection in every array and
widens all of them by a constant factor (virtual rehashing) until enough vectors lie in the window of most arrays;
those vectors are verified by their exact inner product.  As the widening of one query is a good guess for the next one,
few widenings are counted for each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a shard and queries of a block that meet in one task.
SHARD, BLOCK = 8192, 1024


def usable(vector: Column, zero: bool) -> Column:
    """A vector that takes part: not null, with finite components only, and not all 0 unless `zero` is set."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
    return ok if zero else ok & F.exists(vector, lambda x: x != 0)


def best_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors the k + 1 smallest ids: no other copy can be among k results, own row excluded.

    The limit is applied before the shuffle, so a vector that a third of all rows share is no hot key.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    return vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")


def block_search(data: DataFrame, queries: DataFrame, k: int, search: Callable, score_type: str, seed: int = 0) -> DataFrame:
    """The k best of every query over all rows of `data` (vec_id, vector, ...): each shard meets each block of queries.

    Of query rows that repeat an id the one with the smallest vector is asked.
    `search(ids, vectors, extra, query_ids, query_vectors, query_extra)` gives for each query the positions and scores
    of its best rows of a shard.  A shard's best k per query are merged by rank; vectors meet queries of their length.
    """
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, q = data.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))

    def dealt(rows: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return (
            rows.withColumn("dim", F.size("vector")).withColumn(own, F.pmod(F.xxhash64(F.col("vec_id"), F.lit(seed)), F.lit(count)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        )

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        columns = [[], [], []]
        if rows.num_rows and asked.num_rows:
            ids, theirs = np.asarray(rows.column("vec_id")), np.asarray(asked.column("vec_id"))
            order = np.argsort(ids, kind="stable")
            found = search(ids[order], matrix(rows)[order], extra(rows, order), theirs, matrix(asked), extra(asked, slice(None)))
            for query, (at, scores) in zip(theirs.tolist(), found):
                columns[0].append(np.full(len(at), query))
                columns[1].append(ids[order][at])
                columns[2].append(scores)
        kinds = [pa.int64(), pa.int64(), pa.int64() if score_type == "bigint" else pa.float64()]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    def matrix(table: pa.Table) -> np.ndarray:
        values = table.column("vector").combine_chunks()
        return np.asarray(values.flatten()).reshape(table.num_rows, -1)

    def extra(table: pa.Table, order) -> np.ndarray | None:
        if "extra" not in table.column_names:
            return None
        return np.asarray(table.column("extra").combine_chunks().flatten()).reshape(table.num_rows, -1)[order]

    left = dealt(data, "shard", shards, "block", blocks).groupBy("dim", "shard", "block")
    right = dealt(queries, "block", blocks, "shard", shards).groupBy("dim", "shard", "block")
    hits = left.cogroup(right).applyInArrow(meet, f"query_id bigint, vec_id bigint, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, at: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best positions, largest score first and ties by id (positions are in order of ids), without the query's own."""
    keep = ids[at] != own
    at, scores = at[keep], scores[keep]
    if len(at) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        at, scores = at[near], scores[near]
    order = np.lexsort((at, -scores))[:k]
    return at[order], scores[order]


def collision_search(
    k: int, arrays: int = 64, threshold: float = 0.75, verified: float = 0.2, least: int = 1024, width: float = 0.1, growth: float = 1.5, seed: int = 11,
) -> Callable:
    """The search within a shard: widen until `k` plus the share `verified` of the shard, but at least `least` vectors,
    collide in at least the share `threshold` of the arrays, then verify those that do."""
    def search(ids, vectors, _, query_ids, queries, __):
        data, asked = vectors.astype(np.float64), queries.astype(np.float64)
        n, dims = data.shape
        norms = np.sqrt((data ** 2).sum(axis=1))
        radius = norms.max()
        sphere = np.concatenate([data, np.sqrt(np.maximum(radius ** 2 - norms ** 2, 0))[:, None]], axis=1) / radius
        ask = np.concatenate([asked / np.sqrt((asked ** 2).sum(axis=1))[:, None], np.zeros((len(asked), 1))], axis=1)
        lines = np.random.default_rng(seed).normal(size=(dims + 1, arrays))
        project, centres = (sphere @ lines).T, ask @ lines
        order = np.argsort(project, axis=1, kind="stable")
        values = np.take_along_axis(project, order, axis=1)
        need, enough = int(np.ceil(threshold * arrays)), min(n, max(least, k + 1 + int(verified * n)))

        # A row collides where its place lies in the window: one comparison, as places below the window wrap around.
        kind = np.uint16 if n < 1 << 16 else np.uint32
        places = np.empty((arrays, n), kind)
        np.put_along_axis(places, order, np.arange(n, dtype=kind)[None, :], axis=1)
        moved, inside, windows = np.empty((arrays, n), kind), np.empty((arrays, n), bool), []

        def colliding(query: int, step: int) -> np.ndarray:
            while len(windows) <= step:
                reach = windows[-1][0] * growth if windows else width
                low, high = (
                    np.stack([np.searchsorted(values[j], centres[:, j] + by, side) for j in range(arrays)], axis=1)
                    for by, side in ((-reach, "left"), (reach, "right")))
                windows.append((reach, low.astype(kind)[:, :, None], (high - low).astype(kind)[:, :, None]))
            _, low, size = windows[step]
            np.subtract(places, low[query], out=moved)
            np.less(moved, size[query], out=inside)
            return np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if arrays < 256 else np.int64) >= need)

        step = 0
        for i, own in enumerate(query_ids.tolist()):
            # The first step with enough, sought from that of the query before.
            at = colliding(i, step)
            while len(at) >= enough and step and len(less := colliding(i, step - 1)) >= enough:
                at, step = less, step - 1
            while len(at) < enough:
                step += 1
                at = colliding(i, step)
            yield best_of(ids, at, (data[at] * asked[i]).sum(axis=1), own, k)

    return search


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where `queries` holds, the k nearest of all other rows by inner product.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids.  Rows with
    equal vectors count as rows of their own, ties go to the smaller id; rows that repeat a query's id are its own.
    Scores are double precision sums over the given components.  The search is approximate: it verifies the share
    `verified` of each shard (see collision_search) and its recall is measured against brute force in the tests.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), zero=False))
    asked = rows.where(queries).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    data = best_copies(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector")), k)
    return block_search(data, asked, k, collision_search(k, **settings), "double")
