"""Exact top-k by inner product with a pivot table.

Vectors are laid on a sphere by one more coordinate, so that the largest inner product is the smallest distance.  Each
row's distances to many pivots are computed once.  By the triangle inequality the largest difference between a row's and
a query's distances to a pivot is a lower bound of their distance; rows are evaluated in the order of that bound, and
the search stops when the bound rules out all that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.nearest import best_copies, best_of, block_search, usable

#: Rows evaluated between two looks at the bound.
STEP = 512


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision, as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def on_sphere(vectors: np.ndarray, radius: float) -> np.ndarray:
    return np.concatenate([vectors, np.sqrt(np.maximum(radius ** 2 - (vectors ** 2).sum(axis=1), 0))[:, None]], axis=1)


def fitted(pivots: np.ndarray, dims: int) -> np.ndarray:
    """Pivots as points of another number of dimensions: cut or filled up with zeros."""
    return np.pad(pivots[:, :dims], ((0, 0), (0, max(0, dims - pivots.shape[1]))))


def distances(points: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Distances of points on the sphere to the pivots, laid on it too."""
    on = on_sphere(fitted(pivots, points.shape[1] - 1), radius)
    return np.sqrt(np.maximum((points ** 2).sum(axis=1)[:, None] + (on ** 2).sum(axis=1) - 2 * points @ on.T, 0))


def pivot_table(rows: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """`rows` (vec_id, vector) with `extra`, the row's distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.empty((batch.num_rows, len(pivots)))
            flat, ends = np.asarray(batch.column(1).flatten()).astype(np.float64), np.cumsum(batch.column(1).value_lengths())
            sizes = np.diff(ends, prepend=0)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                points = flat[(ends[own] - size)[:, None] + np.arange(size)]
                table[own] = distances(on_sphere(points, radius), pivots, radius)
            lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, len(pivots), dtype=np.int32), table.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "vector", "extra"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, vector array<bigint>, extra array<double>")


def pivot_search(k: int, pivots: np.ndarray, radius: float) -> Callable:
    """The search within a shard: all rows' bounds from the pivot table, rows in the order of their bounds."""
    def search(ids, vectors, table, query_ids, queries, _):
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        unit = queries / np.maximum(lengths, 1e-300)[:, None] * radius
        theirs = distances(np.concatenate([unit, np.zeros((len(unit), 1))], axis=1), pivots, radius)
        # Rounding: two distances of up to 2 * radius, squared, with a margin far above double precision.
        margin = 1e-6 * radius
        for own, query, length, row in zip(query_ids.tolist(), queries, lengths, theirs):
            least = np.maximum(np.abs(table - row).max(axis=1) - margin, 0)
            most = length * (radius - least ** 2 / (2 * radius)) if radius else np.zeros(len(ids))
            order = np.argsort(-most, kind="stable")
            at, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            for i in range(0, len(order), STEP):
                if len(scores) == k and most[order[i]] + 1 < scores[-1]:
                    break
                some = order[i:i + STEP]
                all_at, all_scores = np.concatenate([at, some]), np.concatenate([scores, vectors[some] @ query])
                at, scores = best_of(ids, all_at, all_scores, own, k)
            yield at, scores

    return search


def exact_top(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, pivots: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where `queries` holds, the k highest inner products with all other rows.

    Components are floor(scale * x); products and scores are exact in 64 bits, and vectors so long that a score might not
    fit (a squared length over 2^62) are an error.  Vectors that are null, empty or hold
    null or non-finite components take no part, nor do null ids; zero vectors do.  Ties go to the smaller id; rows with
    equal vectors count as rows of their own; rows that repeat a query's id are its own.  Pivots are rows drawn by a
    hash of the id; any points give right results.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), zero=True))
    asked = rows.where(queries).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector"))
    own = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = own.agg(F.max(square)).first()[0] or 0.0
    if longest > 2.0**62:
        raise ValueError("a vector is too long for exact scores in 64 bits; choose a smaller scale")
    radius = float(np.sqrt(longest)) * (1 + 1e-9)
    drawn = [r[0] for r in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").collect()]
    width = max(map(len, drawn), default=1)
    points = np.array([v + [0] * (width - len(v)) for v in drawn] or [[0]], np.float64)
    return block_search(pivot_table(best_copies(own, k), points, radius), asked, k, pivot_search(k, points, radius), "bigint")
