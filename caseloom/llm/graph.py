"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Size and order-free checksum of a set of edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_stars(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    smallest = both.groupBy("hi").agg(F.min("lo").alias("m"))
    return (
        both.join(smallest, "hi").where(F.col("lo") > F.col("hi"))
        .select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo")).distinct()
    )


def _small_stars(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    smallest = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(smallest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(smallest.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another: root is the smallest node it can reach, itself included.

    Nodes are of any ordered type. Nulls and loops link nothing; repeated edges count once. No neighbour list is
    gathered: a node's smallest neighbour is a combined aggregate, and a hub's edges stay plain rows whose join AQE
    splits. Each round is written to the checkpoint folder; rounds end when the edges no longer change.
    """
    edges = cut_lineage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_small_stars(_large_stars(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
