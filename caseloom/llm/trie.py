"""The prefix trie of conversations, with subtree totals by centroid decomposition.

A node is a sequence of first turns, named by its smallest conversation and its depth.  Its weight is the number of its
conversations, so the weight of a whole subtree is known from the turns themselves: each member adds its turns from
there on.  In a component, the nodes whose subtrees weigh more than half of it are the path from its top down to its
centroid.  Each round cuts all components at their centroids, totals the part below each centroid, and adds that total
to the nodes of the path; components halve, so the rounds follow the logarithm of the rows and not the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.operators.places import running, with_places
from caseloom.session import cut_lineage

#: Weight up to which a component is finished inside one task, by the same cuts; and rows of such components dealt to a task.
SMALL, DEALT = 4096, 100_000
EMPTY = hashlib.sha256(b"").hexdigest()


def mixed_conversations(
    conversations: DataFrame, group: int = 5, most: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): each conversation c begins with the first h turns of conversation c - c % group instead of its own.

    h is the CRC-32 of c in decimal, modulo `most`.  turns has conv_id, place, role and text, lengths has conv_id and the
    number of turns, also of conversations left without any.  Turns are in the order of turn (null first), role and text.
    """
    given = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    turns = cut_lineage(with_places(given, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "place", "role", "text"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    plan = counts.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs"))
    taken = F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.least("h", F.coalesce("theirs", F.lit(0))))
    skipped = F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.col("h"))
    plan = cut_lineage(plan.join(bases, "base", "left").select("conv_id", "base", "own", taken.alias("taken"), skipped.alias("skipped")))
    heads = turns.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base")
    head = heads.join(plan.where("taken > 0"), "base").where("place < taken").select("conv_id", "place", "role", "text")
    tail = turns.join(plan, "conv_id").where("place >= skipped").select("conv_id", (F.col("place") - F.col("skipped") + F.col("taken")).alias("place"), "role", "text")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("skipped"), F.lit(0))).alias("turns"))
    return head.union(tail), lengths


def members(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, turns, node, up, n_convs, bytes, weight): each conversation at each of its depths, written.

    node is the smallest conversation that begins alike, up that of one turn less.  The other figures stand only where
    the conversation is the node's own name.  Sequences are told by two 64-bit hashes of all their turns and places.
    """
    place = F.col("place")
    one, two = (F.xxhash64(F.lit(seed), place, "role", "text") for seed in (1, 2))
    rows = turns.select("conv_id", "place", one.alias("h1"), two.alias("h2"), F.octet_length("text").cast("bigint").alias("bytes"))
    rows = running(rows, ["conv_id"], k1=("bit_xor", F.col("h1")), k2=("bit_xor", F.col("h2")))
    at = rows.join(lengths, "conv_id").select("conv_id", (place + 1).alias("depth"), "turns", "k1", "k2", "bytes")
    root = lengths.select("conv_id", F.lit(0).cast("bigint").alias("depth"), "turns", F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("bytes"))
    at = cut_lineage(root.union(at))
    nodes = at.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"))
    # Written first, so that the join has plain exchanges on both sides and Spark can split a first turn that most share.
    named = at.join(cut_lineage(nodes), ["depth", "k1", "k2"]).select("conv_id", "depth", "turns", "node", "n_convs", "weight", "bytes")
    named = cut_lineage(named)
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    return cut_lineage(named.join(above, ["conv_id", "depth"], "left"))


def _finish(nodes: pa.Table, names: list[str]) -> pa.Table:
    """The totals of whole small components, cut by cut as between tasks."""
    conv, depth, top, top_depth, up, w = (np.asarray(nodes.column(c)) for c in ("conv", "depth", "top", "top_depth", "up", "w"))
    n = len(conv)
    number = {key: i for i, key in enumerate(zip(conv.tolist(), depth.tolist()))}
    comp = np.array([number[key] for key in zip(top.tolist(), top_depth.tolist())])
    parent = np.array([i if comp[i] == i else number[key] for i, key in enumerate(zip(up.tolist(), (depth - 1).tolist()))])
    own = {c: np.asarray(nodes.column(c)) for c in names}
    total = {c: np.asarray(nodes.column(f"s_{c}")).copy() for c in names}
    w, left = w.copy(), np.arange(n)
    while len(left):
        heavy = left[2 * w[left] > w[comp[left]]]
        heavy = heavy[np.argsort(depth[heavy], kind="stable")]
        centre = np.full(n, -1)
        centre[comp[heavy]] = heavy
        mine = np.full(n, -1)
        mine[left] = centre[comp[left]]
        starts = (left == mine[left]) | (parent[left] == mine[left]) | (left == comp[left])
        link = parent.copy()
        link[left[starts]] = left[starts]
        while (link[left] != link[link[left]]).any():
            link[left] = link[link[left]]
        below = left[(link[left] == mine[left]) | ((link[left] != comp[left]) & (parent[link[left]] == mine[left]))]
        below = np.union1d(below, centre[centre >= 0])
        for c in names:
            under = np.zeros(n, np.int64)
            np.add.at(under, mine[below], own[c][below])
            total[c][heavy] += under[mine[heavy]]
        path = heavy[heavy != mine[heavy]]
        w[path] -= w[mine[path]]
        comp[left] = link[left]
        left = left[left != mine[left]]
    return pa.table([nodes.column("conv"), nodes.column("depth"), *[pa.array(total[c]) for c in names]], ["conv", "depth", *[f"s_{c}" for c in names]])


def subtree_totals(nodes: DataFrame, at: DataFrame, names: list[str], small: int = SMALL) -> DataFrame:
    """(conv, depth, s_<name> ...): for each node the sums of the columns `names` over its subtree, itself included.

    `nodes` has conv, depth, up (the parent's conv), weight (of the subtree), n_convs (its own) and `names`; `at` says
    which node (node, up) a conversation has at a depth.  Components heavier than `small` are cut between tasks: their
    centroids are few, and the nodes below one find their new component by its depth.  A chain of n turns or a node with
    most conversations is cut like any other component.  Lighter components are finished inside tasks.
    """
    sums = [f"s_{c}" for c in names]
    tops = nodes.where("depth = 0").select(F.col("conv").alias("top"), F.lit(0).cast("bigint").alias("top_depth"), F.col("weight").alias("total"))
    top = tops.first()
    if top is None:
        return nodes.select("conv", "depth", *[F.col(c).alias(s) for c, s in zip(names, sums)])
    # The root has no parent; a number in its place keeps the column whole, so that ids of any size stay exact in tasks.
    state = nodes.select(
        "conv", "depth", F.coalesce("up", F.lit(0)).alias("up"), F.lit(top.top).alias("top"), F.lit(0).cast("bigint").alias("top_depth"), F.col("weight").alias("w"), F.lit(top.total).alias("total"),
        F.col("n_convs").alias("one"), *names, *[F.lit(0).cast("bigint").alias(s) for s in sums])
    known = at.select(F.col("conv_id").alias("conv"), F.col("depth").alias("look"), F.col("node").alias("to"), F.col("up").alias("to_up"))
    done, finished = [], []
    comp = ["top", "top_depth"]
    while True:
        heavy = F.col("total") > small
        finished.append(state.where(~heavy))
        state = state.where(heavy)
        if state.isEmpty():
            break
        centre = F.max(F.struct("depth", "conv", "w")).alias("c")
        centres = state.where(2 * F.col("w") > F.col("total")).groupBy(*comp).agg(centre)
        seen = state.join(centres, comp).withColumn("look", F.least(F.col("depth"), F.col("c.depth") + 1)).join(known, ["conv", "look"])
        is_centre = (F.col("depth") == F.col("c.depth")) & (F.col("conv") == F.col("c.conv"))
        below = (F.col("depth") > F.col("c.depth")) & (F.col("to_up") == F.col("c.conv"))
        seen = cut_lineage(seen.select(
            *state.columns, F.col("c.w").alias("c_w"), is_centre.alias("is_centre"), below.alias("below"), (2 * F.col("w") > F.col("total")).alias("path"),
            F.when(below, F.col("to")).otherwise(F.col("top")).alias("new_top"), F.when(below, F.col("look")).otherwise(F.col("top_depth")).alias("new_depth")))
        under = seen.where("below OR is_centre").groupBy(*comp).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
        totals = seen.where("NOT is_centre").groupBy("new_top", "new_depth").agg(F.sum("one").alias("new_total"))
        moved = seen.join(under, comp).join(totals, ["new_top", "new_depth"], "left")
        moved = moved.select(
            "conv", "depth", "up", F.col("new_top").alias("top"), F.col("new_depth").alias("top_depth"),
            F.when(F.col("path"), F.col("w") - F.col("c_w")).otherwise(F.col("w")).alias("w"), F.col("new_total").alias("total"), "one", *names,
            *[(F.col(s) + F.when(F.col("path"), F.col(f"t_{c}")).otherwise(0)).alias(s) for c, s in zip(names, sums)], "is_centre")
        moved = cut_lineage(moved)
        done.append(moved.where("is_centre").select("conv", "depth", *sums))
        state = moved.where("NOT is_centre").drop("is_centre")
    light = finished[0]
    for more in finished[1:]:
        light = light.union(more)
    light = cut_lineage(light)
    buckets = max(1, -(-light.count() // DEALT))
    dealt = light.withColumn("bucket", F.pmod(F.xxhash64(*comp), F.lit(buckets)))
    schema = "conv bigint, depth bigint, " + ", ".join(f"{s} bigint" for s in sums)
    out = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: _finish(table, names), schema)
    for more in done:
        out = out.union(more)
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of the nodes (conv, depth) at which conversations (conv_id) end: their ids, ascending.

    Ids are sorted by ranges and joined to pieces in many tasks; a node's pieces then run through one digest, piece by
    piece, so a node where most conversations end is never held in memory.
    """
    sort = ["conv", "depth", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, ids = (np.asarray(c) for c in batch.columns)
            cut = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])])) if len(conv) else []
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, cut[1:])] if len(conv) else []
            yield pa.RecordBatch.from_arrays([pa.array(conv[cut]), pa.array(depth[cut]), pa.array(ids[cut]), pa.array(texts, pa.string())], [*sort, "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (conv, depth) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (conv, depth), hashlib.sha256()
                    digest.update(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield table(out)
        yield table([(*now, digest.hexdigest())] if now else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["conv", "depth", "ends_sha256"])

    joined = ends.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(pieces, "conv bigint, depth bigint, conv_id bigint, ids string")
    return joined.repartition("conv", "depth").sortWithinPartitions(*sort).mapInArrow(digests, "conv bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, most: int = 9, small: int = SMALL, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Conversations are mixed first (see mixed_conversations).  A node is a distinct sequence of first turns (role, text),
    from the root of depth 0 on; null roles and texts are empty, rows with a null conversation id take no part, repeated
    rows are turns of their own.  n_leaves and saved_tokens are totals of subtrees: nodes without children, and the
    bytes of each node's last text times its conversations but one.  Without conversations there is no root.
    """
    turns, lengths = mixed_conversations(conversations, group, most, **columns)
    at = members(cut_lineage(turns), lengths)
    own = at.where("conv_id = node").withColumnRenamed("conv_id", "conv")
    children = own.where("depth > 0").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = own.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.select(
        "conv", "depth", "up", "weight", "n_convs", "n_children", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    named = at.join(own.select(F.col("conv").alias("conv_id")).distinct(), "conv_id", "left_semi")
    totals = subtree_totals(nodes, named, ["leaf", "saved"], small)
    digests = end_digests(at.where("depth = turns").select(F.col("node").alias("conv"), "depth", "conv_id"))
    return nodes.join(totals, ["conv", "depth"]).join(digests, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("s_leaf").alias("n_leaves"), F.col("s_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
