"""The prefix trie against plain recursion."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm.trie import end_digests, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, group=5, most=9):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    mixed = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % most, c - c % group
        mixed[c] = own if base == c else convs.get(base, [])[:h] + own[h:]
    member = defaultdict(list)
    for c, turns in mixed.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in member:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(member, key=len, reverse=True):
        own = (len(member[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
    ends = {n: ",".join(str(c) for c in sorted(m) if len(mixed[c]) == len(n)) for n, m in member.items()}
    return sorted(
        (min(m), len(n), min(member[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in member.items())


def conversations(n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(("user", None, "assistant")), rng.choice(("é", "yes", None, "no", ""))))
    rows += [(200, i, "user", "same") for i in range(700)] + [(205, i, "user", "same") for i in range(400)]
    rows += [(210, 1, "user", "again")] * 40 + [(None, 1, "user", "lost")]
    return rows


def found(table, **settings):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie(table, **settings).select(*names).collect())


@pytest.mark.parametrize("small", [4096, 40, 1])
def test_trie_matches_plain_recursion(spark, small):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).withColumns({"node": F.lit(1), "weight": F.lit("x"), "place": F.lit(2)})
    assert found(table, small=small) == plain_trie(rows)


def test_a_third_of_all_conversations_are_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1000, 5) for t in range(6)] + [(c, 0, "user", f"own {c}") for c in range(1000, 2000, 5)]
    assert found(spark.createDataFrame(rows, TURNS), small=8) == plain_trie(rows)


@pytest.mark.parametrize("small", [4096, 2])
def test_ids_of_any_size(spark, small):
    """Ids that doubles cannot tell apart."""
    first = (1 << 60) // 5 * 5
    rows = [(first + c, t, "user", f"turn {t + c // 7}") for c in range(30) for t in range(3)]
    assert found(spark.createDataFrame(rows, TURNS), small=small) == plain_trie(rows)


def test_turnless_conversations_and_nothing(spark):
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 6, 7, 8)]
    assert found(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    assert any(len(r) and r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain_trie(rows))
    assert found(spark.createDataFrame([], TURNS)) == []


def test_digests_run_over_many_pieces(spark):
    ends = spark.range(50_000).select(F.lit(0).cast("bigint").alias("conv"), F.lit(3).cast("bigint").alias("depth"), F.col("id").alias("conv_id")).repartition(7)
    assert [tuple(r) for r in end_digests(ends).collect()] == [(0, 3, hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest())]
