"""Components, SimHash groups and repeated passages against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import simhash
from caseloom.llm.graph import components
from caseloom.llm.substrings import covered, find_repeats

DOCS = "doc_id bigint, text string"


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_hubs_and_loops(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(600, 700)] + [(900, 900)]
    pairs += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    edges = spark.createDataFrame([*pairs, (None, 5), (7, None), pairs[0]], "a bigint, b bigint")
    found = {r.node: r.root for r in components(edges).collect()}
    expected = union_find({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {n: r for n, r in expected.items() if n in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def plain_fingerprint(text, shingle):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def noisy_docs(n=240, seed=5):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            own = list(rng.choice(texts))
            own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        texts.append(own)
        rows.append((i + 10, " ".join(own)))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\tB"), (10, rows[0][1])]


@pytest.mark.parametrize("settings", [dict(), dict(partitions=2), dict(partitions=4, radius=1), dict(max_distance=4, partitions=3), dict(bucket=8)])
def test_simhash_matches_brute_force(spark, settings):
    rows = noisy_docs()
    found = simhash.simhash_components(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x")), **settings).collect()
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    assert sorted((r.doc_id, int.from_bytes(r.fp, "big")) for r in found) == sorted(zip([i for i, _ in rows], fps))
    most, distinct = settings.get("max_distance", 2), sorted(set(fps))
    roots = union_find(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= most])
    least = {}
    for (i, _), f in zip(rows, fps):
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, least[roots[f]]) for (i, _), f in zip(rows, fps))


def test_allocation_spends_all_units_at_least_cost():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (400, 16)).astype(np.uint8)
    bits[:300, :8] = 1
    groups = [list(range(0, 8)), list(range(8, 16))]
    tables = {(0, 0): np.bincount(simhash._value(bits, groups[0]), minlength=256), (1, 0): np.bincount(simhash._value(bits, groups[1]), minlength=256)}
    given = simhash.allocate(bits, 400, simhash.candidate_costs(400, tables, groups, 2), groups, 3, 2)
    assert (given.sum(axis=1) == 3).all()
    assert (given[:300, 1] > given[:300, 0]).all()  # the frequent value is avoided


def test_simhash_of_long_texts_in_blocks():
    text = " ".join(str(i) for i in range(simhash.BLOCK + 500))
    assert int.from_bytes(simhash.fingerprint(text, 3), "big") == plain_fingerprint(text, 3)


def test_simhash_of_nothing_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "other words entirely here now")]
    found = simhash.simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(None, 7): 2, (7, 7): 1, (None, None): 1})


def test_one_row_of_each_group_stays(spark):
    long = " ".join("word%d" % i for i in range(300))
    near = long.replace("word150", "changed")
    rows = [(5, long, "x"), (3, near, "y"), (3, near, "y"), (9, long, "z"), (None, long, "n"), (None, "alone and null", "m"), (8, None, "e"), (6, "", "e"), (20, "clean and different", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    kept = simhash.keep_one_of_each(docs, shingle=5, bits=512, max_distance=76, partitions=32, units=32, radius=0)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.digest) for r in kept.collect()) == [(False, 3, "y"), (False, 6, "e"), (False, 20, "c"), (True, 0, "m")]


def plain_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("sizes", [dict(), dict(chunk_bytes=300, bucket_bytes=200)])
def test_repeats_match_brute_force(spark, sizes):
    rng = random.Random(8)
    passage = " ".join(rng.choice("abcdefgh") for _ in range(12))
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts = [f"{t} {passage} {t[::-1]}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [None, "", " \n ", passage, passage, "é è ü " * 9, "x " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    found = find_repeats(docs, window=5, **sizes).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in found] == plain_repeats(texts, 5)
    assert [r.text for r in found] == texts and all(r.row == 1 for r in found)
    for r in found:
        assert sum(s["to"] - s["from"] for s in r.removed) == r.n_removed
        assert all(a["to"] < b["from"] for a, b in zip(r.removed, r.removed[1:]))


def test_repeats_of_equal_rows_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q")], DOCS)
    assert sorted((r.n_words, r.n_removed) for r in find_repeats(docs, window=5).collect()) == [(1, 0), (6, 6), (6, 6)]
    assert find_repeats(docs.limit(0), window=5).count() == 0


def test_intervals_are_maximal():
    begin, end = covered(np.array([0, 3, 9, 20]), 5, 40)
    assert list(zip(begin.tolist(), end.tolist())) == [(0, 8), (9, 14), (20, 25)]
    begin, end = covered(np.array([0, 5]), 5, 40)
    assert list(zip(begin.tolist(), end.tolist())) == [(0, 10)]


def test_kept_digest_of_a_long_text(spark):
    text = " ".join(str(i) for i in range(200_000))
    found = find_repeats(spark.createDataFrame([(1, text), (2, "short")], DOCS), window=35).where("doc_id = 1").first()
    assert (found.n_words, found.n_removed) == (200_000, 0)
    assert hashlib.sha256(found.kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_copies_of_one_row_are_spread_over_chunks(spark):
    """Half of all rows repeat as a whole: no chunk holds most of them, and every copy is a repetition."""
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(1, copy)] * 600 + [(10 + i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(12)
    found = find_repeats(docs, window=35, chunk_bytes=4000, bucket_bytes=4000).withColumn("part", F.spark_partition_id())
    assert found.where("doc_id = 1").select("part").distinct().count() > 2
    assert sorted({(r.doc_id == 1, r.n_removed) for r in found.collect()}) == [(False, 0), (True, 40)]
