"""The paths meant for tables too large for one task, checked against brute force on small data."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import splits
from caseloom.operators.browse import paginate
from caseloom.operators.quantiles import exact_quantiles, grouped_quantiles, order_statistics
from caseloom.operators.selection import joint_counts, noise_threshold, permutation_scores

rng = random.Random(7)
SHAPES = {
    "uniform": [rng.random() for _ in range(3000)],
    "two atoms": [0.0] * 1500 + [1.0] * 1500,
    "hot value": [5.0] * 2900 + [rng.gauss(0, 100) for _ in range(100)],
    "heavy tail": [10 ** rng.uniform(-200, 200) for _ in range(3000)],
    "whole": [float(rng.randrange(50)) for _ in range(3000)],
    "constant": [3.0] * 100,
    "one": [1.0],
}
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("shape", SHAPES)
def test_narrowed_quantiles_are_exact(spark, shape):
    values = SHAPES[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    found = exact_quantiles(df, ["v"], PROBS, exact_rows=0)["v"]
    assert [found[p] for p in PROBS] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)
    small = exact_quantiles(df, ["v"], PROBS)["v"]
    assert [small[p] for p in PROBS] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-9)


def test_order_statistics_at_every_rank(spark):
    values = [float(rng.randrange(30)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = order_statistics(df, {"v": list(range(200))}, {"v": 200})
    assert [found["v", r] for r in range(200)] == sorted(values)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": {0.5: None}}
    assert exact_quantiles(df, [], [0.5]) == {}


def test_grouped_quantiles_with_a_hot_group(spark):
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("cold", float(i)) for i in range(7)] + [(None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for exact_rows in (100, 10_000):
        found = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in grouped_quantiles(df, ["k"], "v", [0.25, 0.5, 0.75], exact_rows).collect()}
        assert set(found) == {"hot", "cold"}
        for k in found:
            values = [v for key, v in rows if key == k]
            assert found[k] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)


@pytest.fixture
def labelled(spark):
    rows = [(i, "hot" if i % 10 else "rare", rng.random()) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, label string, x double")


@pytest.mark.parametrize("range_rows", [100, 100_000])
def test_split_shares_are_exact(labelled, monkeypatch, range_rows):
    monkeypatch.setattr(splits, "RANGE_ROWS", range_rows)
    train, test = splits.train_test(labelled, 0.25, stratify="label")
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {"hot": 450, "rare": 50}
    ids = {r["id"] for r in train.collect()} | {r["id"] for r in test.collect()}
    assert train.count() + test.count() == 2000 and len(ids) == 2000


def test_split_does_not_depend_on_partitions(labelled, monkeypatch):
    monkeypatch.setattr(splits, "RANGE_ROWS", 50)
    one = {r["id"] for r in splits.train_test(labelled.coalesce(1), 0.2, stratify="label")[1].collect()}
    many = {r["id"] for r in splits.train_test(labelled.repartition(9), 0.2, stratify="label")[1].collect()}
    monkeypatch.setattr(splits, "SMALL_TABLE_ROWS", 0)
    joined = {r["id"] for r in splits.train_test(labelled, 0.2, stratify="label")[1].collect()}
    assert one == many == joined and len(one) == 400


def test_folds_are_balanced(labelled):
    counts = Counter((r["label"], r["fold"]) for r in splits.assign_folds(labelled, 5, stratify="label").collect())
    assert set(counts.values()) == {360, 40}
    assert splits.assign_folds(labelled, 4).groupBy("fold").count().where("count = 500").count() == 4


def test_test_size_bounds(labelled):
    for size in (0.05, 0.6):
        with pytest.raises(ValueError, match="test_size"):
            splits.train_test(labelled, size)
    with pytest.raises(ValueError, match="folds"):
        splits.assign_folds(labelled, 1)


def test_deep_pages_equal_the_sorted_table(spark):
    rows = [(rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    ordered = sorted(rows)
    for page in (1, 7, 49, 50, 51):
        found = [tuple(r) for r in paginate(df, ["k", "i"], page, 10, deep=0).collect()]
        assert found == ordered[(page - 1) * 10: page * 10]
    with pytest.raises(ValueError):
        paginate(df, "k", 0)


def test_deep_pages_with_missing_and_odd_keys(spark):
    values = [None] * 150 + [float("nan")] * 150 + [float("inf")] * 20 + [float(i % 60) for i in range(300)]
    df = spark.createDataFrame(list(zip(values, range(len(values)))), "k double, i int").repartition(3)
    ordered = [str(tuple(r)) for r in df.orderBy(F.col("k").asc_nulls_last(), "i").collect()]
    for page in (2, 31, 40, 62):
        assert [str(tuple(r)) for r in paginate(df, ["k", "i"], page, 10, deep=0).collect()] == ordered[(page - 1) * 10: page * 10]


def test_permuted_scores_follow_shuffling(spark):
    """Scores drawn from the margins have the mean and spread of scores of shuffled columns."""
    n = 400
    x, y = [rng.random() for _ in range(n)], [rng.choice("abc") for _ in range(n)]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y string")
    joint = joint_counts(df, ["x"], "y", True)
    drawn = [r["mi"] for r in permutation_scores(joint, 400).collect()]
    bins = np.searchsorted(np.quantile(x, np.arange(1, 10) / 10), x, side="left")
    codes = np.array([ord(c) - 97 for c in y])
    shuffled = []
    for seed in range(400):
        table = np.zeros((10, 3))
        np.add.at(table, (np.random.default_rng(seed).permutation(bins), codes), 1)
        p = table / n
        e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        shuffled.append((p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum())
    assert np.mean(drawn) == pytest.approx(np.mean(shuffled), rel=0.1)
    assert np.std(drawn) == pytest.approx(np.std(shuffled), rel=0.25)
    assert noise_threshold(joint).first()["threshold"] > 0


def test_noise_follows_one_law_at_every_size(spark):
    """A table of a million times the rows has a millionth of the noise: no size changes the law."""
    df = spark.createDataFrame([(rng.random(), rng.choice("abc")) for _ in range(400)], "x double, y string")
    joint = joint_counts(df, ["x"], "y", True)
    small = [r["mi"] for r in permutation_scores(joint, 50).orderBy("permutation").collect()]
    large = [r["mi"] for r in permutation_scores(joint.withColumn("n", F.col("n") * 1_000_000), 50).orderBy("permutation").collect()]
    assert np.allclose(np.array(large) * 1e6, small)


def test_plans_read_only_what_they_need(spark):
    from registry.base import read, tickets
    from caseloom.operators.dashboard import bucketed_cases, daily_rollup

    plan = daily_rollup(bucketed_cases(tickets(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Window" not in plan
    lines = read(spark, "/root/testdata/sf0.001", "lineitem").agg(F.corr("l_tax", "l_discount"))
    assert "struct<l_discount:double,l_tax:double>" in lines._jdf.queryExecution().executedPlan().toString()
