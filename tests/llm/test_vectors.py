"""Nearest neighbours against brute force: recall of the approximate search, equality of the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import nearest as module
from caseloom.llm.nearest import nearest
from caseloom.llm.pivots import exact_top

VECTORS = "vec_id bigint, embedding array<float>"
ODD = [(20, None), (40, []), (60, [0.0] * 8), (80, [float("nan")] + [1.0] * 7), (100, [None] + [1.0] * 7), (120, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


def rows(n, dims=8, seed=1, scale=True):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)).astype(np.float32)
    if scale:
        data *= rng.uniform(0.2, 3, (n, 1)).astype(np.float32)
    data[5:n // 3] = data[4]  # a third of all rows are copies
    return data


def brute(data, k, every, value=lambda x: x.astype(np.float64)):
    data, out = value(data), {}
    for q in range(0, len(data), every):
        scores = (data * data[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(data)), -scores)) if i != q][:k]
        out[q] = [(i, scores[i]) for i in order]
    return out


def table(spark, data, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + list(more), VECTORS).withColumn("score", F.lit("clash"))


def grouped(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(hits)] for q, hits in out.items() if [n for n, *_ in sorted(hits)] == list(range(1, len(hits) + 1))}


@pytest.mark.parametrize("shard", [8192, 100])
def test_exact_top_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(module, "SHARD", shard)
    data = rows(400)
    found = grouped(exact_top(table(spark, data, [(i + 1000, v) for i, v in ODD if i] + [ODD[-1]]), F.col("vec_id") % 50 == 0, k=5))
    expected = brute(data, 5, 50, lambda x: np.floor(x.astype(np.float64) * 256).astype(np.int64))
    zero = found.pop(1060, None)
    assert zero is None  # 1060 is no query
    assert {q: hits for q, hits in found.items()} == {q: [(int(v), int(s)) for v, s in hits] for q, hits in expected.items()}


def test_exact_top_of_few_rows(spark):
    few = table(spark, np.zeros((0, 8)), [(50, [1.0] * 8), (51, [0.0] * 8), (52, [1.0, 2.0]), (100, [3.0, 4.0]), (100, [3.0, 4.0])])
    assert grouped(exact_top(few, F.col("vec_id") % 50 == 0)) == {50: [(51, 0)], 100: [(52, 256 * 256 * 11)]}
    assert exact_top(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("value", [1e9, 1e30])
def test_scores_beyond_64_bits_are_an_error(spark, value):
    with pytest.raises(ValueError, match="too long"):
        exact_top(table(spark, np.zeros((0, 2)), [(50, [value, 0.0]), (51, [1.0, 2.0])]), F.col("vec_id") % 50 == 0)


def test_small_tables_are_searched_whole(spark):
    data = rows(300)
    found = grouped(nearest(table(spark, data, ODD), F.col("vec_id") % 20 == 0, k=20))
    expected = brute(data, 20, 20)
    for q, hits in expected.items():
        if q in (20, 40, 60, 80, 100, 120):
            continue
        assert [v for v, _ in found[q]] == [v for v, _ in hits]
        assert np.allclose([s for _, s in found[q]], [s for _, s in hits], rtol=1e-12)


def test_recall_where_only_a_share_is_verified(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD", 1500)
    data = rows(3000, dims=32, seed=4)
    found = grouped(nearest(table(spark, data), F.col("vec_id") % 20 == 0, k=20, least=100, verified=0.2))
    expected = brute(data, 20, 20)
    recall = [len({v for v, _ in found[q]} & {v for v, _ in hits}) / 20 for q, hits in expected.items()]
    assert np.mean(recall) >= 0.9


def test_nearest_of_nothing(spark):
    assert nearest(table(spark, np.zeros((0, 8)), ODD), F.col("vec_id") % 20 == 0).count() == 0
    alone = table(spark, np.zeros((0, 8)), [(20, [1.0] * 8), (20, [2.0] * 8)])
    assert nearest(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_few_widenings_are_counted_for_a_query(monkeypatch):
    """The rows verified are those of the first widening with enough collisions, as if all were tried from the narrowest on."""
    data, k, least, verified = rows(1200, dims=16, seed=7).astype(np.float64), 5, 60, 0.1
    asked = np.arange(0, 1200, 20)
    calls, plain = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or plain(x))
    found = list(module.collision_search(k, least=least, verified=verified)(np.arange(1200), data, None, asked, data[asked], None))
    assert len(calls) <= 3 * len(asked)
    norms = np.sqrt((data ** 2).sum(axis=1))
    radius = norms.max()
    sphere = np.concatenate([data, np.sqrt(np.maximum(radius ** 2 - norms ** 2, 0))[:, None]], axis=1) / radius
    lines = np.random.default_rng(11).normal(size=(17, 64))
    project, enough = sphere @ lines, k + 1 + int(verified * 1200)
    for q, (at, scores) in zip(asked.tolist(), found):
        centre, reach = np.append(data[q] / norms[q], 0) @ lines, 0.1
        while (hit := plain(((project >= centre - reach) & (project <= centre + reach)).sum(axis=1) >= 48)).size < enough:
            reach *= 1.5
        exact = (data * data[q]).sum(axis=1)
        expected = sorted((i for i in hit.tolist() if i != q), key=lambda i: (-exact[i], i))[:k]
        assert at.tolist() == expected and scores.tolist() == [exact[i] for i in expected]
