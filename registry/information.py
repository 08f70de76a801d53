"""Mutual information by nearest neighbours, shuffled columns and the noise of really shuffled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators import selection
from caseloom.operators.information import PRIME, ROUNDS, neighbour_information, round_constants, shuffle_column
from caseloom.operators.transforms import VARIANTS
from registry.base import query, read, rounded, union_all

BASES = ("l_quantity", "l_discount", "l_tax")
#: A number below WIDE for each line, from its keys, which also tells equal values apart.
PARTS, WIDE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))", 1 << 48
KEY, KEY_SQL = f"CAST(conv(substr(md5({PARTS}), 1, 12), 16, 10) AS BIGINT)", f"('0x' || substr(md5({PARTS}), 1, 12))::BIGINT"
#: Walks of the bijection in SQL: for some thousand rows ten leave no rank outside the range.
WALKS = 10


def keyed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a key and the two-class target."""
    late = F.col("l_quantity") * (1 - F.col("l_discount")) + F.col("l_orderkey") % 7 > 27
    return read(spark, sf, "lineitem").select(F.expr(KEY).alias("line"), *BASES, F.when(late, "late").otherwise("ok").alias("outcome"))


LINES = f"""(SELECT {KEY_SQL} AS line, l_quantity, l_discount, l_tax,
      CASE WHEN l_quantity * (1 - l_discount) + (l_orderkey % 7) > 27 THEN 'late' ELSE 'ok' END AS outcome FROM lineitem)"""
VARIANT_SQL = {**{b: b for b in BASES}, **{f"{b}_sqrt": f"sqrt({b})" for b in BASES}, **{f"{b}_log": f"ln(1 + {b})" for b in BASES}}


def _psi(n: str) -> str:
    z = f"({n} + 10.0)"
    series = f"ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8)"
    return f"({series} - (" + " + ".join(f"1 / ({n} + {j}.0)" for j in range(10)) + "))"


def neighbour_sql(points: str, k: int = 3) -> str:
    """Scores of points (feature, x, y, u) by whole windows."""
    around = ", ".join(
        f"""CASE WHEN {move}(x, {j}) OVER w IS NOT NULL THEN {{'dx': {sign} * ({move}(x, {j}) OVER w - x), 'du': {sign} * ({move}(u, {j}) OVER w - u),
          'x': {move}(x, {j}) OVER w, 'u': {move}(u, {j}) OVER w}} END""" for j in range(1, k + 1) for move, sign in (("lead", 1), ("lag", -1)))
    return f"""
      WITH points AS ({points}),
      sized AS (SELECT *, row_number() OVER () AS id, count(*) OVER (PARTITION BY feature, y) AS size FROM points),
      near AS (SELECT *, least({k}, size - 1) AS k, [{around}] AS around FROM sized WHERE size > 1 WINDOW w AS (PARTITION BY feature, y ORDER BY x, u)),
      kth AS (SELECT *, list_sort(list_filter(around, lambda a: a IS NOT NULL))[k] AS n FROM near),
      ends AS (
        SELECT *, 2 * x - n.x AS mx, 2 * u - n.u AS mu, n.x > x OR (n.x = x AND n.u > u) AS after FROM kth),
      marks AS (
        SELECT feature, x, u, 1 AS kind, id, size, k FROM ends
        UNION ALL SELECT feature, CASE WHEN after THEN n.x ELSE mx END, CASE WHEN after THEN n.u ELSE mu END, 0, id, size, k FROM ends
        UNION ALL SELECT feature, CASE WHEN after THEN mx ELSE n.x END, CASE WHEN after THEN mu ELSE n.u END, 2, id, size, k FROM ends),
      ordered AS (SELECT *, sum((kind = 1)::BIGINT) OVER (PARTITION BY feature ORDER BY x, u, kind ROWS UNBOUNDED PRECEDING) AS rank FROM marks),
      counts AS (
        SELECT feature, id, sum(CASE kind WHEN 0 THEN rank ELSE -rank END)::DOUBLE AS m, max(size)::DOUBLE AS size, max(k)::DOUBLE AS k
        FROM ordered WHERE kind <> 1 GROUP BY ALL)
      SELECT feature, greatest({_psi("count(*)")} + avg({_psi("k")}) - avg({_psi("size")}) - avg({_psi("m")}), 0) AS mi FROM counts GROUP BY feature"""


POINTS = union_all([f"SELECT '{name}' AS feature, {value} AS x, outcome AS y, line / {WIDE}.0 AS u FROM {LINES} l" for name, value in VARIANT_SQL.items()])
NEIGHBOUR_SQL = neighbour_sql(POINTS)


def variant_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = keyed_lines(spark, sf)
    table = lines.select("*", *[make(F.col(b)).alias(f"{b}{suffix}") for b in BASES for suffix, make in VARIANTS.items()])
    return neighbour_information(table, list(VARIANT_SQL), "outcome", noise=F.col("line") / WIDE)


@query("neighbour_information", f"SELECT feature, round(mi, 5) AS mi FROM ({NEIGHBOUR_SQL})")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The raw column, its square root and its logarithm against a class: each has a score of its own."""
    return rounded(variant_scores(spark, sf), 5)


@query("best_variants", f"""
    SELECT base, feature, round(mi, 5) AS mi FROM (
      SELECT regexp_replace(feature, '(_sqrt|_log)$', '') AS base, feature, mi, row_number() OVER (PARTITION BY regexp_replace(feature, '(_sqrt|_log)$', '')
        ORDER BY round(mi, 12) DESC, CASE WHEN feature LIKE '%\\_sqrt' ESCAPE '\\' THEN 1 WHEN feature LIKE '%\\_log' ESCAPE '\\' THEN 2 ELSE 0 END) AS pos FROM ({NEIGHBOUR_SQL}) s)
    WHERE pos = 1 AND mi > 0.0005""")
def best_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each family the variant with the best score by nearest neighbours, if above 0.0005 nats."""
    return rounded(selection.best_variants(variant_scores(spark, sf), 0.0005), 5)


def shuffled_sql(source: str, columns: str, constants: str) -> str:
    """CTEs that end in `moved` (`columns`, rank): `source` (rank, `columns`) with each rank sent through the bijection.

    `constants` names the round constants a0, b0, a1, ... as columns of one row per `columns`' permutation.
    """
    ctes = [f"src AS ({source})", "grid AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS wide FROM src WHERE permutation = 0)",
            f"walk0 AS (SELECT {columns}, rank AS x, n, wide, (n + wide - 1) // wide AS high, c.* EXCLUDE (permutation) FROM src JOIN ({constants}) c USING (permutation), grid)"]
    for w in range(WALKS):
        ctes.append(f"half{w}_0 AS (SELECT *, x // high AS l, x % high AS r FROM walk{w})")
        for i in range(ROUNDS):
            side, other, size = ("r", "l", "high") if i % 2 else ("l", "r", "wide")
            value = f"((({other} + b{i}) % {PRIME}) * (({other} + b{i}) % {PRIME}) % {PRIME}) * a{i} % {PRIME}"
            ctes.append(f"half{w}_{i + 1} AS (SELECT * REPLACE (({side} + {value}) % {size} AS {side}) FROM half{w}_{i})")
        stay = "x < n" if w else "false"
        ctes.append(f"walk{w + 1} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN {stay} THEN x ELSE l * high + r END AS x) FROM half{w}_{ROUNDS})")
    return ",\n".join([*ctes, f"moved AS (SELECT {columns}, x AS rank FROM walk{WALKS})"])


def constants_sql(seeds: list[int]) -> str:
    rows = ", ".join("(" + ", ".join(map(str, [p, *[v for pair in round_constants(seed) for v in pair]])) + ")" for p, seed in enumerate(seeds))
    return f"SELECT * FROM (VALUES {rows}) v(permutation, " + ", ".join(f"a{i}, b{i}" for i in range(ROUNDS)) + ")"


@query("shuffled_column", f"""
    WITH {shuffled_sql(f"SELECT 0 AS permutation, row_number() OVER (ORDER BY line) - 1 AS rank, l_quantity FROM {LINES} l", "permutation, l_quantity", constants_sql([42]))}
    SELECT l.line, m.l_quantity, l.l_discount FROM (SELECT *, row_number() OVER (ORDER BY line) - 1 AS rank FROM {LINES} l) l JOIN moved m USING (rank)""")
def shuffled_column(spark: SparkSession, sf: str) -> DataFrame:
    """One column in other rows, by a seeded bijection of ranks."""
    return shuffle_column(keyed_lines(spark, sf).select("line", "l_quantity", "l_discount"), "l_quantity", seed=42, key="line")


def _binned(f: str) -> str:
    cuts = ", ".join(f"quantile_cont({f}, {i / 10})" for i in range(1, 10))
    return f"""SELECT '{f}' AS feature, len(list_filter(list_distinct(e), lambda c: {f} > c)) AS x, permutation, y, count(*)::DOUBLE AS n
        FROM (SELECT *, row_number() OVER (ORDER BY line) - 1 AS rank FROM {LINES} l) l JOIN moved USING (rank), (SELECT [{cuts}] AS e FROM lineitem) c GROUP BY ALL"""


@query("permuted_threshold", f"""
    WITH {shuffled_sql(f"SELECT p.permutation, row_number() OVER (PARTITION BY p.permutation ORDER BY line) - 1 AS rank, outcome AS y FROM {LINES} l, (SELECT unnest(range(0, 10)) AS permutation) p",
                       "permutation, y", constants_sql([42 + p for p in range(10)]))},
    joint AS ({union_all([f"SELECT * FROM ({_binned(f)})" for f in BASES])}),
    whole AS (SELECT *, sum(n) OVER (PARTITION BY feature, permutation) AS t, sum(n) OVER (PARTITION BY feature, permutation, x) AS nx, sum(n) OVER (PARTITION BY feature, permutation, y) AS ny FROM joint),
    scores AS (SELECT feature, permutation, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi FROM whole GROUP BY ALL)
    SELECT round(avg(mi) + 0.5 * stddev_pop(mi), 9) AS threshold FROM scores""")
def permuted_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The noise threshold of ten really shuffled tables."""
    scores = selection.shuffled_scores(keyed_lines(spark, sf), list(BASES), "outcome", True, key="line")
    return rounded(selection.threshold_of(scores), 9)
