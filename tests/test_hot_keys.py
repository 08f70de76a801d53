"""Joins with hot and missing keys against the plain join."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import checks
from caseloom.operators.combine import join_tables
from caseloom.operators.hot_keys import frequent_hashes, join_size, split_join


@pytest.fixture(scope="module")
def sides(spark):
    # Half of the left rows on key 7, a tenth without a key; rows repeat.
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 97)
    left = spark.range(0, 6000, 1, 4).select(key.cast("bigint").alias("key"), (F.col("id") % 5).alias("value"))
    key = F.when(F.col("id") < 30, 7).when(F.col("id") < 50, None).otherwise(F.col("id") % 120)
    right = spark.range(0, 300, 1, 3).select(key.cast("bigint").alias("key"), (F.col("id") % 11).alias("value"))
    return left, right


def counted(df):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy("key", "value_a", "value_b").count().collect()}


@pytest.mark.parametrize("hot", [10, 100, 1000, 10 ** 9])
def test_split_join_equals_the_plain_join(sides, hot):
    left, right = sides
    assert counted(join_tables(left, right, hot_rows=hot)) == counted(join_tables(left, right))


def test_size_of_a_join_is_known_before(sides):
    left, right = sides
    r = join_size(left, right, "key").first()
    assert r.pairs == join_tables(left, right).count()
    assert r.null_pairs == left.where("key IS NULL").count() * right.where("key IS NULL").count()
    assert join_size(left, right, "key", null_safe=False).first().pairs == r.pairs - r.null_pairs
    with pytest.raises(ValueError, match=f"{r.pairs} rows"):
        join_tables(left, right, max_rows=int(r.pairs) - 1)
    assert join_tables(left, right, max_rows=int(r.pairs)).count() == r.pairs


def test_no_cell_holds_more_than_its_share(spark, sides):
    """Half of all rows share one key, yet the largest task joins few of them."""
    left, right = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        plain = largest(join_tables(left, right).select("value_a"))
        split = largest(join_tables(left, right, hot_rows=100).select("value_a"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plain >= 3000 * 30 and split < plain / 4


def test_frequent_keys(spark, sides):
    left, _ = sides
    found = frequent_hashes(left, F.col("key"), 500)
    names = {spark.sql(f"SELECT xxhash64(CAST({k} AS BIGINT))").first()[0]: k for k in ("7", "NULL")}
    assert {names[h] for h in found} == {"7", "NULL"} and all(n >= 500 for n in found.values())
    assert frequent_hashes(left.limit(0), F.col("key"), 1) == {}


def test_sides_without_rows(spark, sides):
    left, right = sides
    assert split_join(left.limit(0), right.toDF("k", "v"), "key", "k", 10).count() == 0
    r = join_size(left.limit(0), right, "key").first()
    assert (r.pairs, r.null_pairs) == (Decimal(0), Decimal(0))


def test_orders_of_a_hot_join_are_counted_without_moving_its_pairs(spark, tmp_path):
    """Repeated suppliers, orders of several lines and missing orders; the plan has no distinct count over the pairs."""
    lines = [(None if i % 9 == 0 and i % 7 != 5 else i // 4, i % 3 + 1, 1 + i % 7, float(i)) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1 + i % 8, i % 3) for i in range(14)], "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    found = contract.queries()["join_with_hot_key"](spark, str(tmp_path))
    assert "distinct" not in found._jdf.queryExecution().toString().lower()
    with duckdb.connect() as con:
        for table in ("lineitem", "supplier"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        assert checks.difference(found, con, contract.oracle_sql()["join_with_hot_key"]) is None
