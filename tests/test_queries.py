"""Every registered query of the reference's operators against its SQL."""

import pytest
from compare import assert_same

import __spark_entry__ as entry_point
from tallyframe.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("stat", ["first", "firstnm", "last", "lastnm"])
def test_range_order_of_keys_beyond_a_million(spark, duck, tmp_path, stat):
    # A key that is a million larger, a day earlier, is a tie in the SQL's order.
    rows = [(9_000_000 - i * 999_983 % 8_999_999, i % 3, 100.0 + i, 1 + i % 28) for i in range(90)] + [(5_000_002, 4, 1.0, 1), (4_000_002, 4, 2.0, 2), (5_000_003, 5, 3.0, 2), (4_000_003, 5, 4.0, 3), (3_000_003, 5, 5.0, 4)]
    data = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day int")
    data.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "cast(make_date(1996, 5, day) as timestamp) as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    sql = registry.SQL[f"range_{stat}"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert_same(registry.QUERIES[f"range_{stat}"](spark, str(tmp_path)).toPandas(), duck.execute(sql).df())
