import os

import duckdb
import pytest

import __spark_entry__
from tessera import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["plan_costs", "index_pages"])
def test_page_counts_equal_sql_on_more_pages(spark, name):
    """On sf0.001 other records a page and other roundings give the same numbers of pages."""
    connection, folder = duckdb.connect(), "/root/testdata/sf0.1"
    for t in ("customer", "orders", "part"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = catalogue.queries()[name](spark, folder), connection.sql(catalogue.oracle_sql()[name])
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["plan_costs", "stats_joined"])
def test_estimated_rows_equal_sql_on_large_tables(spark, monkeypatch, name):
    """Every table counts as large; what the optimizer has estimated before is not taken for exact."""
    monkeypatch.setattr("tessera.sources.table.EXACT_BYTES", 0)
    connection, folder = duckdb.connect(), "/root/testdata/sf0.1"
    for t in ("customer", "orders"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = connection.sql(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, folder)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), want.columns)
    plan = catalogue.open_tables(spark, folder, "customer", "orders").query("customer").join("orders", "customer.c_custkey", "orders.o_custkey")
    for run, exact in (("execute_optimal", False), ("execute", True), ("execute_optimal", False)):
        getattr(plan, run)()
        assert (plan.final_operator.stats.num_records == 150000) == exact


def test_records_a_page(spark):
    transaction = catalogue.open_tables(spark, SF, "customer", "orders", "lineitem")
    assert [transaction.num_entries_per_page(t) for t in ("customer", "orders", "lineitem")] == [64, 80, 56]


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["c_name", "p_name"]


def test_filters_and_columns_reach_the_scan(spark):
    df = catalogue.queries()["select_conj"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber)" in plan and "l_extendedprice" not in plan


def test_requested_joins_reach_the_plan(spark):
    for name, node in [("join_snlj", "CartesianProduct"), ("join_bnlj", "BroadcastHashJoin"), ("join_grace_hash", "ShuffledHashJoin"), ("join_sort_merge", "SortMergeJoin")]:
        assert node in catalogue.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString(), name
