"""Random queries, run by the builder and as SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import JoinAlgorithm
from tessera.catalogue import open_tables

from .conftest import SF

#: Columns by table with values to compare with, and joins that the tables allow.
COLUMNS = {
    "customer": {"c_custkey": [20, 77], "c_nationkey": [3, 12], "c_acctbal": [0.0, 5000.5], "c_mktsegment": ["BUILDING", "MACHINERY"]},
    "orders": {"o_orderkey": [100, 900], "o_custkey": [30], "o_orderstatus": ["F", "O"], "o_totalprice": [100000.0]},
    "lineitem": {"l_linenumber": [2, 4], "l_quantity": [10.0, 30.0], "l_returnflag": ["R", "N"], "l_suppkey": [5]},
    "nation": {"n_nationkey": [4], "n_regionkey": [1, 3], "n_name": ["M"]},
}
JOINS = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("nation", "n_nationkey", "customer", "c_nationkey")]


def make(seed):
    rng = random.Random(seed)
    tables, joins = [rng.choice(list(COLUMNS))], []
    for _ in range(rng.randrange(3)):
        options = [(t, a, u, b) if t in tables else (u, b, t, a) for t, a, u, b in JOINS if (t in tables) != (u in tables)]
        if options:
            joins.append(rng.choice(options))
            tables.append(joins[-1][2])
    columns = [(t, c) for t in tables for c in COLUMNS[t]]
    predicates = [(t, c, rng.choice(["=", "!=", "<", "<=", ">", ">="]), rng.choice(COLUMNS[t][c])) for t, c in rng.sample(columns, rng.randrange(3))]
    numbers = [c for t, c in columns if not isinstance(COLUMNS[t][c][0], str)]
    whole = [c for t, c in columns if isinstance(COLUMNS[t][c][0], int)]
    kind = rng.choice(["rows", "total", "group"])
    return tables, joins, predicates, kind, rng.sample([c for _, c in columns], 2), rng.choice(whole), rng.choice(numbers), rng.choice([None, *JoinAlgorithm])


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in COLUMNS:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("seed", range(30))
def test_random_query(spark, duck, seed):
    tables, joins, predicates, kind, columns, summed, averaged, algorithm = make(seed)
    plan = open_tables(spark, SF, *tables).query(tables[0])
    sql = f"FROM {tables[0]}"
    for t, a, u, b in joins:
        plan.join(u, f"{t}.{a}", f"{u}.{b}", algorithm)
        sql += f" JOIN {u} ON {t}.{a} = {u}.{b}"
    for i, (t, c, op, v) in enumerate(predicates):
        plan.select(f"{t}.{c}", op, v)
        sql += f" {'AND' if i else 'WHERE'} {c} {op} {v!r}"
    if kind == "rows":
        plan.project(columns)
        sql = f"SELECT {', '.join(columns)} {sql}"
    else:
        plan.count().sum(summed).average(averaged)
        sql = f"SELECT {columns[0] + ', ' if kind == 'group' else ''}COUNT(*) AS n, SUM({summed}) AS s, AVG({averaged}) AS m {sql}"
        if kind == "group":
            plan.project(columns[:1]).group_by(columns[0])
            sql += f" GROUP BY {columns[0]}"
        else:
            sql += " HAVING COUNT(*) > 0"
    want = sorted(tuple(str(round(float(v), 4)) if isinstance(v, float) else str(v) for v in r) for r in duck.sql(sql).fetchall())
    for run in ("execute", "execute_optimal"):
        df = getattr(plan, run)()
        df = df.select(*[F.col(c).cast("double").alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes])
        got = sorted(tuple(str(round(v, 4)) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
        assert got == want, run
