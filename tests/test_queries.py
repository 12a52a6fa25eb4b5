import pytest
from pyspark.sql import functions as F

from tessera import MARKER, JoinAlgorithm, PredicateOperator, QueryPlanError, Schema
from tessera import FLOAT, INT, STRING, Database

from .fixtures import ALL, CONSTANT, ONE_INT, fill, random_rows, valued


@pytest.fixture()
def tx(database):
    fill(database, "t", random_rows(100))
    with database.begin_transaction() as t:
        yield t


def two(t):
    t.query_as("t", "t1")
    t.query_as("t", "t2")
    return t.query("t1")


def test_scan_names(tx):
    assert tx.query("t").execute().columns == ["t.bool", "t.int", "t.string", "t.float"]
    assert tx.query("t").project(["int", "t.bool"]).execute().columns == ["int", "t.bool"]


@pytest.mark.parametrize("op, n", [("=", 1), ("!=", 99), ("<", 30), ("<=", 31), (">", 69), (">=", 70)])
def test_filters_on_ints(tx, op, n):
    assert tx.query("t").select("int", op, 30).execute().count() == n


@pytest.mark.parametrize("op", list(PredicateOperator))
@pytest.mark.parametrize("column, value", [("string", "m0000"), ("float", 0.5), ("bool", True)])
def test_filters_on_other_types(tx, op, column, value):
    at = ALL.index(column)
    want = sum(op.function(ALL.types[at].stored(r[at]), value) for r in random_rows(100))
    assert tx.query("t").select(column, op, value).execute().count() == want


def test_all_filters_hold(tx):
    rows = tx.query("t").select("int", ">=", 10).select("int", "<", 20).select("bool", "=", True).execute()
    assert rows.count() == sum(r[0] and 10 <= r[1] < 20 for r in random_rows(100))


def test_padded_strings(database):
    fill(database, "s", [("ab",), ("abc",)], Schema(["s"], [STRING(4)]))
    with database.begin_transaction() as t:
        assert [r["s"] for r in t.query("s").select("s", "=", "ab").project(["s"]).execute().collect()] == ["ab  "]


def test_name_errors(tx):
    plan = two(tx).join("t2", "t1.int", "t2.int")
    with pytest.raises(QueryPlanError, match="t1 and of t2"):
        plan.project(["int"]).execute()
    for wrong in (
        lambda: tx.query("t").select("nope", "=", 1).execute(),
        lambda: tx.query("t").select("int", "=", "1").execute(),
        lambda: tx.query("t").select("int", "~", 1),
        lambda: tx.query("t").project([]),
        lambda: tx.query("t").project(["int"]).project(["int"]),
        lambda: tx.query("t").project(["nope"]).execute(),
        lambda: tx.query("t").join("t1", "int", "string").execute(),
        lambda: tx.query("t").sum("string").execute(),
        lambda: tx.query("t").average("bool").execute(),
        lambda: tx.query("t").select("nope", "=", 1).execute_optimal(),
    ):
        with pytest.raises(QueryPlanError):
            wrong()


@pytest.mark.parametrize("algorithm", [None, *JoinAlgorithm])
def test_self_join(tx, algorithm):
    rows = two(tx).join("t2", "t1.string", "t2.string", algorithm).execute().collect()
    assert len(rows) == 100 and all(r["t1.int"] == r["t2.int"] for r in rows)
    assert list(rows[0].asDict()) == ["t1.bool", "t1.int", "t1.string", "t1.float", "t2.bool", "t2.int", "t2.string", "t2.float"]


@pytest.mark.parametrize("algorithm", list(JoinAlgorithm))
def test_join_of_equal_rows(database, algorithm):
    fill(database, "a", [CONSTANT] * 100)
    fill(database, "e", [], ONE_INT)
    with database.begin_transaction() as t:
        t.query_as("a", "b")
        assert t.query("a").join("b", "a.int", "b.int", algorithm).execute().count() == 10_000
        assert t.query("a").join("e", "a.int", "e.int", algorithm).execute().count() == 0


def test_join_without_alias(tx):
    with pytest.raises(QueryPlanError):
        tx.query("t").join("t", "t.int", "t.int").project(["t.int"]).execute()
    for run in ("execute", "execute_optimal"):
        assert getattr(tx.query("t").join("t", "t.int", "t.int").count(), run)().first()["countAgg"] == 100


def test_three_tables_by_either_planner(database):
    fill(database, "s", [(i, f"n{i}") for i in range(20)], Schema(["sid", "name"], [INT, STRING(4)]))
    fill(database, "c", [(i, f"c{i}") for i in range(5)], Schema(["cid", "name"], [INT, STRING(4)]))
    pairs = [((i * 7) % 20, (i * 3) % 5) for i in range(60)]
    fill(database, "e", pairs, Schema(["sid", "cid"], [INT, INT]))
    with database.begin_transaction() as t:
        results = []
        for run in ("execute", "execute_optimal"):
            plan = t.query("s").join("e", "s.sid", "e.sid").join("c", "e.cid", "c.cid").select("s.sid", "<", 15).select("c.name", "!=", "c1")
            df = getattr(plan.project(["s.name", "c.name"]), run)()
            assert df.columns == ["s.name", "c.name"]
            results.append(sorted(map(tuple, df.collect())))
        assert results[0] == results[1] == sorted((f"n{a}".ljust(4), f"c{b}".ljust(4)) for a, b in pairs if a < 15 and b != 1)


def test_aggregates(database):
    fill(database, "i", [(i,) for i in range(100)], ONE_INT)
    with database.begin_transaction() as t:
        df = t.query("i").count().average("int").sum("int").execute()
        assert df.columns == ["countAgg", "sumAgg", "averageAgg"] and tuple(df.first()) == (100, 4950, 49.5)
        assert [f.dataType.simpleString() for f in df.schema] == ["int", "int", "float"]
        assert t.query("i").select("int", ">", 1000).count().execute().count() == 0
        assert tuple(t.query("i").project(["int"]).count().execute().first()) == (0, 100)


def test_float_aggregates_and_saturation(database):
    fill(database, "f", [CONSTANT] * 100)
    fill(database, "big", [((1 << 31) - 1,)] * 3 + [(-5,)], ONE_INT)
    fill(database, "small", [(-(1 << 31),)] * 3, ONE_INT)
    with database.begin_transaction() as t:
        row = t.query("f").sum("float").average("float").execute().first()
        assert row["sumAgg"] == pytest.approx(120, rel=1e-5) and row["averageAgg"] == pytest.approx(1.2, rel=1e-5)
        assert t.query("big").sum("int").execute().first()[0] == (1 << 31) - 1
        assert t.query("small").sum("int").execute().first()[0] == -(1 << 31)


def test_groups_with_aggregates(database):
    fill(database, "i", [(i % 4,) for i in range(40)], ONE_INT)
    with database.begin_transaction() as t:
        rows = t.query("i").project(["int"]).group_by("int").count().sum("int").execute().collect()
        assert sorted(map(tuple, rows)) == [(k, 10, 10 * k) for k in range(4)]
        assert t.query("i").group_by("int").count().execute().columns == ["countAgg"]


def test_groups_without_aggregates(database):
    fill(database, "g", [(i,) for i in range(100)] * 4, ONE_INT)
    fill(database, "none", [], ONE_INT)
    with database.begin_transaction() as t:
        seen = list(t.query("g").group_by("int").execute_groups())
        assert len(seen) == 499 and sum(x is MARKER for x in seen) == 99 and seen[-1] is not MARKER
        assert [len({r["g.int"] for r in seen[i : i + 4]}) for i in range(0, 499, 5)] == [1] * 100
        assert list(t.query("none").group_by("int").execute_groups()) == []
        assert t.query("g").project(["int"]).group_by("int").execute().columns == ["group_id", "int"]


def test_projection_with_groups(tx):
    for wrong in (["int"], ["bool", "int", "string"]):
        with pytest.raises(QueryPlanError):
            tx.query("t").project(wrong).group_by("bool").execute()
    rows = tx.query("t").project(["bool", "int"]).group_by("bool").count().execute().collect()
    first = {}
    for b, i, *_ in random_rows(100):
        first.setdefault(b, i)
    assert {r["bool"]: r["int"] for r in rows} == first


def test_builder_runs_again(tx):
    columns = ["int"]
    plan = tx.query("t").project(columns).select("int", "<", 5)
    assert plan.execute().count() == plan.execute_optimal().count() == 5
    plan.select("int", ">", 2)
    assert plan.execute().count() == 2 and columns == ["int"]


def runs(values):
    out = []
    for v in values:
        if not out or out[-1][0] != v:
            out.append([v, 0])
        out[-1][1] += 1
    return [tuple(x) for x in out]


@pytest.fixture()
def ordered(database):
    n = 288 // 2

    def go(algorithm, left, right, memory=5):
        fill(database, "l", [valued(v) for v in left])
        fill(database, "r", [valued(v) for v in right])
        database.num_memory_pages = memory
        with database.begin_transaction() as t:
            plan = t.query("l").join("r", "l.int", "r.int", algorithm).project(["l.int"])
            return runs(r[0] for r in plan.execute(ordered=True).collect())

    return n, go


def test_page_nested_loop_order(ordered):
    n, go = ordered
    left, right = [1] * n + [2] * n + [2] * n + [1] * n, [1] * n + [2] * n + [1] * n + [2] * n
    assert go(JoinAlgorithm.PNLJ, left, right) == [(1, 20736), (2, 20736), (1, 20736), (2, 41472), (1, 20736), (2, 20736), (1, 20736)]


def test_block_nested_loop_order(ordered):
    n, go = ordered
    left, right = [v for v in (1, 2, 3, 4) for _ in range(n)], [v for v in (3, 4, 1, 2) for _ in range(n)]
    assert go(JoinAlgorithm.BNLJ, left, right, 4) == [(v, 20736) for v in (3, 4, 1, 2)]


def test_grace_hash_order(ordered):
    _, go = ordered
    assert go(JoinAlgorithm.GHJ, [3, 2, 1] * 333, [1, 3, 2] * 333, 4) == [(3, 110889), (1, 110889), (2, 110889)]


def test_sort_merge_and_simple_order(ordered):
    _, go = ordered
    assert go(JoinAlgorithm.SMJ, [3, -1, 2, 3], [3, 2, -1]) == [(-1, 1), (2, 1), (3, 2)]


def test_negative_and_text_keys_have_an_order(database):
    fill(database, "l", [(s,) for s in ("zebra", "ab", "polygenelubricants")], Schema(["s"], [STRING(20)]))
    with database.begin_transaction() as t:
        t.query_as("l", "r")
        assert t.query("l").join("r", "l.s", "r.s", JoinAlgorithm.GHJ).execute(ordered=True).count() == 3


def test_external_results_keep_64_bits(spark):
    database = Database(spark)
    database.attach("x", spark.range(10).selectExpr("id as k", "cast(id as double) as d", "cast(id as int) as i"), key=["k"])
    with database.begin_transaction() as t:
        types = [t.query("x").sum(c).average(c).execute().dtypes for c in ("k", "d", "i")]
    assert types == [[("sumAgg", "bigint"), ("averageAgg", "double")], [("sumAgg", "double"), ("averageAgg", "double")], [("sumAgg", "int"), ("averageAgg", "double")]]


def test_groups_keep_null_keys(spark):
    database = Database(spark)
    database.attach("n", spark.createDataFrame([(1, 2), (None, 3), (None, 4), (5, None)], "k int, v int"))
    with database.begin_transaction() as t:
        rows = sorted(t.query("n").group_by("k").execute().collect(), key=str)
        assert sorted((r["group_id"], r["n.k"], r["n.v"]) for r in rows if r["n.k"]) == [(2, 1, 2), (3, 5, None)]
        assert sorted(r["n.v"] for r in rows if r["group_id"] == 1) == [3, 4]


def test_counts_beyond_32_bits(spark, database):
    database.attach("x", spark.range((1 << 31) + 10).select(F.lit(1).alias("k")))
    database.attach("keyed", spark.range(3), key=["id"])
    with database.begin_transaction() as t:
        assert t.query("x").count().execute().first()["countAgg"] == (1 << 31) + 10
        assert dict(t.column_summary("x", "k").dtypes)["num_records"] == dict(t.record_ids("keyed").dtypes)["page_num"] == "bigint"
    from tessera.operators.aggregates import count_all

    assert spark.range((1 << 31) + 10).agg(count_all(wide=False).alias("n")).first()["n"] == (1 << 31) - 1


def test_first_record_without_an_order_is_one_row(spark):
    database = Database(spark)
    database.attach("x", spark.createDataFrame([(2, "a"), (1, "z"), (1, "y")], "a int, b string"))
    with database.begin_transaction() as t:
        assert tuple(t.query("x").project(["a", "b"]).count().execute().first()) == (1, "y", 3)
