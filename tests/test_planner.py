import pytest

from tessera import JoinAlgorithm, QueryPlanError
from tessera.functions.histograms import IntHistogram
from tessera.functions.stats import TableStats
from tessera.operators.predicates import PredicateOperator as Op
from tessera.plans.cost import index_pages, index_scan_cost, join_cost, node_entries
from tessera import INT

from .fixtures import ALL, ONE_INT, fill, valued
from .test_histograms import ints


def pages(n, extra=0):
    return TableStats(ALL, (), n * ALL.entries_per_page + extra)


def test_index_arithmetic():
    assert node_entries(10) == 400 and node_entries(8) == 496
    assert index_pages(300, INT) == 2


def test_whole_index_nodes_are_not_rounded_up():
    assert [index_pages(n, INT) for n in (0, 400, 401, 800, 801, 20000, 120000)] == [2, 2, 4, 5, 6, 77, 454]
    assert index_pages(992 * 800, INT) == 1 + 2976 + 9 + 1  # whole leaves and whole inner nodes


def test_index_scan_costs():
    for values, bound, want in [(range(300), 200, 115), ([*range(300), *range(700)], 500, 379)]:
        stats = TableStats(ONE_INT, (ints(list(values)),), len(values))
        assert index_scan_cost(stats, 0, Op.GREATER_THAN_EQUALS, bound) == want


@pytest.mark.parametrize(
    "algorithm, left, right, want",
    [
        (JoinAlgorithm.SNLJ, pages(2), pages(4), (2306, 2308)),
        (JoinAlgorithm.PNLJ, pages(2), pages(3, 10), (10, 12)),
        (JoinAlgorithm.BNLJ, pages(17, 100), pages(4), (42, 40)),
        (JoinAlgorithm.GHJ, pages(18), pages(3, 287), (66, 66)),
    ],
)
def test_join_costs(algorithm, left, right, want):
    assert (join_cost(algorithm, left, right, 5), join_cost(algorithm, right, left, 5)) == want


def test_no_cost_for_sort_merge():
    with pytest.raises(NotImplementedError):
        join_cost(JoinAlgorithm.SMJ, pages(1), pages(1), 5)


def test_histogram_names():
    assert isinstance(ints([1]), IntHistogram)


def test_self_join_tree(database):
    fill(database, "t", [valued(i) for i in range(1000)])
    with database.begin_transaction() as t:
        t.query_as("t", "t1")
        t.query_as("t", "t2")
        plan = t.query("t1").join("t2", "t1.int", "t2.int")
        assert plan.execute_optimal().count() == 1000
        trees = [
            f"type: BNLJ\nleftColumn: {a}.int\nrightColumn: {b}.int\n\t(left)\n\ttype: SEQSCAN\n\ttable: {a}\n\n\t(right)\n\ttype: SEQSCAN\n\ttable: {b}"
            for a, b in (("t1", "t2"), ("t2", "t1"))
        ]
        assert plan.explain_tree() in trees


def test_index_is_used_when_it_pays(database):
    fill(database, "l", [valued(i) for i in range(1001)], indices=["int"])
    fill(database, "r", [valued(i) for i in range(1000, 2000)], indices=["int"])
    with database.begin_transaction() as t:
        plan = t.query("l").join("r", "l.int", "r.int").select("l.int", "=", 1)
        assert plan.execute_optimal().count() == 0
        assert plan.explain_tree() == (
            "type: BNLJ\nleftColumn: l.int\nrightColumn: r.int\n\t(left)\n\ttype: INDEXSCAN\n\ttable: l\n\tcolumn: l.int\n\toperator: EQUALS\n\tvalue: 1\n\n"
            "\t(right)\n\ttype: SEQSCAN\n\ttable: r"
        )


def test_index_is_not_used_when_it_does_not_pay(database):
    fill(database, "l", [valued(1)] * 1000 + [valued(2)], indices=["int"])
    fill(database, "r", [valued(i) for i in range(1000)], indices=["int"])
    with database.begin_transaction() as t:
        plan = t.query("l").join("r", "l.int", "r.int").select("l.int", "=", 1)
        assert plan.execute_optimal().count() == 1000
        assert "INDEXSCAN" not in plan.explain_tree() and "type: SELECT" in plan.explain_tree()


def test_declared_tree(database):
    fill(database, "t", [valued(i) for i in range(10)], indices=["int"])
    with database.begin_transaction() as t:
        plan = t.query("t").select("float", ">", 2.5).select("int", "<", 7).project(["int"])
        with pytest.raises(QueryPlanError):
            plan.explain_tree()
        assert plan.execute().count() == 4
        assert plan.explain_tree() == (
            "type: PROJECT\ncolumns: [t.int]\n\ttype: SELECT\n\tcolumn: t.float\n\toperator: GREATER_THAN\n\tvalue: 2.5\n"
            "\t\ttype: INDEXSCAN\n\t\ttable: t\n\t\tcolumn: t.int\n\t\toperator: LESS_THAN\n\t\tvalue: 7"
        )
        grouped = t.query("t").group_by("int").count()
        grouped.execute()
        assert grouped.explain_tree().startswith("type: PROJECT\ncolumns: []\n\ttype: GROUPBY\n\tcolumn: t.int\n\t\ttype: SEQSCAN")
        assert plan.final_operator.cost > 0 and plan.final_operator.stats.num_records >= 0


def test_unconnected_tables_are_refused(database):
    fill(database, "a", [(1,)], ONE_INT)
    with database.begin_transaction() as t:
        t.query_as("a", "b")
        with pytest.raises(QueryPlanError):
            t.query("a").join("b", "b.int", "b.int").execute_optimal()
