"""The registered queries: one for each operator, built with the engine's own API,
and the SQL that says the same."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Database, Transaction
from .errors import DatabaseError, QueryPlanError
from .functions.numbering import number_rows
from .operators.joins import JoinAlgorithm
from .operators.predicates import PredicateOperator
from .schema import Schema
from .sources.csv import read_csv
from .sources.memory import rows_frame
from .sources.workspace import work_folder
from .types import BOOL, FLOAT, INT, STRING, VARCHAR

#: Primary keys of the driver's tables: the order of insertion.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
}
#: Assumed sizes of strings in page arithmetic, 16 where none is given.  The SQL below counts with
#: the records a page that follow: 64 of customer (61 bytes), 80 of orders (48), 56 of lineitem (70).
SIZES = {"customer": {"c_name": 25}, "orders": {"o_orderstatus": 1, "o_orderpriority": 15}, "lineitem": {"l_returnflag": 1, "l_linestatus": 1}}
INDICES = {"orders": ["o_orderkey"], "part": ["p_size"]}


def open_tables(spark: SparkSession, sf_dir: str, *names: str) -> Transaction:
    """A transaction on a database that knows the given tables."""
    database = Database(spark)
    for name in names:
        database.attach_parquet(name, f"{sf_dir}/{name}.parquet", KEYS[name], SIZES.get(name), INDICES.get(name, ()))
    return database.begin_transaction()


def _stored(spark: SparkSession, sf_dir: str, name: str, schema: Schema) -> Transaction:
    """A transaction on a new stored table with the columns of a given one."""
    database = _new_database(spark)
    database.create_table(schema, name)
    transaction = database.begin_transaction()
    source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    transaction.load(name, source.select(*[F.col(c).cast(t.spark).alias(c) for c, t in zip(schema.names, schema.types)]), KEYS[name])
    return transaction


def _new_database(spark: SparkSession) -> Database:
    return Database(spark, work_folder(spark, f"database-{uuid.uuid4().hex}"))


def scan_seq(spark, sf_dir):
    return open_tables(spark, sf_dir, "nation").scan("nation")


def project_cols(spark, sf_dir):
    return open_tables(spark, sf_dir, "customer").query("customer").project(["c_custkey", "c_name"]).execute()


def _selected(table: str, columns: list[str], *predicates: tuple) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        plan = open_tables(spark, sf_dir, table).query(table).project(columns)
        for p in predicates:
            plan.select(*p)
        return plan.execute()

    return run


def join_snlj(spark, sf_dir):
    return open_tables(spark, sf_dir, "nation", "region").query("nation").join("region", "n_regionkey", "r_regionkey", JoinAlgorithm.SNLJ).project(["n_name", "r_name"]).execute()


def join_pnlj(spark, sf_dir):
    return open_tables(spark, sf_dir, "supplier", "nation").query("supplier").join("nation", "s_nationkey", "n_nationkey", JoinAlgorithm.PNLJ).project(["s_name", "n_name"]).execute()


def join_bnlj(spark, sf_dir):
    return open_tables(spark, sf_dir, "customer", "nation").query("customer").join("nation", "c_nationkey", "n_nationkey", JoinAlgorithm.BNLJ).project(["c_custkey", "n_name"]).execute()


def join_grace_hash(spark, sf_dir):
    return open_tables(spark, sf_dir, "orders", "customer").query("orders").join("customer", "o_custkey", "c_custkey", JoinAlgorithm.GHJ).project(["o_orderkey", "c_name"]).execute()


def join_sort_merge(spark, sf_dir):
    plan = open_tables(spark, sf_dir, "lineitem", "orders").query("lineitem").join("orders", "l_orderkey", "o_orderkey", JoinAlgorithm.SMJ)
    return plan.project(["l_orderkey", "l_linenumber", "o_orderstatus"]).execute()


def join_self_alias(spark, sf_dir):
    transaction = open_tables(spark, sf_dir, "nation")
    transaction.query_as("nation", "t1")
    transaction.query_as("nation", "t2")
    plan = transaction.query("t1").join("t2", "t1.n_regionkey", "t2.n_regionkey").project(["t1.n_nationkey", "t2.n_nationkey"])
    return plan.execute().toDF("left_key", "right_key")


def join_multi_way(spark, sf_dir):
    plan = open_tables(spark, sf_dir, "customer", "orders", "lineitem", "part").query("customer")
    plan.join("orders", "customer.c_custkey", "orders.o_custkey").join("lineitem", "orders.o_orderkey", "lineitem.l_orderkey").join("part", "lineitem.l_partkey", "part.p_partkey")
    return plan.project(["c_name", "p_name"]).execute()


def join_select_project(spark, sf_dir):
    plan = open_tables(spark, sf_dir, "customer", "orders").query("customer").join("orders", "c_custkey", "o_custkey")
    plan.select("c_mktsegment", "<>", "BUILDING").select("o_orderstatus", "=", "P")
    return plan.project(["c_name", "o_orderkey"]).execute()


def join_optimal(spark, sf_dir):
    """Join order and algorithms by the cost model."""
    plan = open_tables(spark, sf_dir, "customer", "orders", "nation").query("orders")
    plan.join("customer", "orders.o_custkey", "customer.c_custkey").join("nation", "customer.c_nationkey", "nation.n_nationkey").select("o_orderstatus", "=", "P")
    return plan.project(["o_orderkey", "n_name"]).execute_optimal()


def agg_count(spark, sf_dir):
    return open_tables(spark, sf_dir, "lineitem").query("lineitem").count().execute()


def agg_sum_int(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").query("part").sum("p_size").execute()


def agg_sum_double(spark, sf_dir):
    return open_tables(spark, sf_dir, "lineitem").query("lineitem").sum("l_extendedprice").execute().select(F.round("sumAgg", 2).alias("sumAgg"))


def agg_avg(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").query("part").average("p_size").execute().select(F.round("averageAgg", 6).alias("averageAgg"))


def agg_all(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").query("part").count().sum("p_size").average("p_size").execute().withColumn("averageAgg", F.round("averageAgg", 6))


def agg_empty_zero_rows(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").query("part").select("p_size", ">", 1000000).count().execute()


def agg_first_record(spark, sf_dir):
    """A projected column beside an aggregate has the value of the first record."""
    return open_tables(spark, sf_dir, "customer").query("customer").project(["c_name"]).count().execute()


def group_count_sum_avg(spark, sf_dir):
    plan = open_tables(spark, sf_dir, "lineitem").query("lineitem").project(["l_returnflag"]).group_by("l_returnflag")
    return plan.count().sum("l_linenumber").average("l_linenumber").execute().withColumn("averageAgg", F.round("averageAgg", 6))


def group_no_key_projected(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").query("part").group_by("p_brand").count().execute()


def group_rows_delimited(spark, sf_dir):
    return open_tables(spark, sf_dir, "nation").query("nation").group_by("n_regionkey").execute().toDF("group_id", "n_nationkey", "n_name", "n_regionkey")


def group_join_select(spark, sf_dir):
    plan = open_tables(spark, sf_dir, "customer", "nation").query("customer").join("nation", "c_nationkey", "n_nationkey")
    return plan.select("c_mktsegment", "=", "MACHINERY").project(["n_name"]).group_by("n_name").count().execute()


def index_lookup_key(spark, sf_dir):
    return open_tables(spark, sf_dir, "orders").lookup_key("orders", "o_orderkey", 4242).select("o_orderkey", "o_custkey")


def index_contains(spark, sf_dir):
    return spark.createDataFrame([(open_tables(spark, sf_dir, "orders").contains("orders", "o_orderkey", 4242),)], "found boolean")


def _positions(df: DataFrame) -> DataFrame:
    return number_rows(df.select("p_partkey", "p_size"), ["p_size", "p_partkey"], "pos", start=1)


def index_sorted_scan(spark, sf_dir):
    return _positions(open_tables(spark, sf_dir, "part").sorted_scan("part", "p_size"))


def index_sorted_scan_from(spark, sf_dir):
    return _positions(open_tables(spark, sf_dir, "part").sorted_scan_from("part", "p_size", 30))


def index_scan_range(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").index_scan("part", "p_size", PredicateOperator.LESS_THAN, 5).select("p_partkey", "p_size")


def stats_columns(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").column_summary("part", "p_size")


def stats_int_histogram(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").histogram("part", "p_size")


def stats_float_histogram(spark, sf_dir):
    return open_tables(spark, sf_dir, "lineitem").histogram("lineitem", "l_discount")


def stats_string_histogram(spark, sf_dir):
    return open_tables(spark, sf_dir, "part").histogram("part", "p_name")


def stats_bool_histogram(spark, sf_dir):
    return _flags(spark, sf_dir).histogram("flags", "returned")


def _flags(spark, sf_dir) -> Transaction:
    database = Database(spark)
    database.attach("flags", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_returnflag") == "R").alias("returned")))
    return database.begin_transaction()


def stats_reduction_factor(spark, sf_dir):
    stats = open_tables(spark, sf_dir, "part").stats("part", ["p_size"])
    column = stats.schema.index("p_size")
    ops = (PredicateOperator.EQUALS, PredicateOperator.LESS_THAN, PredicateOperator.GREATER_THAN)
    return spark.createDataFrame([tuple(round(stats.reduction_factor(column, op, 30), 6) for op in ops)], "rf_eq double, rf_lt30 double, rf_gt30 double")


def _factors(spark, stats, column: str, value: object) -> DataFrame:
    """The reduction factor of each comparison with a constant."""
    at = stats.schema.index(column)
    return spark.createDataFrame([(op.value, round(stats.reduction_factor(at, op, value), 5)) for op in PredicateOperator], "op string, factor double")


def stats_factors_int(spark, sf_dir):
    return _factors(spark, open_tables(spark, sf_dir, "part").stats("part", ["p_size"]), "p_size", 30)


def stats_factors_string(spark, sf_dir):
    return _factors(spark, open_tables(spark, sf_dir, "part").stats("part", ["p_name"]), "p_name", "hot")


def stats_factors_bool(spark, sf_dir):
    return _factors(spark, _flags(spark, sf_dir).stats("flags"), "returned", True)


def stats_int_range(spark, sf_dir):
    """Entries in a range, and the least and greatest value, as the histogram tells them."""
    histogram = _size_histogram(spark, sf_dir)
    return spark.createDataFrame([(histogram.entries_in_range(13, 27), histogram.minimum, histogram.maximum)], "entries long, min_value int, max_value int")


def _size_histogram(spark, sf_dir):
    stats = open_tables(spark, sf_dir, "part").stats("part", ["p_size"])
    return stats.histograms[stats.schema.index("p_size")]


def _buckets(spark, histogram) -> DataFrame:
    return spark.createDataFrame([(i, c, histogram.distinct) for i, c in enumerate(histogram.counts)], "bucket int, cnt long, distinct_values long")


def stats_filtered(spark, sf_dir):
    """The histogram that is estimated after ``p_size <= 27``."""
    return _buckets(spark, _size_histogram(spark, sf_dir).filtered(PredicateOperator.LESS_THAN_EQUALS, 27))


def stats_reduced(spark, sf_dir):
    """The histogram that is estimated after a filter on another column."""
    return _buckets(spark, _size_histogram(spark, sf_dir).reduced(0.3))


def stats_joined(spark, sf_dir):
    """Rows that are estimated for a join."""
    transaction = open_tables(spark, sf_dir, "orders", "customer")
    orders, customer = transaction.stats("orders", ["o_custkey"]), transaction.stats("customer", ["c_custkey"])
    joined = orders.with_join(orders.schema.index("o_custkey"), customer, customer.schema.index("c_custkey"))
    return spark.createDataFrame([(joined.num_records,)], "num_records long")


def index_exists(spark, sf_dir):
    transaction = open_tables(spark, sf_dir, "orders", "part")
    transaction.query_as("part", "p")
    asked = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("part", "p_size"), ("p", "p.p_size"), ("p", "p_name")]
    return spark.createDataFrame([(t, c, transaction.index_exists(t, c)) for t, c in asked], "table_name string, column_name string, found boolean")


def index_pages(spark, sf_dir):
    return spark.createDataFrame([(open_tables(spark, sf_dir, "part").num_index_pages("part", "p_size"),)], "num_pages int")


def table_sizes(spark, sf_dir):
    """What a transaction tells about a table."""
    t = open_tables(spark, sf_dir, "orders")
    row = (t.num_records("orders"), t.num_data_pages("orders"), t.num_entries_per_page("orders"), t.entry_size("orders"), t.page_header_size("orders"), t.num_memory_pages)
    return spark.createDataFrame([row], "num_records long, num_data_pages long, num_entries int, entry_size int, header_size int, memory_pages int")


def table_schema(spark, sf_dir):
    schema = open_tables(spark, sf_dir, "nation").fully_qualified_schema("nation")
    return spark.createDataFrame([(n, str(t)) for n, t in zip(schema.names, schema.types)], "column_name string, column_type string")


def page_header(spark, sf_dir):
    """Used slots of a page, from its bitmap, after a record in it was deleted."""
    transaction = _stored(spark, sf_dir, "region", _REGION)
    transaction.delete_record("region", _place(transaction, 2))
    bits = "".join(f"{b:08b}" for b in transaction.read_page_header("region", 1))
    return spark.createDataFrame([(i,) for i, bit in enumerate(bits) if bit == "1"], "slot int")


def stats_num_pages(spark, sf_dir):
    return spark.createDataFrame([(open_tables(spark, sf_dir, "lineitem").num_data_pages("lineitem"),)], "num_pages int")


def record_ids(spark, sf_dir):
    return open_tables(spark, sf_dir, "orders").record_ids("orders").select("o_orderkey", "page_num", "entry_num")


def page_entries(spark, sf_dir):
    return open_tables(spark, sf_dir, "orders").pages("orders").select("page_num", "num_entries")


_REGION = Schema(["r_regionkey", "r_name"], [INT, VARCHAR()])


def dml_insert(spark, sf_dir):
    transaction = _stored(spark, sf_dir, "region", _REGION)
    transaction.add_record("region", [5, "ATLANTIS"])
    return transaction.scan("region")


def _place(transaction: Transaction, key: int):
    row = transaction.record_ids("region").filter(F.col("r_regionkey") == key).first()
    return transaction.schema("region").record_id((row["page_num"] - 1) * transaction.num_entries_per_page("region") + row["entry_num"])


def dml_update(spark, sf_dir):
    transaction = _stored(spark, sf_dir, "region", _REGION)
    transaction.update_record("region", [0, "RENAMED"], _place(transaction, 0))
    return transaction.scan("region")


def dml_delete(spark, sf_dir):
    transaction = _stored(spark, sf_dir, "region", _REGION)
    transaction.delete_record("region", _place(transaction, 0))
    return transaction.scan("region")


def temp_table(spark, sf_dir):
    """A temporary table joined with a stored one."""
    transaction = _stored(spark, sf_dir, "region", _REGION)
    transaction.create_temp_table(Schema(["key"], [INT]), "wanted")
    transaction.add_records("wanted", [[1], [3], [3]])
    return transaction.query("wanted").join("region", "key", "r_regionkey").project(["r_name"]).execute()


def table_reopened(spark, sf_dir):
    """A stored table, read by a database that was opened again on its folder."""
    transaction = _stored(spark, sf_dir, "region", _REGION)
    root = transaction._db.root
    transaction.end()
    transaction._db.close()
    return Database(spark, root).begin_transaction().scan("region")


def table_dropped(spark, sf_dir):
    """Tables that are left after one of three was dropped, and whether each drop found its table."""
    database = _new_database(spark)
    for name in ("a", "b", "c"):
        database.create_table_with_indices(Schema(["k"], [INT]), name, ["k"])
    found = [database.delete_table(n) for n in ("b", "b")]
    left = database.table_names
    return spark.createDataFrame([(",".join(left), *found, database.delete_all_tables(), len(database.table_names))], "tables string, first_drop boolean, second_drop boolean, all_dropped boolean, n_left int")


def record_fetched(spark, sf_dir):
    transaction = _stored(spark, sf_dir, "region", _REGION)
    return spark.createDataFrame([transaction.get_record("region", _place(transaction, 3))], "r_regionkey int, r_name string")


def record_iterator(spark, sf_dir):
    """Records in the order of an iterator over pages and slots."""
    transaction = _stored(spark, sf_dir, "region", _REGION)
    return spark.createDataFrame([(i, r["r_regionkey"], r["r_name"]) for i, r in enumerate(transaction.records("region"), 1)], "pos int, r_regionkey int, r_name string")


_MIXED = Schema(["truth", "whole", "letters", "part"], [BOOL, INT, STRING(3), FLOAT])


def rows_in_memory(spark, sf_dir):
    """Rows given in a program: strings are cut or padded, floats single."""
    return rows_frame(spark, [(True, 1, "a", 0.5), (False, -2, "abcd", 0.25)], _MIXED).select(*_MIXED.names)


def csv_load(spark, sf_dir):
    path = work_folder(spark, f"nation-{uuid.uuid4().hex}.csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit(" "), "n_name").alias("n_name"), "n_regionkey").write.csv(path)
    return read_csv(spark, path, Schema(["n_nationkey", "n_name", "n_regionkey"], [INT, STRING(12), INT]))


def agg_sum_float(spark, sf_dir):
    """The sum of a column in single precision."""
    database = Database(spark)
    database.attach("sizes", spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * 0.25).cast("float").alias("quarter")))
    return database.begin_transaction().query("sizes").sum("quarter").average("quarter").execute()


def _refused(spark, build: Callable[[], object]) -> DataFrame:
    try:
        build()
        name = None
    except QueryPlanError as error:
        name = type(error).__name__
    return spark.createDataFrame([(name,)], "error string")


def agg_type_check(spark, sf_dir):
    """A sum over strings is refused."""
    return _refused(spark, open_tables(spark, sf_dir, "part").query("part").sum("p_name").execute)


def group_projection_check(spark, sf_dir):
    """A query with groups projects only the group's column."""
    return _refused(spark, open_tables(spark, sf_dir, "part").query("part").project(["p_size"]).group_by("p_brand").count().execute)


def group_rows_projected(spark, sf_dir):
    return open_tables(spark, sf_dir, "nation").query("nation").project(["n_regionkey"]).group_by("n_regionkey").execute()


def transaction_states(spark, sf_dir):
    """Whether a transaction is active before and after its end, and whether its temporary table and a waiting transaction are as they should be."""
    database = _new_database(spark)
    database.create_table(Schema(["k"], [INT]), "t")
    first, second, entered = database.begin_transaction(), database.begin_transaction(), threading.Event()
    first.create_temp_table(Schema(["k"], [INT]), "temp")
    waiting = threading.Thread(target=lambda: (second.schema("t"), entered.set()))
    waiting.start()
    states = [first.is_active, entered.wait(0.2)]
    first.end()
    states += [first.is_active, entered.wait(10)]
    try:
        second.schema("temp")
        states.append(True)
    except DatabaseError:
        states.append(False)
    second.end()
    return spark.createDataFrame([tuple(states)], "active boolean, second_at_once boolean, active_at_end boolean, second_later boolean, temp_left boolean")


def plan_tree(spark, sf_dir):
    """The estimated plan of a query, line by line."""
    plan = open_tables(spark, sf_dir, "nation", "region").query("nation").join("region", "nation.n_regionkey", "region.r_regionkey").select("nation.n_nationkey", ">", 3).project(["nation.n_name"])
    plan.execute_optimal()
    return spark.createDataFrame(list(enumerate(plan.explain_tree().split("\n"), 1)), "line int, text string")


def plan_costs(spark, sf_dir):
    """Estimated cost of each join algorithm that the planner considers."""
    transaction = open_tables(spark, sf_dir, "customer", "orders")
    rows = []
    for algorithm in (JoinAlgorithm.SNLJ, JoinAlgorithm.PNLJ, JoinAlgorithm.BNLJ, JoinAlgorithm.GHJ):
        plan = transaction.query("customer").join("orders", "c_custkey", "o_custkey", algorithm)
        plan.execute()
        rows.append((algorithm.name, plan.final_operator.cost, plan.final_operator.stats.num_records))
    return spark.createDataFrame(rows, "algorithm string, cost long, num_records long")


def char_pad(spark, sf_dir):
    return _stored(spark, sf_dir, "nation", Schema(["n_nationkey", "n_name"], [INT, STRING(20)])).scan("nation")


_PLAIN = (
    scan_seq, project_cols, join_snlj, join_pnlj, join_bnlj, join_grace_hash, join_sort_merge, join_self_alias, join_multi_way, join_select_project, join_optimal,
    agg_count, agg_sum_int, agg_sum_double, agg_avg, agg_all, agg_empty_zero_rows, agg_first_record, group_count_sum_avg, group_no_key_projected, group_rows_delimited,
    group_join_select, index_lookup_key, index_contains, index_sorted_scan, index_sorted_scan_from, index_scan_range, stats_columns, stats_int_histogram,
    stats_float_histogram, stats_string_histogram, stats_bool_histogram, stats_reduction_factor, stats_num_pages, record_ids, page_entries, dml_insert, dml_update,
    dml_delete, temp_table, char_pad, stats_factors_int, stats_factors_string, stats_factors_bool, stats_int_range, stats_filtered, stats_reduced, stats_joined, index_exists,
    index_pages, table_sizes, table_schema, page_header, table_reopened, table_dropped, record_fetched, record_iterator, rows_in_memory, csv_load, agg_sum_float, agg_type_check,
    group_projection_check, group_rows_projected, transaction_states, plan_tree, plan_costs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in _PLAIN}
    found |= {
        "select_eq_int": _selected("part", ["p_partkey", "p_size"], ("p_size", "=", 15)),
        "select_ne_str": _selected("orders", ["o_orderkey", "o_orderstatus"], ("o_orderstatus", "<>", "F")),
        "select_lt_int": _selected("part", ["p_partkey", "p_size"], ("p_size", "<", 10)),
        "select_le_int": _selected("part", ["p_partkey", "p_size"], ("p_size", "<=", 10)),
        "select_gt_double": _selected("orders", ["o_orderkey", "o_totalprice"], ("o_totalprice", ">", 400000.0)),
        "select_ge_str": _selected("part", ["p_partkey", "p_brand"], ("p_brand", ">=", "Brand#2")),
        "select_conj": _selected("lineitem", ["l_orderkey", "l_linenumber"], ("l_linenumber", "=", 3), ("l_quantity", "<", 10.0), ("l_returnflag", "=", "R")),
        "select_empty": _selected("part", ["p_partkey"], ("p_size", ">=", 2147483647)),
    }
    return found


_WIDTH = "WITH m AS (SELECT CASE WHEN MIN(p_size) >= -50 AND MAX(p_size) < 50 THEN 10 WHEN MIN(p_size) >= -100 AND MAX(p_size) < 100 THEN 20 ELSE 40 END AS w FROM part)"


#: Counts, bounds and distinct values of the histogram of part.p_size.
_BUCKETS = f"""{_WIDTH}, b AS (SELECT i AS bucket, (i - 5) * w AS lo, (i - 4) * w AS hi, w, (SELECT COUNT(*) FROM part WHERE p_size >= (i - 5) * w AND p_size < (i - 4) * w) AS cnt,
  (SELECT COUNT(DISTINCT p_size) FROM part) AS ndv FROM m CROSS JOIN range(10) r(i)), e AS (SELECT MIN(lo) AS lo, MAX(hi) AS hi, MAX(ndv) AS ndv FROM b WHERE cnt > 0)"""
#: First and last of the 36 buckets of part.p_name that have entries, and that of the constant "hot".
_LETTERS = "WITH l AS (SELECT MIN(strpos('abcdefghijklmnopqrstuvwxyz0123456789', substr(lower(p_name), 1, 1))) AS lo, MAX(strpos('abcdefghijklmnopqrstuvwxyz0123456789', substr(lower(p_name), 1, 1))) AS hi, 8 AS v FROM part)"
#: The lines of the plan of plan_tree.
_TREE = (
    "type: PROJECT", "columns: [nation.n_name]", "\ttype: BNLJ", "\tleftColumn: nation.n_regionkey", "\trightColumn: region.r_regionkey",
    "\t\t(left)", "\t\ttype: SELECT", "\t\tcolumn: nation.n_nationkey", "\t\toperator: GREATER_THAN", "\t\tvalue: 3", "\t\t\ttype: SEQSCAN", "\t\t\ttable: nation",
    "\t", "\t\t(right)", "\t\ttype: SEQSCAN", "\t\ttable: region",
)
_PAGES = "WITH c AS (SELECT COUNT(*) AS n, CAST(CEIL(COUNT(*) / 64.0) AS BIGINT) AS p, COUNT(DISTINCT c_custkey) AS ndv FROM customer), o AS (SELECT COUNT(*) AS n, CAST(CEIL(COUNT(*) / 80.0) AS BIGINT) AS p, COUNT(DISTINCT o_custkey) AS ndv FROM orders)"
_PAGES += ", j AS (SELECT CAST(TRUNC(CAST(c.n * o.n AS FLOAT) * (CAST(1 AS FLOAT) / CAST(GREATEST(c.ndv, o.ndv) AS FLOAT))) AS BIGINT) AS num_records FROM c CROSS JOIN o)"


def oracle_sql() -> dict[str, str]:
    return {
        "scan_seq": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "project_cols": "SELECT c_custkey, c_name FROM customer",
        "select_eq_int": "SELECT p_partkey, p_size FROM part WHERE p_size = 15",
        "select_ne_str": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
        "select_lt_int": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
        "select_le_int": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
        "select_gt_double": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000.0",
        "select_ge_str": "SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#2'",
        "select_conj": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 AND l_quantity < 10.0 AND l_returnflag = 'R'",
        "select_empty": "SELECT p_partkey FROM part WHERE p_size >= 2147483647",
        "join_snlj": "SELECT n.n_name AS n_name, r.r_name AS r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        "join_pnlj": "SELECT s.s_name AS s_name, n.n_name AS n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
        "join_bnlj": "SELECT c.c_custkey AS c_custkey, n.n_name AS n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
        "join_grace_hash": "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
        "join_sort_merge": "SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, o.o_orderstatus AS o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
        "join_self_alias": "SELECT t1.n_nationkey AS left_key, t2.n_nationkey AS right_key FROM nation t1 JOIN nation t2 ON t1.n_regionkey = t2.n_regionkey",
        "join_multi_way": "SELECT c.c_name AS c_name, p.p_name AS p_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey",
        "join_select_project": "SELECT c.c_name AS c_name, o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment <> 'BUILDING' AND o.o_orderstatus = 'P'",
        "join_optimal": "SELECT o.o_orderkey AS o_orderkey, n.n_name AS n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'P'",
        "agg_count": "SELECT COUNT(*) AS countAgg FROM lineitem",
        "agg_sum_int": "SELECT CAST(SUM(p_size) AS INT) AS sumAgg FROM part",
        "agg_sum_double": "SELECT ROUND(SUM(l_extendedprice), 2) AS sumAgg FROM lineitem",
        "agg_avg": "SELECT ROUND(AVG(p_size), 6) AS averageAgg FROM part",
        "agg_all": "SELECT COUNT(*) AS countAgg, CAST(SUM(p_size) AS INT) AS sumAgg, ROUND(AVG(p_size), 6) AS averageAgg FROM part",
        "agg_empty_zero_rows": "SELECT COUNT(*) AS countAgg FROM part WHERE p_size > 1000000 HAVING COUNT(*) > 0",
        "agg_first_record": "SELECT arg_min(c_name, c_custkey) AS c_name, COUNT(*) AS countAgg FROM customer HAVING COUNT(*) > 0",
        "group_count_sum_avg": "SELECT l_returnflag, COUNT(*) AS countAgg, CAST(SUM(l_linenumber) AS INT) AS sumAgg, ROUND(AVG(l_linenumber), 6) AS averageAgg FROM lineitem GROUP BY l_returnflag",
        "group_no_key_projected": "SELECT COUNT(*) AS countAgg FROM part GROUP BY p_brand",
        "group_rows_delimited": "SELECT DENSE_RANK() OVER (ORDER BY n_regionkey) AS group_id, n_nationkey, n_name, n_regionkey FROM nation",
        "group_join_select": "SELECT n.n_name AS n_name, COUNT(*) AS countAgg FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment = 'MACHINERY' GROUP BY n.n_name",
        "index_lookup_key": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 4242",
        "index_contains": "SELECT COUNT(*) > 0 AS found FROM orders WHERE o_orderkey = 4242",
        "index_sorted_scan": "SELECT ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) AS pos, p_partkey, p_size FROM part",
        "index_sorted_scan_from": "SELECT ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) AS pos, p_partkey, p_size FROM part WHERE p_size >= 30",
        "index_scan_range": "SELECT p_partkey, p_size FROM part WHERE p_size < 5",
        "stats_columns": "SELECT COUNT(*) AS num_records, COUNT(DISTINCT p_size) AS num_distinct, MIN(p_size) AS min_value, MAX(p_size) AS max_value FROM part",
        "stats_int_histogram": f"{_WIDTH} SELECT CAST(FLOOR((p_size + 5 * m.w) / CAST(m.w AS DOUBLE)) AS INT) AS bucket, COUNT(*) AS cnt FROM part CROSS JOIN m GROUP BY CAST(FLOOR((p_size + 5 * m.w) / CAST(m.w AS DOUBLE)) AS INT)",
        "stats_float_histogram": "WITH v AS (SELECT CAST(TRUNC(CAST(l_discount AS FLOAT) * CAST(10000 AS FLOAT)) AS BIGINT) AS x FROM lineitem), m AS (SELECT 50 * CAST(POW(2, GREATEST(0, CEIL(LOG2((MAX(x) + 1) / 50.0)))) AS BIGINT) AS half FROM v) SELECT CAST(FLOOR((x + half) / (half / 5.0)) AS INT) AS bucket, COUNT(*) AS cnt FROM v CROSS JOIN m GROUP BY 1",
        "stats_string_histogram": "SELECT SUBSTRING(LOWER(p_name), 1, 1) AS bucket, COUNT(*) AS cnt FROM part GROUP BY SUBSTRING(LOWER(p_name), 1, 1)",
        "stats_bool_histogram": "SELECT (l_returnflag = 'R') AS bucket, COUNT(*) AS cnt FROM lineitem GROUP BY (l_returnflag = 'R')",
        "stats_reduction_factor": f"{_WIDTH}, b AS (SELECT COUNT(DISTINCT p_size) AS ndv, MIN(FLOOR(p_size / CAST(m.w AS DOUBLE)) * m.w) AS lo, MAX(FLOOR(p_size / CAST(m.w AS DOUBLE)) * m.w + m.w) AS hi FROM part CROSS JOIN m) SELECT ROUND(CAST(1 AS DOUBLE) / ndv, 6) AS rf_eq, ROUND(CAST(30 - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE), 6) AS rf_lt30, ROUND(CAST(hi - 30 AS DOUBLE) / CAST(hi - lo AS DOUBLE), 6) AS rf_gt30 FROM b",
        "stats_num_pages": "SELECT CAST(CEIL(COUNT(*) / 56.0) AS INT) AS num_pages FROM lineitem",
        "record_ids": "SELECT o_orderkey, CAST(1 + FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 80.0) AS BIGINT) AS page_num, CAST((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) % 80 AS INT) AS entry_num FROM orders",
        "page_entries": "SELECT page_num, CAST(COUNT(*) AS INT) AS num_entries FROM (SELECT CAST(1 + FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 80.0) AS BIGINT) AS page_num FROM orders) GROUP BY page_num",
        "dml_insert": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(5 AS INT), 'ATLANTIS'",
        "dml_update": "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'RENAMED' ELSE r_name END AS r_name FROM region",
        "dml_delete": "SELECT r_regionkey, r_name FROM region WHERE NOT (r_regionkey = 0)",
        "temp_table": "SELECT r_name FROM (VALUES (1), (3), (3)) AS wanted(key) JOIN region ON key = r_regionkey",
        "char_pad": "SELECT n_nationkey, RPAD(n_name, 20, ' ') AS n_name FROM nation",
        "stats_factors_int": f"{_BUCKETS} SELECT op, ROUND(CAST(CASE op WHEN '=' THEN 1.0 / ndv WHEN '<' THEN (30 - lo) / CAST(hi - lo AS DOUBLE) WHEN '>' THEN (hi - 30) / CAST(hi - lo AS DOUBLE) WHEN '<=' THEN (30 - lo) / CAST(hi - lo AS DOUBLE) + 1.0 / ndv WHEN '>=' THEN (hi - 30) / CAST(hi - lo AS DOUBLE) + 1.0 / ndv ELSE 0 END AS DOUBLE), 5) AS factor FROM e CROSS JOIN (VALUES ('='), ('!='), ('<'), ('<='), ('>'), ('>=')) AS ops(op)",
        "stats_factors_string": f"{_LETTERS} SELECT op, ROUND(CAST(CASE op WHEN '<' THEN (v - lo) / CAST(hi - lo + 1 AS DOUBLE) WHEN '>' THEN (hi - v) / CAST(hi - lo + 1 AS DOUBLE) ELSE 1 END AS DOUBLE), 5) AS factor FROM l CROSS JOIN (VALUES ('='), ('!='), ('<'), ('<='), ('>'), ('>=')) AS ops(op)",
        "stats_factors_bool": "WITH s AS (SELECT AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS yes FROM lineitem) SELECT op, ROUND(CAST(CASE op WHEN '=' THEN yes WHEN '!=' THEN 1 - yes ELSE 1 END AS DOUBLE), 5) AS factor FROM s CROSS JOIN (VALUES ('='), ('!='), ('<'), ('<='), ('>'), ('>=')) AS ops(op)",
        "stats_int_range": f"{_BUCKETS} SELECT (SELECT CAST(SUM(CEIL(CAST(cnt AS FLOAT) * (CAST(GREATEST(0, LEAST(27, hi) - GREATEST(13, lo)) AS FLOAT) / CAST(w AS FLOAT)))) AS BIGINT) FROM b) AS entries, CAST(lo AS INT) AS min_value, CAST(hi AS INT) AS max_value FROM e",
        "stats_filtered": f"{_BUCKETS} SELECT CAST(b.bucket AS INT) AS bucket, b.cnt * GREATEST(0, LEAST(27, b.hi) - b.lo) // b.w + CASE WHEN b.lo <= 27 AND 27 < b.hi THEN b.cnt // b.w ELSE 0 END AS cnt, CAST(TRUNC(CAST(e.ndv AS FLOAT) * CAST((27 - e.lo) / CAST(e.hi - e.lo AS DOUBLE) + 1.0 / e.ndv AS FLOAT)) AS BIGINT) AS distinct_values FROM b CROSS JOIN e",
        "stats_reduced": f"{_BUCKETS} SELECT CAST(bucket AS INT) AS bucket, CAST(TRUNC(CAST(cnt AS FLOAT) * CAST(0.3 AS FLOAT)) AS BIGINT) AS cnt, CAST(CEIL(CAST(ndv AS FLOAT) * CAST(0.3 AS FLOAT)) AS BIGINT) AS distinct_values FROM b",
        "stats_joined": f"{_PAGES} SELECT num_records FROM j",
        "index_exists": "SELECT * FROM (VALUES ('orders', 'o_orderkey', TRUE), ('orders', 'o_custkey', FALSE), ('part', 'p_size', TRUE), ('p', 'p.p_size', TRUE), ('p', 'p_name', FALSE)) AS x(table_name, column_name, found)",
        "index_pages": "WITH RECURSIVE levels(n, pages) AS (SELECT CAST(CASE WHEN COUNT(*) <= 400 THEN 1 ELSE CEIL(COUNT(*) / (400 * 2 / 3.0)) END AS BIGINT), CAST(1 + CASE WHEN COUNT(*) <= 400 THEN 1 ELSE CEIL(COUNT(*) / (400 * 2 / 3.0)) END AS BIGINT) FROM part UNION ALL SELECT CAST(CEIL(n / (496 * 2 / 3.0)) AS BIGINT), pages + CAST(CEIL(n / (496 * 2 / 3.0)) AS BIGINT) FROM levels WHERE n > 1) SELECT CAST(MAX(pages) AS INT) AS num_pages FROM levels",
        "table_sizes": "SELECT COUNT(*) AS num_records, CAST(CEIL(COUNT(*) / 80.0) AS BIGINT) AS num_data_pages, CAST(80 AS INT) AS num_entries, CAST(48 AS INT) AS entry_size, CAST(10 AS INT) AS header_size, CAST(5 AS INT) AS memory_pages FROM orders",
        "table_schema": "SELECT * FROM (VALUES ('nation.n_nationkey', 'INT'), ('nation.n_name', 'VARCHAR'), ('nation.n_regionkey', 'INT')) AS x(column_name, column_type)",
        "page_header": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY r_regionkey) - 1 AS INT) AS slot FROM region QUALIFY r_regionkey <> 2",
        "table_reopened": "SELECT r_regionkey, r_name FROM region",
        "table_dropped": "SELECT 'a,c' AS tables, TRUE AS first_drop, FALSE AS second_drop, TRUE AS all_dropped, CAST(0 AS INT) AS n_left",
        "record_fetched": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 3",
        "record_iterator": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY r_regionkey) AS INT) AS pos, r_regionkey, r_name FROM region",
        "rows_in_memory": "SELECT * FROM (VALUES (TRUE, CAST(1 AS INT), 'a  ', CAST(0.5 AS FLOAT)), (FALSE, CAST(-2 AS INT), 'abc', CAST(0.25 AS FLOAT))) AS x(truth, whole, letters, part)",
        "csv_load": "SELECT CAST(n_nationkey AS INT) AS n_nationkey, RPAD(n_name, 12, ' ') AS n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation",
        "agg_sum_float": "SELECT CAST(SUM(CAST(p_size * 0.25 AS DOUBLE)) AS FLOAT) AS sumAgg, AVG(CAST(p_size * 0.25 AS DOUBLE)) AS averageAgg FROM part",
        "agg_type_check": "SELECT 'QueryPlanError' AS error",
        "group_projection_check": "SELECT 'QueryPlanError' AS error",
        "group_rows_projected": "SELECT DENSE_RANK() OVER (ORDER BY n_regionkey) AS group_id, n_regionkey FROM nation",
        "transaction_states": "SELECT TRUE AS active, FALSE AS second_at_once, FALSE AS active_at_end, TRUE AS second_later, FALSE AS temp_left",
        "plan_tree": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{text}')" for i, text in enumerate(_TREE, 1)) + ") AS x(line, text)",
        "plan_costs": f"{_PAGES} SELECT algorithm, CASE algorithm WHEN 'SNLJ' THEN c.n * o.p + c.p WHEN 'PNLJ' THEN c.p * o.p + c.p WHEN 'BNLJ' THEN CAST(CEIL(c.p / 3.0) AS BIGINT) * o.p + c.p ELSE 3 * (c.p + o.p) END AS cost, j.num_records FROM c CROSS JOIN o CROSS JOIN j CROSS JOIN (VALUES ('SNLJ'), ('PNLJ'), ('BNLJ'), ('GHJ')) AS a(algorithm)",
    }
