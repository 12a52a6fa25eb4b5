import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import BOOL, FLOAT, INT, STRING, Database, DatabaseError, RecordID, Schema
from tessera.functions import numbering
from tessera.sources import workspace
from tessera.sources.csv import read_csv

from .fixtures import ALL, CONSTANT, ONE_INT, fill, valued


def test_places(database):
    fill(database, "t", [valued(i) for i in range(289)])
    with database.begin_transaction() as t:
        assert t.num_records("t") == 289 and t.num_data_pages("t") == 2
        places = t.add_records("t", [valued(1000), valued(1001)])
        assert places == [RecordID(2, 1), RecordID(2, 2)]
        assert t.get_record("t", RecordID(1, 287)) == valued(287)
        assert t.read_page_header("t", 2) == bytes([0b11100000]) + bytes(35)
        assert [r["num_entries"] for r in t.pages("t").orderBy("page_num").collect()] == [288, 3]


def test_slots_are_used_again(database):
    fill(database, "t", [valued(i) for i in range(6)])
    with database.begin_transaction() as t:
        for slot in (4, 1, 2):
            assert t.delete_record("t", RecordID(1, slot))[1] == slot
        assert t.num_records("t") == 3
        with pytest.raises(DatabaseError):
            t.get_record("t", RecordID(1, 1))
        assert [p.slot for p in t.add_records("t", [valued(10 + i) for i in range(5)])] == [1, 2, 4, 6, 7]
        assert [r["int"] for r in t.records("t")] == [0, 10, 11, 3, 12, 5, 13, 14]


def test_update(database):
    fill(database, "t", [valued(i) for i in range(3)], indices=["int"])
    with database.begin_transaction() as t:
        assert t.update_record("t", valued(9), RecordID(1, 1)) == valued(1)
        assert [r["int"] for r in t.records("t")] == [0, 9, 2]
        with pytest.raises(DatabaseError):
            t.update_record("t", valued(9), RecordID(1, 7))
        with pytest.raises(DatabaseError):
            t.update_record("t", (1, 2), RecordID(1, 1))
        assert t.get_record("t", RecordID(1, 1)) == valued(9)


def test_many_inserts_are_compacted(database, monkeypatch):
    monkeypatch.setattr("tessera.sources.table.MAX_SEGMENTS", 3)
    database.create_table(ONE_INT, "t")
    with database.begin_transaction() as t:
        for i in range(8):
            t.add_record("t", [i])
        assert sorted(r["int"] for r in t.scan("t").collect()) == list(range(8))
    assert len(database._tables["t"].segments) <= 4


def test_durability(database, spark):
    fill(database, "t", [CONSTANT])
    database.close()
    again = Database(spark, database.root)
    with again.begin_transaction() as t:
        assert t.get_record("t", RecordID(1, 0)) == (True, 1, "abcde", pytest.approx(1.2))
        assert t.schema("t") == ALL
    assert again.delete_table("t") and not again.delete_table("t")
    assert Database(spark, database.root).table_names == []


def test_catalog_errors(database):
    database.create_table(ONE_INT, "t")
    for wrong in (lambda: database.create_table(ONE_INT, "t"), lambda: database.create_table_with_indices(ONE_INT, "u", ["nope"]), lambda: database.create_table_with_indices(ONE_INT, "u", ["int", "int"]), lambda: database.create_table(ONE_INT, "a.b")):
        with pytest.raises(DatabaseError):
            wrong()
    assert database.delete_all_tables() and database.table_names == []


def test_temporary_tables_and_aliases(database):
    database.create_table(ONE_INT, "t")
    t = database.begin_transaction()
    t.create_temp_table(ONE_INT, "temp")
    t.add_record("temp", [1])
    t.query_as("temp", "a")
    t.query_as("a", "b")
    assert t.scan("b").count() == 1
    for name in ("t", "temp", "a"):
        with pytest.raises(DatabaseError):
            t.query_as("t", name)
    with pytest.raises(DatabaseError):
        t.create_temp_table(ONE_INT, "a")
    t.end()
    assert not t.is_active
    with pytest.raises(DatabaseError):
        t.scan("temp")
    with database.begin_transaction() as u, pytest.raises(DatabaseError):
        u.scan("temp")


def test_one_transaction_at_a_time(database):
    database.create_table(ONE_INT, "t")
    first, second, order = database.begin_transaction(), database.begin_transaction(), []
    first.schema("t")
    waiting = threading.Thread(target=lambda: (second.schema("t"), order.append("second")))
    waiting.start()
    waiting.join(0.3)
    order.append("first")
    first.end()
    waiting.join(5)
    assert order == ["first", "second"]
    second.end()


def test_index_scans(database):
    fill(database, "t", [valued(v) for v in (3, 5, 2, 1, 6) * 3], indices=["int"])
    with database.begin_transaction() as t:
        t.query_as("t", "a")
        assert t.index_exists("t", "int") and t.index_exists("a", "a.int") and not t.index_exists("t", "float")
        assert [r["int"] for r in t.sorted_scan("t", "int").collect()] == sorted([3, 5, 2, 1, 6] * 3)
        assert [r["int"] for r in t.sorted_scan_from("t", "int", 5).collect()] == [5] * 3 + [6] * 3
        assert [r["int"] for r in t.index_scan("t", "int", "<", 3).collect()] == [1] * 3 + [2] * 3
        assert t.lookup_key("t", "int", 3).count() == 3 and t.lookup_key("t", "int", 10).count() == 0
        assert t.contains("t", "int", 6) and not t.contains("t", "int", 7)
        for wrong in (lambda: t.contains("t", "float", 1.0), lambda: t.index_scan("t", "int", "!=", 3), lambda: t.num_index_pages("t", "float")):
            with pytest.raises(DatabaseError):
                wrong()


def test_load_refuses_nulls_and_types(database, spark):
    database.create_table(Schema(["k", "s"], [INT, STRING(3)]), "t")
    with database.begin_transaction() as t:
        assert t.load("t", spark.createDataFrame([(2, "abcd"), (1, "x")], "k int, s string"), ["k"]) == 2
        assert [tuple(r) for r in t.records("t")] == [(1, "x  "), (2, "abc")]
        assert t.load("t", spark.createDataFrame([], "k int, s string"), ["k"]) == 0
        with pytest.raises(DatabaseError):
            t.load("t", spark.createDataFrame([(1, 1)], "k int, s int"), ["k"])
        with pytest.raises(Exception, match="null in column"):
            t.load("t", spark.createDataFrame([(1, None)], "k int, s string"), ["k"])


def test_external_tables_are_read_only(spark):
    database = Database(spark)
    database.attach("x", spark.range(5).withColumnRenamed("id", "k"), key=["k"])
    with database.begin_transaction() as t:
        assert t.num_records("x") == 5
        with pytest.raises(DatabaseError):
            t.add_record("x", [7])
        with pytest.raises(DatabaseError):
            t.scan("y")
    with pytest.raises(DatabaseError):
        database.create_table(ONE_INT, "t")


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"1, Ann ,true, 3.5\r\n2,Bob,false,2.25\r\n")
    rows = read_csv(spark, f"file://{tmp_path}/s.csv", Schema(["k", "n", "b", "g"], [INT, STRING(5), BOOL, FLOAT])).collect()
    assert [tuple(r) for r in rows] == [(1, "Ann  ", True, 3.5), (2, "Bob  ", False, 2.25)]


def test_numbering_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr("tessera.functions.numbering.RANGE_ROWS", 50)
    from tessera.functions.numbering import number_rows

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    assert [(r["k"], r["n"]) for r in number_rows(df, ["k"], "n", start=3).orderBy("k").collect()] == [(i, i + 3) for i in range(1000)]


def test_stream(database, spark, tmp_path):
    from tessera.streaming.ingest import load_stream

    database.create_table(Schema(["k"], [INT]), "t")
    spark.createDataFrame([(3,), (1,)], "k int").write.parquet(f"file://{tmp_path}/in")
    for more in ([], [(2,)]):
        if more:
            spark.createDataFrame(more, "k int").write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("k int").parquet(f"file://{tmp_path}/in")
        load_stream(database, "t", stream, ["k"], f"file://{tmp_path}/check").awaitTermination(60)
    with database.begin_transaction() as t:
        assert [r["k"] for r in t.records("t")] == [1, 3, 2]


def test_an_update_rewrites_one_range(database, spark, monkeypatch):
    monkeypatch.setattr("tessera.sources.table.SEGMENT_BYTES", 400)
    database.create_table(ONE_INT, "t")
    with database.begin_transaction() as t:
        assert t.load("t", spark.range(10_000).select(F.col("id").cast("int").alias("int")), ["int"]) == 10_000
        table = database._tables["t"]
        before = {s["path"]: s for s in table.segments}
        assert len(before) == 100 and all(s["records"] == 100 for s in before.values())
        where = t.schema("t").record_id(5050)
        assert t.update_record("t", [-1], where) == (5050,) and t.get_record("t", where) == (-1,)
        new = [s for s in table.segments if s["path"] not in before]
        assert len(new) == 1 and len(table.segments) == 100 and (new[0]["first"], new[0]["last"]) == (5000, 5099)
        assert new[0]["bytes"] < 2 * max(s["bytes"] for s in before.values())
        assert t.delete_record("t", t.schema("t").record_id(9999)) == (9999,)
        assert t.delete_record("t", t.schema("t").record_id(0)) == (0,) and t.num_records("t") == 9998
        assert [t.schema("t").rid(p) for p in t.add_records("t", [[7], [8], [9]])] == [0, 9999, 10_000]
        assert t.get_record("t", t.schema("t").record_id(0)) == (7,)


def test_whole_pages_of_free_slots(database, spark):
    database.create_table(ONE_INT, "t")
    with database.begin_transaction() as t:
        t.load("t", spark.range(5000).select(F.col("id").cast("int").alias("int")), ["int"])
        table = database._tables["t"]
        table._become(table._write_ranges(table.numbered().filter("_rid < 10 or _rid >= 4090")))
        assert table.free_rids(4085) == [*range(10, 4090), *range(5000, 5005)]


def test_numbering_divides_equal_keys_and_keeps_nulls(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGE_ROWS", 50)
    rows = [(None if i % 7 == 0 else 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    bounds = numbering.range_bounds(df, ["a", "b"], 1000)
    assert len(bounds) > 10
    got = sorted((r["n"], r["a"], r["b"]) for r in numbering.number_rows(df, ["a", "b"], "n").collect())
    assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (r[0] is not None, r[1])) and [g[0] for g in got] == list(range(1000))
    sizes = numbering.number_rows(df, ["a", "b"], "n").select(numbering._range_of(df, ["a", "b"], bounds).alias("p")).groupBy("p").count().collect()
    assert len(sizes) == len(bounds) + 1 and max(r["count"] for r in sizes) < 200


def test_work_folders_of_a_cluster_are_shared(spark, monkeypatch, tmp_path):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *_: f"file:{tmp_path}/warehouse" if key == "spark.sql.warehouse.dir" else None), sparkContext=spark.sparkContext)
    assert workspace.shared_root(unset).startswith("file://")
    monkeypatch.setattr(workspace, "_is_local", lambda spark: False)
    with pytest.raises(DatabaseError):
        workspace.shared_root(unset)
    monkeypatch.undo()
    path = workspace.work_folder(spark, "x")
    assert path.endswith("/x") and spark.sparkContext.applicationId in path
