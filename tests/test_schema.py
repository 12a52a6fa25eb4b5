import datetime as dt

import numpy as np
import pytest

from tessera import BOOL, DOUBLE, FLOAT, INT, LONG, STRING, TIMESTAMP, VARCHAR, QueryPlanError, RecordID, Schema, SchemaError

from .fixtures import ALL


@pytest.mark.parametrize("schema, entries", [(ALL, 288), (Schema(["b"], [BOOL]), 3640), (Schema(["s"], [STRING(100)]), 40)])
def test_entries_per_page(schema, entries):
    assert schema.entries_per_page == entries
    assert schema.page_header_size == entries // 8


def test_sizes_and_pages():
    assert ALL.size == 14
    assert [ALL.pages(n) for n in (0, 1, 288, 289)] == [0, 1, 1, 2]
    assert ALL.record_id(288) == RecordID(2, 0)
    assert ALL.rid(RecordID(2, 0)) == 288
    with pytest.raises(SchemaError):
        ALL.rid(RecordID(1, 288))


def test_verify():
    assert ALL.verify((True, 1, "ab", 1.5)) == (True, 1, "ab   ", 1.5)
    assert ALL.verify((True, 1, "abcdefg", 1.5))[2] == "abcde"
    for bad in [(True, 1, "a"), (1, 1, "a", 1.0), (True, "1", "a", 1.0), (True, 1, "a", 1), (True, None, "a", 1.0), (True, 1 << 31, "a", 1.0)]:
        with pytest.raises(SchemaError):
            ALL.verify(bad)


def test_equality_ignores_names():
    assert Schema(["a"], [INT]) == Schema(["b"], [INT])
    assert Schema(["a"], [STRING(3)]) != Schema(["a"], [STRING(4)])
    assert Schema(["a"], [INT]) != Schema(["a"], [FLOAT])


def test_schema_errors():
    for names, types in [(["a", "a"], [INT, INT]), (["a"], [INT, INT]), (["_rid"], [INT])]:
        with pytest.raises(SchemaError):
            Schema(names, types)
    with pytest.raises(SchemaError):
        STRING(0)


def test_literals_are_not_cast():
    assert INT.literal(3) == 3
    assert STRING(5).literal("ab") == "ab   "
    assert VARCHAR().literal("ab") == "ab"
    assert LONG.literal(1 << 40) == 1 << 40
    assert DOUBLE.literal(0.1) == 0.1
    assert FLOAT.literal(0.1) == float(np.float32(0.1))
    assert TIMESTAMP.accepts(dt.datetime(2020, 1, 1))
    for kind, value in [(INT, 1.0), (INT, "1"), (INT, True), (FLOAT, 1), (BOOL, 1), (STRING(3), 1), (TIMESTAMP, 5)]:
        with pytest.raises(QueryPlanError):
            kind.literal(value)


def test_json_round_trip():
    again = Schema.from_json(ALL.to_json())
    assert again == ALL and again.names == ALL.names
