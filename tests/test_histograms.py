import numpy as np
import pytest

from tessera.functions.histograms import ALPHANUMERIC, BoolHistogram, FloatHistogram, IntHistogram, StringHistogram, doubled_range
from tessera.functions.stats import measure
from tessera.operators.predicates import PredicateOperator as Op
from tessera.sources.memory import rows_frame
from tessera import BOOL, FLOAT, INT, STRING, Schema


def ints(values, kind=IntHistogram, scale=1):
    values = [int(np.float32(v) * np.float32(scale)) if scale > 1 else v for v in values]
    half = doubled_range(min(values), max(values))
    counts = [0] * 10
    for v in values:
        counts[(v + half) // (2 * half // 10)] += 1
    return kind(tuple(counts), len(set(values)), half)


def test_ranges():
    h = ints(range(40))
    assert h.entries_in_range(15, 25) == 10
    assert h.entries_in_range(25, 30) == 5


def test_growth():
    h = ints([*range(10), 99])
    assert h.half == 100 and h.counts[5] == 10 and h.counts[9] == 1
    assert doubled_range(-51, 0) == 100 and doubled_range(0, 50) == 100 and doubled_range(-50, 49) == 50
    assert doubled_range(0, 1 << 33) > 1 << 33


def test_int_reduction_factors():
    h = ints([*range(50), *range(50)])
    for op, v, want in [(Op.EQUALS, 0, 0.02), (Op.LESS_THAN, 25, 0.5), (Op.LESS_THAN_EQUALS, 25, 0.52), (Op.GREATER_THAN, 9, 0.82), (Op.GREATER_THAN_EQUALS, 10, 0.82), (Op.NOT_EQUALS, 3, 0.0)]:
        assert h.reduction_factor(op, v) == pytest.approx(want, abs=1e-6)


def test_float_range_is_approximate():
    assert ints([float(i) for i in range(40)], FloatHistogram, 10_000).entries_in_range(0.0, 10.0) == 11


def test_bool_reduction():
    h = BoolHistogram((70, 30), 2)
    assert h.reduction_factor(Op.EQUALS, True) == pytest.approx(0.7)
    assert h.reduction_factor(Op.NOT_EQUALS, True) == pytest.approx(0.3)
    assert h.filtered(Op.EQUALS, False).counts == (0, 30)
    assert h.entries_in_range(False, True) == 100


def test_string_reduction():
    counts = [1] * 24 + [0] * 13
    h = StringHistogram(tuple(counts), 24)
    assert h.reduction_factor(Op.LESS_THAN, "p") == pytest.approx(0.625)
    assert h.reduction_factor(Op.GREATER_THAN, "f") == pytest.approx(0.75)
    assert h.reduction_factor(Op.EQUALS, "a") == 1.0
    assert h.entries_in_range("A", "c") == 3


def test_filtered_counts():
    h = ints(list(range(50)))
    assert h.filtered(Op.LESS_THAN, 15).counts[5:] == (10, 5, 0, 0, 0)
    assert h.filtered(Op.GREATER_THAN_EQUALS, 40).counts[5:] == (0, 0, 0, 0, 10)
    assert h.reduced(0.5).counts[5:] == (5,) * 5


def test_measure(spark):
    schema = Schema(["i", "b", "s", "f"], [INT, BOOL, STRING(5), FLOAT])
    rows = [(i, i < 50, "cabin" if i else "-", i / 100) for i in range(100)]
    stats = measure(rows_frame(spark, rows, schema), schema)
    assert stats.num_records == 100 and stats.num_pages == 1
    i, b, s, f = stats.histograms
    assert i.counts[5:] == (20,) * 5 and i.distinct == 100 and i.half == 100
    assert b.counts == (50, 50)
    assert s.counts[ALPHANUMERIC.index("c")] == 99 and s.counts[-1] == 1
    assert sum(f.counts) == 100
    assert measure(rows_frame(spark, [], schema), schema).num_records == 0


def test_join_estimate(spark):
    schema = Schema(["i"], [INT])
    stats = measure(rows_frame(spark, [(i,) for i in range(100)], schema), schema)
    assert stats.with_join(0, stats, 0).num_records == 100
    assert stats.with_predicate(0, Op.EQUALS, 3).num_records == 1
