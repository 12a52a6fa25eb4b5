"""Statistics of tables: measured by Spark, carried through plans by arithmetic."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import PredicateOperator as Op
from ..schema import Schema
from ..types import ColumnType
from .histograms import ALPHANUMERIC, F32, INT_BUCKETS, INT_RANGE, BoolHistogram, Histogram, IntHistogram, StringHistogram, doubled_range, empty_histogram, scaled


@dataclass(frozen=True)
class TableStats:
    """Record count and one histogram a column; the schema gives names and page sizes."""

    schema: Schema
    histograms: tuple[Histogram, ...]
    num_records: int

    @property
    def num_pages(self) -> int:
        return self.schema.pages(self.num_records)

    def reduction_factor(self, column: int, op: Op, value: object) -> float:
        return self.histograms[column].reduction_factor(op, value)

    def with_predicate(self, column: int, op: Op, value: object) -> TableStats:
        factor = self.reduction_factor(column, op, value)
        changed = tuple(h.filtered(op, value) if i == column else h.reduced(factor) for i, h in enumerate(self.histograms))
        return replace(self, histograms=changed, num_records=int(F32(self.num_records) * F32(factor)))

    def with_join(self, column: int, other: TableStats, other_column: int) -> TableStats:
        """Estimate for an equi-join: rows are the product over the larger number of distinct values."""
        rows = self.num_records * other.num_records
        distinct = max(self.histograms[column].distinct, other.histograms[other_column].distinct, 1)
        factor = F32(1) / F32(distinct)
        left = F32(rows) / F32(self.num_records) * factor if self.num_records else F32(0)
        right = F32(rows) / F32(other.num_records) * factor if other.num_records else F32(0)
        key = self.histograms[column].reduced(left)
        joined = [key if i == column else h.reduced(left) for i, h in enumerate(self.histograms)]
        joined += [key if i == other_column else h.reduced(right) for i, h in enumerate(other.histograms)]
        names = [f"{i}.{n}" for i, n in enumerate((*self.schema.names, *other.schema.names))]
        return TableStats(Schema(names, [*self.schema.types, *other.schema.types]), tuple(joined), int(F32(rows) * factor))


@dataclass
class Measured:
    """What is known of a table's present rows: histograms, and for some columns only the distinct values."""

    histograms: dict[str, Histogram] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)
    records: int | None = None


def measure(df: DataFrame, schema: Schema, known: Measured | None = None, columns: Iterable[str] | None = None, keys: Iterable[str] = (), exact: bool = True) -> TableStats:
    """Statistics of a table, read from the given columns only (all if None).

    ``columns`` get histograms, ``keys`` only the number of distinct values.  One
    aggregation finds records, distinct values, the buckets of strings and
    truth values and the ranges of numbers; a second one, if there are numbers,
    their buckets.  ``known`` keeps what is measured; the rest stays empty.
    ``exact`` False estimates distinct values, which only steer plan choice.
    """
    known = Measured() if known is None else known
    full = [c for c in (schema.names if columns is None else dict.fromkeys(columns)) if c not in known.histograms]
    counted = [c for c in dict.fromkeys([*full, *keys]) if c not in known.distinct and c not in known.histograms]
    kinds = {c: schema.types[schema.index(c)] for c in [*full, *counted]}
    if known.records is None or full or counted:
        wanted = {"n": F.count(F.lit(1))}
        for c in counted:
            value = F.lower(c) if kinds[c].family == "STRING" else F.col(c)
            wanted[f"d_{c}"] = F.count_distinct(value) if exact else F.approx_count_distinct(value, 0.01)
        for c in full:
            if kinds[c].numeric:
                wanted |= {f"l_{c}": F.min(scaled(F.col(c), kinds[c])), f"h_{c}": F.max(scaled(F.col(c), kinds[c]))}
            else:
                wanted |= _bucket_counts(c, kinds[c], None)
        seen = df.agg(*[x.alias(k) for k, x in wanted.items()]).first()
        known.records = seen["n"]
        known.distinct |= {c: seen[f"d_{c}"] for c in counted}
        numbers = [c for c in full if kinds[c].numeric] if seen["n"] else []
        halves = {c: doubled_range(seen[f"l_{c}"], seen[f"h_{c}"]) for c in numbers}
        second = {k: x for c in numbers for k, x in _bucket_counts(c, kinds[c], halves[c]).items()}
        also = df.agg(*[x.alias(k) for k, x in second.items()]).first() if second else None
        for c in full if seen["n"] else ():
            source = also if c in halves else seen
            counts = tuple(source[k] for k in _bucket_counts(c, kinds[c], halves.get(c))) or empty_histogram(kinds[c]).counts
            histogram = replace(empty_histogram(kinds[c]), counts=counts, distinct=known.distinct[c])
            known.histograms[c] = replace(histogram, half=halves[c]) if c in halves else histogram
    found = [known.histograms.get(c) or replace(empty_histogram(t), distinct=known.distinct.get(c, 0)) for c, t in zip(schema.names, schema.types)]
    return TableStats(schema, tuple(found), known.records)


def _bucket_counts(name: str, kind: ColumnType, half: int | None) -> dict[str, Column]:
    """The count of each bucket of a column; none for types without buckets."""
    bucket, size = _bucket(name, kind, half)
    return {f"b{b}_{name}": F.count_if(bucket == b) for b in range(size)}


def _bucket(name: str, kind: ColumnType, half: int | None) -> tuple[Column | None, int]:
    """The bucket of a column's value, and how many there are."""
    if kind.numeric:
        return IntHistogram.bucket(scaled(F.col(name), kind), half or INT_RANGE), INT_BUCKETS
    if kind.family == "STRING":
        return StringHistogram.bucket(F.col(name)), len(ALPHANUMERIC) + 1
    if kind.family == "BOOL":
        return BoolHistogram.bucket(F.col(name)), 2
    return None, 0

