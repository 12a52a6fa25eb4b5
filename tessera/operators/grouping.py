"""Grouping without aggregates: all rows, clustered by group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.numbering import number_rows


class _Marker:
    def __repr__(self) -> str:
        return "MARKER"


#: Stands between two groups in :func:`iterate_groups`.
MARKER = _Marker()
GROUP_ID = "group_id"


def with_group_ids(df: DataFrame, key: str) -> DataFrame:
    """Add ``group_id``: the rank of the key among the distinct keys, from 1.

    Distinct keys are ranked and joined back, so no group and no table has to
    pass through one task.  Rows with a null key are a group of their own, the first.
    """
    ranks = number_rows(df.select(F.col(key).alias("_key")).distinct(), ["_key"], GROUP_ID, start=1)
    return df.join(ranks, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def iterate_groups(df: DataFrame) -> Iterator[Row | _Marker]:
    """Rows by group with a marker between consecutive groups and none at the end."""
    current = None
    for row in df.orderBy(GROUP_ID).toLocalIterator():
        if current is not None and row[GROUP_ID] != current:
            yield MARKER
        current = row[GROUP_ID]
        yield row
