"""COUNT, SUM and AVG with the engine's result types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryPlanError
from ..types import INT_MAX, INT_MIN, ColumnType

#: Names of the result columns.
COUNT_NAME, SUM_NAME, AVERAGE_NAME = "countAgg", "sumAgg", "averageAgg"


def count_all(wide: bool) -> Column:
    """Number of rows: 64 bits, or of tables of 32 bits up to the limit of the type."""
    counted = F.count(F.lit(1))
    return counted if wide else F.least(counted, F.lit(INT_MAX)).cast("int")


def total(column: Column, kind: ColumnType) -> Column:
    """Sum; of whole numbers of 32 bits it stays at the limits of the type."""
    if not kind.numeric:
        raise QueryPlanError(f"Error: a column of type {kind} cannot be summed")
    summed = F.sum(column)
    if kind.family == "FLOAT":
        return summed if kind.wide else summed.cast("float")
    return summed if kind.wide else F.greatest(F.lit(INT_MIN), F.least(F.lit(INT_MAX), summed)).cast("int")


def average(column: Column, kind: ColumnType, double: bool) -> Column:
    """Mean, in single precision unless the table keeps 64 bits."""
    if not kind.numeric:
        raise QueryPlanError(f"Error: a column of type {kind} cannot be averaged")
    mean = F.avg(column)
    return mean if double or kind.wide else mean.cast("float")
