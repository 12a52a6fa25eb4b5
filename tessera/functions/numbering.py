"""Numbering rows of a whole table in an order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one numbered range holds on average, most ranges, and keys sampled to place their bounds.
RANGE_ROWS, MAX_RANGES, SAMPLE_ROWS = 1_000_000, 1024, 20_000


def range_bounds(df: DataFrame, order: list[str], rows: int) -> list[Row]:
    """Keys that cut the table into ranges of about ``RANGE_ROWS`` rows: from a
    bounded sample, as only the balance depends on them and not the result.
    Whole keys are cut, so rows that agree in the first column are divided too."""
    ranges = min(MAX_RANGES, -(-rows // RANGE_ROWS))
    if ranges <= 1:
        return []
    sample = df.select(*order).sample(fraction=min(1.0, SAMPLE_ROWS / rows), seed=17).orderBy(*order).collect()
    chosen = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    return [b for i, b in enumerate(chosen) if not i or b != chosen[i - 1]]


def _range_of(df: DataFrame, order: list[str], bounds: list[Row]) -> Column:
    """Number of bounds at or below a row's key, by binary search; nulls come first as in a sort."""
    key = F.struct(*[F.col(c).alias(c) for c in order])
    limits = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, b)]) for b in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < limits[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the place of each row in ``order``, from ``start``, gapless; null keys come first.

    Rows are numbered within ranges of the key; counts of the ranges give the
    offsets.  ``order`` has to be unique for the numbers to be stable.
    """
    bounds = range_bounds(df, order, df.count())
    if not bounds:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))
    placed = df.withColumn("_part", _range_of(df, order, bounds))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = placed.withColumn("_within", within).join(F.broadcast(offsets), "_part")  # at most MAX_RANGES rows
    return numbered.withColumn(name, (F.col("_before") + F.col("_within") + (start - 1)).cast("long")).drop("_part", "_within", "_before")
