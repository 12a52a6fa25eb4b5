"""Rows given in a program, as a table for tests and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schema import RID, Schema


def rows_frame(spark: SparkSession, rows: Sequence[Sequence[object]], schema: Schema) -> DataFrame:
    """The rows with their numbers, checked against the schema."""
    return spark.createDataFrame([(i, *schema.verify(r)) for i, r in enumerate(rows)], schema.spark(rid=True))
