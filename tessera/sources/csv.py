"""CSV files without header or quoting, as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Schema


def read_csv(spark: SparkSession, path: str, schema: Schema, separator: str = ",") -> DataFrame:
    """Values are trimmed and parsed; strings of fixed length are cut or padded.

    Lines may end in CR LF.  A value that does not parse fails the read.
    """
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in schema.names])).option("sep", separator).option("quote", "").csv(path)
    columns = []
    for name, kind in zip(schema.names, schema.types):
        value = F.trim(F.regexp_replace(name, r"[\r\n]+$", ""))
        value = F.rpad(value, kind.length, " ") if kind.name == "STRING" else value.cast(kind.spark)
        columns.append(value.alias(name))
    return raw.select(*columns)
