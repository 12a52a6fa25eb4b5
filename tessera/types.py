"""Column types: four declared ones, and four more for tables that exist already as Parquet."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from .errors import QueryPlanError, SchemaError

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class ColumnType:
    """A type: its name, its width in bytes and, for fixed-length strings, its length."""

    name: str
    size: int
    length: int | None = None

    @property
    def spark(self) -> T.DataType:
        return {
            "BOOL": T.BooleanType(), "INT": T.IntegerType(), "FLOAT": T.FloatType(), "STRING": T.StringType(),
            "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(), "VARCHAR": T.StringType(),
        }[self.name]

    @property
    def family(self) -> str:
        """Types of one family compare with each other."""
        return {"LONG": "INT", "DOUBLE": "FLOAT", "VARCHAR": "STRING"}.get(self.name, self.name)

    @property
    def numeric(self) -> bool:
        return self.family in ("INT", "FLOAT")

    @property
    def wide(self) -> bool:
        """Whether sums and averages keep 64 bits."""
        return self.name in ("LONG", "DOUBLE")

    def accepts(self, value: object) -> bool:
        if self.family == "BOOL":
            return isinstance(value, bool)
        if self.family == "INT":
            low, high = (INT_MIN, INT_MAX) if self.name == "INT" else (LONG_MIN, LONG_MAX)
            return isinstance(value, (int, np.integer)) and not isinstance(value, bool) and low <= value <= high
        if self.family == "FLOAT":
            return isinstance(value, (float, np.floating))
        if self.family == "STRING":
            return isinstance(value, str)
        return isinstance(value, dt.datetime)

    def stored(self, value: object) -> object:
        """The value as a record holds it: strings of fixed length are cut or padded."""
        if not self.accepts(value):
            raise SchemaError(f"{value!r} is not of type {self}")
        if self.name == "STRING":
            return value[: self.length].ljust(self.length)
        if self.name == "FLOAT":
            return float(np.float32(value))
        return value

    def literal(self, value: object) -> object:
        """The constant of a comparison; nothing is cast between families."""
        if not self.accepts(value):
            raise QueryPlanError(f"Error: a column of type {self} cannot be compared with {value!r}")
        return self.stored(value)

    def text(self, value: object) -> str:
        """The value as a plan shows it."""
        if isinstance(value, bool):
            return "true" if value else "false"
        return str(np.float32(value)) if self.name == "FLOAT" else str(value)

    def __str__(self) -> str:
        return f"STRING({self.length})" if self.name == "STRING" else self.name


BOOL, INT, FLOAT = ColumnType("BOOL", 1), ColumnType("INT", 4), ColumnType("FLOAT", 4)
LONG, DOUBLE, TIMESTAMP = ColumnType("LONG", 8), ColumnType("DOUBLE", 8), ColumnType("TIMESTAMP", 8)


def STRING(length: int) -> ColumnType:  # noqa: N802
    if length < 1:
        raise SchemaError("a string has a length of at least 1")
    return ColumnType("STRING", length, length)


def VARCHAR(size: int = 16) -> ColumnType:  # noqa: N802
    """A string of any length; ``size`` is assumed for page arithmetic only."""
    return ColumnType("VARCHAR", size)


def of_spark(kind: T.DataType, size: int | None = None) -> ColumnType:
    found = {"boolean": BOOL, "int": INT, "float": FLOAT, "bigint": LONG, "double": DOUBLE, "timestamp": TIMESTAMP, "timestamp_ntz": TIMESTAMP}.get(kind.simpleString())
    if found is None and isinstance(kind, T.StringType):
        found = VARCHAR(size or 16)
    if found is None:
        raise SchemaError(f"columns of type {kind.simpleString()} are not supported")
    return found
