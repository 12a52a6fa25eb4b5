"""Schemas of tables and the page arithmetic that follows from record sizes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from . import types as kinds
from .errors import SchemaError
from .types import ColumnType

PAGE_BYTES = 4096
#: Column that numbers the records of a table in page and slot order.
RID = "_rid"


@dataclass(frozen=True, order=True)
class RecordID:
    """Place of a record: page number from 1, slot from 0."""

    page: int
    slot: int


class Schema:
    """Ordered names and types; all columns are required."""

    def __init__(self, names: Sequence[str], types: Sequence[ColumnType]):
        if len(names) != len(types):
            raise SchemaError("a schema needs as many types as names")
        if len(set(names)) != len(names):
            raise SchemaError("column names of a schema differ from each other")
        if RID in names:
            raise SchemaError(f"{RID} is reserved")
        self.names, self.types = tuple(names), tuple(types)

    @property
    def size(self) -> int:
        """Bytes of a record."""
        return sum(t.size for t in self.types)

    @property
    def entries_per_page(self) -> int:
        """Slots of a page: one bit each in the header, a whole number of header bytes."""
        return PAGE_BYTES * 8 // (1 + 8 * self.size) // 8 * 8

    @property
    def page_header_size(self) -> int:
        return self.entries_per_page // 8

    def pages(self, records: int) -> int:
        return -(-records // self.entries_per_page)

    def record_id(self, rid: int) -> RecordID:
        return RecordID(1 + rid // self.entries_per_page, rid % self.entries_per_page)

    def rid(self, where: RecordID) -> int:
        if where.page < 1 or not 0 <= where.slot < self.entries_per_page:
            raise SchemaError(f"{where} is not a place in this table")
        return (where.page - 1) * self.entries_per_page + where.slot

    def index(self, name: str) -> int:
        try:
            return self.names.index(name)
        except ValueError:
            raise SchemaError(f"no column {name}") from None

    def verify(self, values: Sequence[object]) -> tuple:
        """The values as stored, or an error if number or types differ."""
        if len(values) != len(self.types):
            raise SchemaError(f"{len(values)} values for {len(self.types)} columns")
        return tuple(t.stored(v) for t, v in zip(self.types, values))

    def spark(self, rid: bool = False) -> T.StructType:
        fields = [T.StructField(n, t.spark, False) for n, t in zip(self.names, self.types)]
        return T.StructType([T.StructField(RID, T.LongType(), False), *fields] if rid else fields)

    def to_json(self) -> list:
        return [[n, t.name, t.size, t.length] for n, t in zip(self.names, self.types)]

    @classmethod
    def from_json(cls, columns: list) -> Schema:
        return cls([c[0] for c in columns], [ColumnType(*c[1:]) for c in columns])

    @classmethod
    def of_spark(cls, fields: T.StructType, sizes: dict[str, int] | None = None) -> Schema:
        """Schema of a table that exists already; ``sizes`` gives assumed string sizes."""
        return cls(fields.names, [kinds.of_spark(f.dataType, (sizes or {}).get(f.name)) for f in fields])

    def __eq__(self, other: object) -> bool:
        """Types are compared, names are not."""
        return isinstance(other, Schema) and self.types == other.types

    __hash__ = None

    def __repr__(self) -> str:
        return "Schema(" + ", ".join(f"{n} {t}" for n, t in zip(self.names, self.types)) + ")"
