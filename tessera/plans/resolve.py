"""Names of columns: ``table.column``, or a column alone where only one table has it."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryPlanError
from ..types import ColumnType


@dataclass(frozen=True)
class ScopeColumn:
    """A column of a scan: the table name it is known by, its own name, and its unique name in the plan."""

    table: str
    name: str
    type: ColumnType
    physical: str

    @property
    def qualified(self) -> str:
        return f"{self.table}.{self.name}"


def resolve(reference: str, scope: list[ScopeColumn]) -> ScopeColumn:
    """The one column that a reference means; none and several are errors."""
    if "." in reference:
        found = [c for c in scope if c.qualified == reference]
    else:
        found = [c for c in scope if c.name == reference]
    if not found:
        raise QueryPlanError(f"Error: {reference} names no column of this query")
    if len(found) > 1:
        raise QueryPlanError(f"Error: {reference} names a column of {' and of '.join(c.table for c in found)}; write it with its table")
    return found[0]


def scan_scope(table: str, schema, number: int) -> list[ScopeColumn]:
    return [ScopeColumn(table, n, t, f"s{number}_{i}_{n}") for i, (n, t) in enumerate(zip(schema.names, schema.types))]
