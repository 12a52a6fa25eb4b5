"""Comparisons of a column with a constant."""

from __future__ import annotations

import enum
from collections.abc import Callable
from operator import eq, ge, gt, le, lt, ne

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryPlanError


class PredicateOperator(enum.Enum):
    EQUALS = "="
    NOT_EQUALS = "!="
    LESS_THAN = "<"
    LESS_THAN_EQUALS = "<="
    GREATER_THAN = ">"
    GREATER_THAN_EQUALS = ">="

    @classmethod
    def of(cls, op: PredicateOperator | str) -> PredicateOperator:
        """The operator itself, its name, or its sign (also ``==`` and ``<>``)."""
        if isinstance(op, cls):
            return op
        known = {m.value: m for m in cls} | {m.name: m for m in cls} | {"==": cls.EQUALS, "<>": cls.NOT_EQUALS}
        if op not in known:
            raise QueryPlanError(f"Error: unknown comparison {op!r}")
        return known[op]

    @property
    def function(self) -> Callable:
        return {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}[self.value]

    def condition(self, column: Column, constant: object) -> Column:
        return self.function(column, F.lit(constant))
