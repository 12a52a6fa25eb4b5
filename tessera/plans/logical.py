"""The logical form of a query; values never change once made."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.joins import JoinAlgorithm
from ..operators.predicates import PredicateOperator


@dataclass(frozen=True)
class Join:
    table: str
    left_column: str
    right_column: str
    algorithm: JoinAlgorithm | None = None


@dataclass(frozen=True)
class Predicate:
    column: str
    op: PredicateOperator
    value: object


@dataclass(frozen=True)
class LogicalQuery:
    base: str
    joins: tuple[Join, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    columns: tuple[str, ...] | None = None
    group_column: str | None = None
    counted: bool = False
    sum_column: str | None = None
    average_column: str | None = None

    @property
    def aggregates(self) -> bool:
        return self.counted or self.sum_column is not None or self.average_column is not None
