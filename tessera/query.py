"""The query builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from .errors import QueryPlanError
from .operators.grouping import iterate_groups
from .operators.joins import JoinAlgorithm
from .operators.predicates import PredicateOperator
from .plans.compile import Resolved, compile_query, resolve_query
from .plans.cost import PlanNode
from .plans.logical import Join, LogicalQuery, Predicate
from .plans.optimize import declared_plan, optimal_plan


class QueryPlan:
    """Builds one query; all methods that describe it return the builder.

    The description can be run any number of times, and extended in between.
    """

    def __init__(self, transaction, base: str):
        self._transaction, self._query = transaction, LogicalQuery(base)
        self._final: PlanNode | None = None
        self._explain: Callable[[], PlanNode] | None = None

    def project(self, columns: Sequence[str]) -> QueryPlan:
        if self._query.columns is not None:
            raise QueryPlanError("Error: a query can have only one projection")
        if not columns:
            raise QueryPlanError("Error: no columns to project")
        return self._with(columns=tuple(columns))

    def select(self, column: str, op: PredicateOperator | str, value: object) -> QueryPlan:
        return self._with(predicates=(*self._query.predicates, Predicate(column, PredicateOperator.of(op), value)))

    def join(self, table: str, left_column: str, right_column: str, algorithm: JoinAlgorithm | None = None) -> QueryPlan:
        """Inner equi-join with a further table; ``algorithm`` asks for a way to run it."""
        return self._with(joins=(*self._query.joins, Join(table, left_column, right_column, algorithm)))

    def group_by(self, column: str) -> QueryPlan:
        return self._with(group_column=column)

    def count(self) -> QueryPlan:
        return self._with(counted=True)

    def sum(self, column: str) -> QueryPlan:
        return self._with(sum_column=column)

    def average(self, column: str) -> QueryPlan:
        return self._with(average_column=column)

    def _with(self, **changes) -> QueryPlan:
        self._query = replace(self._query, **changes)
        return self

    def _resolved(self) -> Resolved:
        return resolve_query(self._query, self._transaction._table)

    def execute(self, ordered: bool = False) -> DataFrame:
        """The result, with joins as declared; Catalyst plans the execution.  ``ordered``
        sorts the rows as the algorithm asked for would emit them."""
        resolved = self._resolved()
        self._final = None
        self._explain = lambda: declared_plan(resolved, self._transaction.num_memory_pages)
        return compile_query(resolved, ordered=ordered, memory_pages=self._transaction.num_memory_pages)

    def execute_optimal(self) -> DataFrame:
        """The same result, joined in the order and by the algorithms that cost least."""
        resolved = self._resolved()
        self._final, order = optimal_plan(resolved, self._transaction.num_memory_pages)
        return compile_query(resolved, order)

    def execute_groups(self) -> Iterator:
        """Rows of a query with groups and without aggregates; between two groups stands MARKER."""
        if self._query.group_column is None or self._query.aggregates:
            raise QueryPlanError("Error: only a query with groups and without aggregates has separated groups")
        return iterate_groups(self.execute())

    @property
    def final_operator(self) -> PlanNode:
        """The estimated plan of the last execution."""
        if self._final is None:
            if self._explain is None:
                raise QueryPlanError("Error: the query was not executed")
            self._final = self._explain()
        return self._final

    def explain_tree(self) -> str:
        return self.final_operator.text()

