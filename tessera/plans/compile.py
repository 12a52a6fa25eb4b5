"""From a logical query to one DataFrame.

Each scan renames its columns to names that are unique in the plan, so joins of
a table with itself need no care; the user's names return in the last step.
Everything between is plain DataFrame operations for Catalyst to optimise:
filters reach the Parquet scans, and only columns in use are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryPlanError
from ..operators.aggregates import AVERAGE_NAME, COUNT_NAME, SUM_NAME, average, count_all, total
from ..operators.grouping import GROUP_ID, with_group_ids
from ..operators.joins import JoinAlgorithm, equi_join
from ..schema import RID
from .logical import LogicalQuery
from .resolve import ScopeColumn, resolve, scan_scope


@dataclass
class Scan:
    """A table under the name a query gives it."""

    name: str
    table: object
    scope: list[ScopeColumn]
    number: int

    def frame(self, needs_order: bool, numbered: bool = False) -> DataFrame:
        rows = self.table.numbered() if numbered or needs_order and self.table.stored else self.table.rows()
        columns = [F.col(c.name).alias(c.physical) for c in self.scope]
        if numbered:
            columns.append(F.col(RID).alias(self.rid))
        if needs_order:
            columns += [F.col(c).alias(f"s{self.number}_order{i}") for i, c in enumerate(self.table.order)]
        return rows.select(*columns)

    @property
    def rid(self) -> str:
        return f"s{self.number}_rid"

    @property
    def page(self) -> Column:
        return F.floor(F.col(self.rid) / self.table.schema.entries_per_page)

    @property
    def order(self) -> list[str]:
        return [f"s{self.number}_order{i}" for i in range(len(self.table.order))]


@dataclass
class Resolved:
    """A query with all names resolved: what planners and the compiler work on."""

    query: LogicalQuery
    scans: list[Scan]
    joins: list[tuple[ScopeColumn, ScopeColumn, JoinAlgorithm | None]]  # i joins scan i + 1 to earlier ones
    predicates: list[tuple[ScopeColumn, object, object]]

    @property
    def scope(self) -> list[ScopeColumn]:
        return [c for s in self.scans for c in s.scope]


def resolve_query(query: LogicalQuery, lookup) -> Resolved:
    """``lookup`` gives the table of a name.  Raises QueryPlanError for anything that cannot run."""
    scans: list[Scan] = []
    for number, name in enumerate([query.base, *[j.table for j in query.joins]]):
        table = lookup(name)
        scans.append(Scan(name, table, scan_scope(name, table.schema, number), number))
    joins, scope = [], list(scans[0].scope)
    for join, scan in zip(query.joins, scans[1:]):
        left, right = resolve(join.left_column, scope), resolve(join.right_column, scan.scope)
        if left.type.family != right.type.family:
            raise QueryPlanError(f"Error: {left.qualified} of type {left.type} cannot be joined with {right.qualified} of type {right.type}")
        joins.append((left, right, join.algorithm))
        scope += scan.scope
    predicates = []
    for p in query.predicates:
        column = resolve(p.column, scope)
        predicates.append((column, p.op, column.type.literal(p.value)))
    _validate(query, scope)
    return Resolved(query, scans, joins, predicates)


def _validate(query: LogicalQuery, scope: list[ScopeColumn]) -> None:
    if query.columns is not None:
        if not query.columns and not query.aggregates:
            raise QueryPlanError("Error: no columns to project")
        for c in query.columns:
            resolve(c, scope)
    if query.group_column is not None:
        resolve(query.group_column, scope)
        if query.columns is not None and (len(query.columns) > 2 or (len(query.columns) == 1 and query.columns[0] != query.group_column)):
            raise QueryPlanError("Error: a query with groups can only project the group column")
    for reference in (query.sum_column, query.average_column):
        if reference is not None and not resolve(reference, scope).type.numeric:
            raise QueryPlanError(f"Error: {reference} is not a number")


def joined(resolved: Resolved, order: list[tuple[int, list[tuple[ScopeColumn, ScopeColumn]], JoinAlgorithm | None]] | None, needs_order: bool, numbered: bool = False) -> DataFrame:
    """Scans, filters and joins.  ``order`` lists (scan, conditions, algorithm) as a
    planner chose; without it joins run as declared.  Filters are applied at the scans."""
    frames = []
    for scan in resolved.scans:
        frame = scan.frame(needs_order, numbered)
        for column, op, value in resolved.predicates:
            if column in scan.scope:
                frame = frame.filter(op.condition(F.col(column.physical), value))
        frames.append(frame)
    if order is None:
        order = [(0, [], None), *[(i + 1, [(left, right)], algorithm) for i, (left, right, algorithm) in enumerate(resolved.joins)]]
    first = order[0][0]
    out, sizes = frames[first], resolved.scans[first].table.size_bytes()
    for number, conditions, algorithm in order[1:]:
        (left, right), *extra = conditions
        size = resolved.scans[number].table.size_bytes()
        out = equi_join(out, frames[number], left.physical, right.physical, algorithm, sizes, size, [(a.physical, b.physical) for a, b in extra])
        sizes = None  # what a join returns is not bounded by its inputs
    return out


def _key_hash(column: ScopeColumn) -> Column:
    """Hash of a join key by which a partitioned join would deal it out."""
    value = F.col(column.physical)
    if column.type.family == "INT":
        return F.abs(value.cast("long"))
    if column.type.family == "FLOAT":
        return value.cast("long")
    if column.type.family == "BOOL":
        return value.cast("long")
    folded = F.aggregate(F.split(value, ""), F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def row_order(resolved: Resolved, memory_pages: int) -> list[Column]:
    """Sort keys that give the order in which the last join's algorithm meets pairs."""
    rids = [F.col(s.rid) for s in resolved.scans]
    if not resolved.joins:
        return rids
    left, right = rids[:-1], rids[-1]
    column, _, algorithm = resolved.joins[-1]
    outer, inner = resolved.scans[-2], resolved.scans[-1]
    if algorithm is JoinAlgorithm.PNLJ:
        return [outer.page, inner.page, *left, right]
    if algorithm is JoinAlgorithm.BNLJ:
        return [F.floor(outer.page / (memory_pages - 2)), inner.page, *left, right]
    if algorithm is JoinAlgorithm.GHJ:
        return [F.pmod(_key_hash(column), F.lit(memory_pages - 1)), right, *left]
    if algorithm is JoinAlgorithm.SMJ:
        return [F.col(column.physical), *left, right]
    return [*left, right]


def compile_query(resolved: Resolved, order: list | None = None, ordered: bool = False, memory_pages: int = 5) -> DataFrame:
    """``ordered`` sorts a result without aggregates as the last join's algorithm would emit it."""
    query, scope = resolved.query, resolved.scope
    projected = None if query.columns is None else [(c, resolve(c, scope)) for c in query.columns]
    group = None if query.group_column is None else resolve(query.group_column, scope)
    firsts = [] if projected is None or not query.aggregates else [(n, c) for n, c in projected if c != group]
    needs_order = bool(firsts) and all(s.table.order for s in resolved.scans)
    if ordered and (query.aggregates or group is not None):
        raise QueryPlanError("Error: groups and aggregates have no order of rows")
    df = joined(resolved, order, needs_order, ordered)
    if ordered:
        df = df.orderBy(*row_order(resolved, memory_pages))

    if query.aggregates:
        place = F.struct(*[c for s in resolved.scans for c in s.order]) if needs_order else None
        # Without an order of insertion the first record is the least one by the projected columns.
        least = F.min(F.struct(*[F.col(c.physical).alias(f"first{i}") for i, (_, c) in enumerate(firsts)])) if firsts else None
        columns = []
        for i, (_, c) in enumerate(firsts):
            first = F.min_by(F.col(c.physical), place) if needs_order else least[f"first{i}"]
            columns.append(first.alias(f"first{i}"))
        external = not all(s.table.stored for s in resolved.scans)
        if query.counted:
            columns.append(count_all(wide=external).alias(COUNT_NAME))
        if query.sum_column is not None:
            c = resolve(query.sum_column, scope)
            columns.append(total(F.col(c.physical), c.type).alias(SUM_NAME))
        if query.average_column is not None:
            c = resolve(query.average_column, scope)
            columns.append(average(F.col(c.physical), c.type, double=external).alias(AVERAGE_NAME))
        if group is None:
            # A global aggregate of no rows has no row.
            df = df.agg(*columns, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")
        else:
            df = df.groupBy(group.physical).agg(*columns)
        names, output, i = [], [], 0
        for n, c in projected or []:
            if c == group:
                output.append(F.col(group.physical))
            else:
                output.append(F.col(f"first{i}"))
                i += 1
            names.append(n)
        wanted = [(query.counted, COUNT_NAME), (query.sum_column is not None, SUM_NAME), (query.average_column is not None, AVERAGE_NAME)]
        aggregates = [n for have, n in wanted if have]
        return df.select(*[c.alias(n) for c, n in zip(output, names)], *aggregates)

    output = [(c.qualified, c) for c in scope] if projected is None else projected
    if group is not None:
        df = with_group_ids(df, group.physical)
        return df.select(GROUP_ID, *[F.col(c.physical).alias(n) for n, c in output])
    return df.select(*[F.col(c.physical).alias(n) for n, c in output])
