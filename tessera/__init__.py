"""Relational analytics engine on PySpark: declared tables, a query builder compiled
to DataFrames, record-level writes on Parquet, statistics and readable plans."""

from .engine import Database, Transaction
from .errors import DatabaseError, QueryPlanError, SchemaError
from .operators.grouping import MARKER
from .operators.joins import JoinAlgorithm
from .operators.predicates import PredicateOperator
from .query import QueryPlan
from .schema import RecordID, Schema
from .types import BOOL, DOUBLE, FLOAT, INT, LONG, STRING, TIMESTAMP, VARCHAR

__all__ = [
    "BOOL", "DOUBLE", "FLOAT", "INT", "LONG", "MARKER", "STRING", "TIMESTAMP", "VARCHAR", "Database", "DatabaseError", "JoinAlgorithm",
    "PredicateOperator", "QueryPlan", "QueryPlanError", "RecordID", "Schema", "SchemaError", "Transaction",
]
