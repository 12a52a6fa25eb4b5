"""Errors raised by the engine; Spark's own errors pass through."""


class DatabaseError(Exception):
    """A catalog, storage or transaction rule is broken."""


class SchemaError(DatabaseError):
    """A record does not fit the schema of its table."""


class QueryPlanError(Exception):
    """A query cannot be resolved or is not valid."""
