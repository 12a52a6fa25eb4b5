"""Databases and transactions."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import DatabaseError
from .functions.histograms import IntHistogram, doubled_range, scaled
from .functions.stats import TableStats
from .operators.predicates import PredicateOperator
from .plans.cost import index_pages
from .query import QueryPlan
from .schema import RID, RecordID, Schema
from .sources.files import Files
from .sources.table import ExternalTable, StoredTable

CATALOG = "catalog.json"


class Database:
    """Tables below one folder, which may lie in any store that Spark reaches.

    Opening the same folder again finds the tables as they were.  Without a
    folder only external tables can be used.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, num_memory_pages: int = 5):
        self.spark, self.root, self.num_memory_pages = spark, root.rstrip("/") if root else None, num_memory_pages
        self._files, self._free, self._holder = Files(spark), threading.Condition(), None
        self._tables: dict[str, StoredTable | ExternalTable] = {}
        if self.root and self._files.exists(f"{self.root}/{CATALOG}"):
            for name, state in json.loads(self._files.read(f"{self.root}/{CATALOG}")).items():
                self._tables[name] = StoredTable.from_json(spark, self.root, name, state)

    # Catalog

    def _save(self) -> None:
        state = {n: t.to_json() for n, t in self._tables.items() if t.stored}
        self._files.replace(f"{self.root}/{CATALOG}", json.dumps(state))
        for table in self._tables.values():
            if table.stored:
                table.discard_old()

    def create_table(self, schema: Schema, name: str) -> None:
        self.create_table_with_indices(schema, name, [])

    def create_table_with_indices(self, schema: Schema, name: str, columns: Sequence[str]) -> None:
        """An index is a promise about lookups, not a structure: Parquet statistics
        skip row groups, and the cost model counts its pages."""
        if not self.root:
            raise DatabaseError("this database has no folder for tables")
        if name in self._tables:
            raise DatabaseError(f"table {name} exists already")
        if not name or any(c in name for c in "./ "):
            raise DatabaseError(f"{name!r} is no name for a table")
        if len(set(columns)) != len(columns) or any(c not in schema.names for c in columns):
            raise DatabaseError("indices need columns of the table that differ from each other")
        self._tables[name] = StoredTable(self.spark, self.root, name, schema, columns)
        self._save()

    def delete_table(self, name: str) -> bool:
        table = self._tables.pop(name, None)
        if table is None:
            return False
        if table.stored:
            self._save()
            table.drop()
        return True

    def delete_all_tables(self) -> bool:
        return all([self.delete_table(n) for n in list(self._tables)])

    def attach_parquet(self, name: str, path: str, key: Sequence[str] = (), sizes: dict[str, int] | None = None, indices: Sequence[str] = ()) -> None:
        """Make a Parquet table known, for reading only."""
        self.attach(name, self.spark.read.parquet(path), path, key, sizes, indices)

    def attach(self, name: str, frame: DataFrame, path: str | None = None, key: Sequence[str] = (), sizes: dict[str, int] | None = None, indices: Sequence[str] = ()) -> None:
        if name in self._tables:
            raise DatabaseError(f"table {name} exists already")
        table = ExternalTable(frame, name, path, key, sizes)
        for c in indices:
            table.schema.index(c)
        table.indices = list(indices)
        self._tables[name] = table

    @property
    def table_names(self) -> list[str]:
        return sorted(self._tables)

    def begin_transaction(self) -> Transaction:
        return Transaction(self)

    def close(self) -> None:
        """All writes are saved when they return; nothing is left to do but to forget the tables."""
        self._tables = {}


class Transaction:
    """The only handle to read, write and query.

    Its first operation waits until no other transaction holds the database and
    then keeps it until ``end``.  Writes last; there is no way back.
    """

    def __init__(self, database: Database):
        self._db, self._active = database, True
        self._aliases: dict[str, str] = {}
        self._temps: dict[str, StoredTable] = {}
        self._folder = f"_temp_{uuid.uuid4().hex}"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        if self._active:
            self.end()

    @property
    def is_active(self) -> bool:
        return self._active

    @property
    def num_memory_pages(self) -> int:
        return self._db.num_memory_pages

    def end(self) -> None:
        self._check()
        for name in list(self._temps):
            self.delete_temp_table(name)
        if self._db.root and self._db._files.exists(f"{self._db.root}/{self._folder}"):
            self._db._files.delete(f"{self._db.root}/{self._folder}")
        self._active = False
        with self._db._free:
            if self._db._holder is self:
                self._db._holder = None
                self._db._free.notify_all()

    def _check(self) -> None:
        if not self._active:
            raise DatabaseError("the transaction has ended")

    def _enter(self) -> None:
        self._check()
        with self._db._free:
            while self._db._holder not in (None, self):
                self._db._free.wait()
            self._db._holder = self

    def _resolve_name(self, name: str) -> str:
        while name in self._aliases:
            name = self._aliases[name]
        return name

    def _table(self, name: str):
        self._enter()
        real = self._resolve_name(name)
        table = self._temps.get(real) or self._db._tables.get(real)
        if table is None:
            raise DatabaseError(f"there is no table {name}")
        return table

    def _stored(self, name: str) -> StoredTable:
        table = self._table(name)
        if not table.stored:
            raise DatabaseError(f"table {name} can only be read")
        return table

    def _saved(self, table: StoredTable) -> None:
        if table.name in self._db._tables:
            self._db._save()
        else:
            table.discard_old()

    # Names

    def query_as(self, table: str, alias: str) -> None:
        self._table(table)
        if alias in self._aliases or alias in self._temps or alias in self._db._tables:
            raise DatabaseError(f"the name {alias} is taken")
        self._aliases[alias] = table

    def create_temp_table(self, schema: Schema, name: str) -> None:
        self._enter()
        if name in self._aliases or name in self._temps or name in self._db._tables:
            raise DatabaseError(f"the name {name} is taken")
        if not self._db.root:
            raise DatabaseError("this database has no folder for tables")
        self._temps[name] = StoredTable(self._db.spark, f"{self._db.root}/{self._folder}", name, schema)

    def delete_temp_table(self, name: str) -> None:
        self._check()
        if name not in self._temps:
            raise DatabaseError(f"there is no temporary table {name}")
        self._temps.pop(name).drop()

    # Queries

    def query(self, table: str) -> QueryPlan:
        self._table(table)
        return QueryPlan(self, table)

    def _named(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self._table(name).schema.names])

    def scan(self, table: str) -> DataFrame:
        return self._named(table, self._table(table).rows())

    def _ordered(self, table: str, column: str, condition=None) -> DataFrame:
        known = self._table(table)
        column = self._own_column(table, column)
        df = known.rows() if condition is None else known.rows().filter(condition)
        return self._named(table, df.orderBy(column, *[c for c in known.order if c != column]))

    def _own_column(self, table: str, column: str) -> str:
        """A column by its own name, or qualified by any name of the table."""
        head, dot, tail = column.rpartition(".")
        if dot and self._resolve_name(head) == self._resolve_name(table):
            column = tail
        self._table(table).schema.index(column)
        return column

    def sorted_scan(self, table: str, column: str) -> DataFrame:
        """All rows in key order, equal keys in the order of insertion."""
        return self._ordered(table, column)

    def sorted_scan_from(self, table: str, column: str, start: object) -> DataFrame:
        return self.index_scan(table, column, PredicateOperator.GREATER_THAN_EQUALS, start)

    def index_scan(self, table: str, column: str, op: PredicateOperator | str, value: object) -> DataFrame:
        """Rows that satisfy a comparison, in key order; not for unequal ones."""
        op = PredicateOperator.of(op)
        if op is PredicateOperator.NOT_EQUALS:
            raise DatabaseError("an index cannot look up unequal keys")
        column = self._own_column(table, column)
        schema = self._table(table).schema
        constant = schema.types[schema.index(column)].literal(value)
        return self._ordered(table, column, op.condition(F.col(column), constant))

    def lookup_key(self, table: str, column: str, key: object) -> DataFrame:
        return self.index_scan(table, column, PredicateOperator.EQUALS, key)

    def contains(self, table: str, column: str, key: object) -> bool:
        """Whether an indexed column holds a key."""
        if not self.index_exists(table, column):
            raise DatabaseError(f"column {column} of {table} has no index")
        column = self._own_column(table, column)
        schema = self._table(table).schema
        constant = schema.types[schema.index(column)].literal(key)
        return not self._table(table).rows().filter(F.col(column) == F.lit(constant)).isEmpty()

    def index_exists(self, table: str, column: str) -> bool:
        try:
            return self._own_column(table, column) in self._table(table).indices
        except DatabaseError:
            return False

    # Records

    def add_record(self, table: str, values: Sequence[object]) -> RecordID:
        return self.add_records(table, [values])[0]

    def add_records(self, table: str, rows: Iterable[Sequence[object]]) -> list[RecordID]:
        known = self._stored(table)
        places = known.insert(rows)
        self._saved(known)
        return places

    def load(self, table: str, df: DataFrame, order: Sequence[str]) -> int:
        """Add a whole DataFrame, numbered in ``order``."""
        known = self._stored(table)
        n = known.load(df, order)
        self._saved(known)
        return n

    def update_record(self, table: str, values: Sequence[object], where: RecordID) -> tuple:
        known = self._stored(table)
        old = known.update(where, values)
        self._saved(known)
        return old

    def delete_record(self, table: str, where: RecordID) -> tuple:
        known = self._stored(table)
        old = known.delete(where)
        self._saved(known)
        return old

    def get_record(self, table: str, where: RecordID) -> tuple:
        return self._stored(table).record(where)

    def records(self, table: str) -> Iterator[Row]:
        """All records in page and slot order."""
        known = self._table(table)
        return self._named(table, known.rows().orderBy(*known.order) if known.order else known.rows()).toLocalIterator()

    def record_ids(self, table: str) -> DataFrame:
        """All records with ``page_num`` from 1 and ``entry_num`` from 0."""
        return self._placed(table, self._table(table).numbered())

    def _placed(self, table: str, rows: DataFrame) -> DataFrame:
        schema = self.schema(table)
        n = schema.entries_per_page
        places = [F.expr(f"{RID} div {n} + 1").alias("page_num"), (F.col(RID) % n).cast("int").alias("entry_num")]
        return rows.select(*schema.names, *places)

    def pages(self, table: str) -> DataFrame:
        """Used slots by page."""
        return self.record_ids(table).groupBy("page_num").agg(F.count("*").cast("int").alias("num_entries"), F.sort_array(F.collect_list("entry_num")).alias("entries"))

    # About tables

    def schema(self, table: str) -> Schema:
        return self._table(table).schema

    def fully_qualified_schema(self, table: str) -> Schema:
        schema = self.schema(table)
        return Schema([f"{table}.{n}" for n in schema.names], schema.types)

    def stats(self, table: str, columns: Sequence[str] | None = None) -> TableStats:
        """Statistics with the histograms of the given columns, or of all."""
        return self._table(table).stats(columns)

    def column_summary(self, table: str, column: str) -> DataFrame:
        """One row: records, distinct values, least and greatest value of a column."""
        c = self._own_column(table, column)
        wanted = [F.count(F.lit(1)).alias("num_records"), F.count_distinct(c).alias("num_distinct"), F.min(c).alias("min_value"), F.max(c).alias("max_value")]
        return self._table(table).rows().agg(*wanted)

    def histogram(self, table: str, column: str) -> DataFrame:
        """Rows by bucket of a column's histogram: the number of a range of numbers,
        the first character of strings in lower case, or the value itself."""
        name, known = self._own_column(table, column), self._table(table)
        kind = known.schema.types[known.schema.index(name)]
        if kind.family == "STRING":
            bucket = F.substring(F.lower(name), 1, 1)
        elif kind.numeric:
            value = scaled(F.col(name), kind)
            low, high = known.rows().agg(F.min(value), F.max(value)).first()
            bucket = IntHistogram.bucket(value, doubled_range(low or 0, high or 0))
        else:
            bucket = F.col(name)
        return known.rows().groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))

    def num_records(self, table: str) -> int:
        return self._table(table).num_records()

    def num_data_pages(self, table: str) -> int:
        known = self._table(table)
        return known.schema.pages(known.last_rid() + 1)

    def num_entries_per_page(self, table: str) -> int:
        return self.schema(table).entries_per_page

    def entry_size(self, table: str) -> int:
        return self.schema(table).size

    def page_header_size(self, table: str) -> int:
        return self.schema(table).page_header_size

    def read_page_header(self, table: str, page: int) -> bytes:
        """Bitmap of used slots, the first slot in the highest bit."""
        n, known = self.num_entries_per_page(table), self._table(table)
        own = known.numbered().filter((F.col(RID) >= (page - 1) * n) & (F.col(RID) < page * n))  # reaches the Parquet scan
        used = [r["entry_num"] for r in self._placed(table, own).select("entry_num").collect()]  # at most a page
        header = bytearray(self.page_header_size(table))
        for slot in used:
            header[slot // 8] |= 0x80 >> slot % 8
        return bytes(header)

    def num_index_pages(self, table: str, column: str) -> int:
        if not self.index_exists(table, column):
            raise DatabaseError(f"column {column} of {table} has no index")
        schema = self.schema(table)
        return index_pages(self.num_records(table), schema.types[schema.index(self._own_column(table, column))])
