"""Tables of records.

A stored table is a list of immutable Parquet folders (segments).  A load writes
one segment for each range of record numbers, inserts add small ones, and an
update or delete rewrites only the segment that holds the record, which is
bounded.  Small segments are merged among themselves.  The list is replaced as a
whole in the catalog, so a reader sees one state or the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatabaseError
from ..functions.numbering import number_rows
from ..functions.stats import Measured, TableStats, measure
from ..schema import RID, RecordID, Schema
from .files import Files

#: Bytes of records in the range of one segment: what an update rewrites at most.
SEGMENT_BYTES = 256 << 20
#: With more segments of few records than this, an insert first merges these.
MAX_SEGMENTS = 32
#: Record numbers that are looked through together for free ones.
GAP_BLOCK = 1024
#: Where they only steer the choice of a plan, distinct values of larger tables are estimated.
EXACT_BYTES = 1 << 30


class ExternalTable:
    """A read-only table that exists already, as Parquet or as a DataFrame.

    ``key`` names columns whose order is the order of insertion; record ids
    and first records follow from it.
    """

    stored = False

    def __init__(self, frame: DataFrame, name: str, path: str | None = None, key: Sequence[str] = (), sizes: dict[str, int] | None = None):
        self.name, self.path, self.key = name, path, tuple(key)
        self.schema = Schema.of_spark(frame.select(*[c for c in frame.columns if c != RID]).schema, sizes)
        self.indices: list[str] = []
        self._frame, self._size = frame, None
        self._measured, self._estimated = Measured(), Measured()
        for column in self.key:
            self.schema.index(column)

    def rows(self) -> DataFrame:
        return self._frame

    def numbered(self) -> DataFrame:
        if not self.key:
            raise DatabaseError(f"table {self.name} has no order of insertion")
        return number_rows(self._frame, list(self.key), RID)

    @property
    def order(self) -> list[str]:
        return list(self.key)

    def size_bytes(self) -> int | None:
        if self._size is None and self.path is not None:
            self._size = Files(self._frame.sparkSession).size(self.path)
        return self._size

    def num_records(self) -> int:
        return self._frame.count()

    def last_rid(self) -> int:
        return self.num_records() - 1

    def stats(self, columns: Iterable[str] | None = None, keys: Iterable[str] = (), estimate: bool = False) -> TableStats:
        """Statistics with the histograms of the given columns, or of all, and the distinct values of keys;
        ``estimate`` lets those of a large table be estimated."""
        rough = estimate and (self.size_bytes() or 0) > EXACT_BYTES
        return measure(self._frame, self.schema, self._estimated if rough else self._measured, columns, keys, not rough)


class StoredTable:
    """A table of the warehouse; rows carry their number in the hidden first column."""

    stored = True
    order = [RID]

    def __init__(self, spark: SparkSession, root: str, name: str, schema: Schema, indices: Sequence[str] = (), segments: list[dict] | None = None):
        self.spark, self.root, self.name, self.schema = spark, root, name, schema
        self.indices, self.segments = list(indices), list(segments or [])
        self._measured, self._estimated = Measured(), Measured()
        self._files = Files(spark)
        self._old: list[str] = []

    def to_json(self) -> dict:
        return {"schema": self.schema.to_json(), "indices": self.indices, "segments": self.segments}

    @classmethod
    def from_json(cls, spark: SparkSession, root: str, name: str, state: dict) -> StoredTable:
        return cls(spark, root, name, Schema.from_json(state["schema"]), state["indices"], state["segments"])

    # Reading

    def _read(self, segments: list[dict]) -> DataFrame:
        schema = self.schema.spark(rid=True)
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in segments])

    def numbered(self) -> DataFrame:
        return self._read(self.segments)

    rows = numbered

    def size_bytes(self) -> int:
        return sum(s["bytes"] for s in self.segments)

    def num_records(self) -> int:
        return sum(s["records"] for s in self.segments)

    def last_rid(self) -> int:
        return max((s["last"] for s in self.segments), default=-1)

    def stats(self, columns: Iterable[str] | None = None, keys: Iterable[str] = (), estimate: bool = False) -> TableStats:
        """Statistics with the histograms of the given columns, or of all, and the distinct values of keys;
        ``estimate`` lets those of a large table be estimated."""
        rough = estimate and self.size_bytes() > EXACT_BYTES
        return measure(self.numbered(), self.schema, self._estimated if rough else self._measured, columns, keys, not rough)

    # Writing; each returns with the new list in place, to be saved by the catalog

    @property
    def segment_rows(self) -> int:
        """Record numbers of a range."""
        return max(1, SEGMENT_BYTES // self.schema.size)

    def _write(self, df: DataFrame) -> list[dict]:
        """One segment of all rows."""
        path = f"{self.name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        seen = self.spark.read.schema(self.schema.spark(rid=True)).parquet(f"{self.root}/{path}").agg(F.count("*"), F.min(RID), F.max(RID)).first()
        if not seen[0]:
            self._files.delete(f"{self.root}/{path}")
            return []
        return [{"path": path, "records": seen[0], "first": seen[1], "last": seen[2], "bytes": self._files.size(f"{self.root}/{path}")}]

    def _write_ranges(self, df: DataFrame) -> list[dict]:
        """One segment for each range of record numbers."""
        path = f"{self.name}/{uuid.uuid4().hex}"
        ranged = df.withColumn("_range", F.expr(f"{RID} div {self.segment_rows}"))
        ranged.repartition("_range").sortWithinPartitions("_range", RID).write.partitionBy("_range").parquet(f"{self.root}/{path}")
        if not any(name.startswith("_range=") for name in self._files.names(f"{self.root}/{path}")):
            self._files.delete(f"{self.root}/{path}")
            return []
        seen = self.spark.read.parquet(f"{self.root}/{path}").groupBy("_range").agg(F.count("*"), F.min(RID), F.max(RID)).orderBy("_range").collect()  # a row a segment
        out = []
        for k, records, first, last in seen:
            own = f"{path}/_range={k}"
            out.append({"path": own, "records": records, "first": first, "last": last, "bytes": self._files.size(f"{self.root}/{own}")})
        return out

    def _become(self, segments: list[dict]) -> None:
        kept = {s["path"] for s in segments}
        self._old += [s["path"] for s in self.segments if s["path"] not in kept]
        self.segments, self._measured, self._estimated = segments, Measured(), Measured()

    def discard_old(self) -> None:
        """Delete segments that the saved state no longer names."""
        for path in self._old:
            self._files.delete(f"{self.root}/{path}")
        self._old = []

    def free_rids(self, n: int) -> list[int]:
        """The ``n`` lowest free record numbers: slots of deleted records first."""
        last, records = self.last_rid(), self.num_records()
        holes = min(n, last + 1 - records)
        free: list[int] = []
        if holes:
            used = self.numbered().select(RID)
            block = F.expr(f"{RID} div {GAP_BLOCK}").alias("id")
            counts = used.groupBy(block).agg(F.count("*").alias("n"))
            room = self.spark.range(last // GAP_BLOCK + 1).join(counts, "id", "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(GAP_BLOCK), last + 1 - F.col("id") * GAP_BLOCK))
            blocks = sorted(r["id"] for r in room.orderBy("id").limit(holes).select("id").collect())  # no more than rows to insert
            near = used.filter(F.col(RID).between(blocks[0] * GAP_BLOCK, (blocks[-1] + 1) * GAP_BLOCK)).filter(F.expr(f"{RID} div {GAP_BLOCK}").isin(blocks))
            taken = {r[0] for r in near.collect()}
            free = [i for b in blocks for i in range(b * GAP_BLOCK, min((b + 1) * GAP_BLOCK, last + 1)) if i not in taken][:holes]
        return free + list(range(last + 1, last + 1 + n - len(free)))

    def insert(self, values: Iterable[Sequence[object]]) -> list[RecordID]:
        """Add single records; each takes the lowest free slot."""
        rows = [self.schema.verify(v) for v in values]
        if not rows:
            return []
        rids = self.free_rids(len(rows))
        small = [s for s in self.segments if s["records"] <= self.segment_rows // 8]
        if len(small) >= MAX_SEGMENTS:
            self._become([s for s in self.segments if s not in small] + self._write_ranges(self._read(small)))
        added = self.spark.createDataFrame([(r, *v) for r, v in zip(rids, rows)], self.schema.spark(rid=True))
        self._become(self.segments + self._write(added.coalesce(1)))
        return [self.schema.record_id(r) for r in rids]

    def load(self, df: DataFrame, order: Sequence[str]) -> int:
        """Add all rows of a DataFrame after the last record, in ``order``; returns their number.

        Columns are taken by name; null values and wrong types are refused.
        """
        columns = []
        for name, kind in zip(self.schema.names, self.schema.types):
            if name not in df.columns or df.schema[name].dataType != kind.spark:
                raise DatabaseError(f"column {name} of type {kind} is needed")
            value = F.rpad(F.col(name), kind.length, " ") if kind.name == "STRING" else F.col(name)
            checked = F.coalesce(value, F.raise_error(F.lit(f"null in column {name}")).cast(kind.spark))
            columns.append(checked.alias(name))
        numbered = number_rows(df, list(order), RID, start=self.last_rid() + 1).select(RID, *columns)
        written = self._write_ranges(numbered)
        self._become(self.segments + written)
        return sum(s["records"] for s in written)

    def _found(self, where: RecordID) -> tuple[tuple, dict]:
        """A record, and the segment that holds it."""
        rid = self.schema.rid(where)
        near = [s for s in self.segments if s["first"] <= rid <= s["last"]]
        found = self._read(near).filter(F.col(RID) == rid).select(*self.schema.names, "_metadata.file_path").first() if near else None
        if found is None:
            raise DatabaseError(f"there is no record at {where}")
        *values, file = found
        return tuple(values), next(s for s in near if f"/{s['path']}/" in unquote(file))

    def record(self, where: RecordID) -> tuple:
        return self._found(where)[0]

    def update(self, where: RecordID, values: Sequence[object]) -> tuple:
        """Replace a whole record; returns the old one."""
        new, (old, segment), rid = self.schema.verify(values), self._found(where), self.schema.rid(where)
        held = [segment]
        changed = [F.when(F.col(RID) == rid, F.lit(v).cast(t.spark)).otherwise(F.col(n)).alias(n) for n, t, v in zip(self.schema.names, self.schema.types, new)]
        self._become([s for s in self.segments if s not in held] + self._write(self._read(held).select(RID, *changed)))
        return old

    def delete(self, where: RecordID) -> tuple:
        """Remove a record; returns it.  Its slot is free for the next insert."""
        (old, segment), rid = self._found(where), self.schema.rid(where)
        held = [segment]
        self._become([s for s in self.segments if s not in held] + self._write(self._read(held).filter(F.col(RID) != rid)))
        return old

    def drop(self) -> None:
        self._files.delete(f"{self.root}/{self.name}")

