"""A folder for work files that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

from ..errors import DatabaseError
from .files import Files

_local: str | None = None
_parts: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; unset on a cluster, a folder of the
    warehouse if that lies in a shared store; unset in local mode, a temporary folder."""
    global _local
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if Files(spark).scheme(warehouse) == "file":
            raise DatabaseError("work tables need a folder that all executors share: set spark.checkpoint.dir")
        return warehouse + "/_tessera_work"
    if _local is None:
        _local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return "file://" + _local


def work_folder(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which goes when the application ends."""
    part = f"{shared_root(spark)}/tessera-{spark.sparkContext.applicationId}"
    if part not in _parts:
        Files(spark).make_for_now(part)
        _parts.add(part)
    return f"{part}/{name}"
