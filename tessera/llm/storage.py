"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``.  A lost
executor then costs a re-read of shared files and no recomputation.  Tables that
are not released earlier go when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import Files
from tessera.sources.workspace import work_folder

__all__ = ["materialize", "release", "remove", "work_folder"]


#: Rows of a file, for tables of a few columns whose size is known.
FILE_ROWS = 50_000


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    ``rows`` is a bound of the rows of a table of two or three numbers where one is
    known: then it is written in as few files as fit, and not in one for each
    shuffle partition.  Wider tables, and those made from wide ones, have no bound
    given, so that no task reads more than its share.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))))
    path = work_folder(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`materialize`, once nothing reads them."""
    path = getattr(df, "_tessera_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    Files(spark).delete(path)
