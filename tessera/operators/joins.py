"""Equi-joins.  Five algorithms can be asked for; they return the same bag of rows.

A request is passed to Spark as a hint only if the sizes allow it on a cluster;
otherwise Spark chooses, with the same result.
"""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JoinAlgorithm(enum.Enum):
    SNLJ = "simple nested loop"
    PNLJ = "page nested loop"
    BNLJ = "block nested loop"
    GHJ = "grace hash"
    SMJ = "sort merge"


#: Bytes in memory that a byte of a Parquet file is taken for.
DECODED = 10
#: A nested loop compares all pairs: it is taken up to so many bytes times bytes of files.
NESTED_LOOP_LIMIT = 1 << 36
#: A side is broadcast, or built into a hash table, up to so many bytes in memory.  The
#: whole side counts, so that a task can hold it even if one key has all its rows.
BROADCAST_LIMIT, BUILD_LIMIT = 64 << 20, 256 << 20


def equi_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, algorithm: JoinAlgorithm | None, left_bytes: int | None, right_bytes: int | None, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Inner join; columns of both sides have different names.  Unknown sizes are None and count as large."""
    big = 1 << 62
    a, b = big if left_bytes is None else left_bytes, big if right_bytes is None else right_bytes
    condition = F.col(left_column) == F.col(right_column)
    for x, y in extra:
        condition &= F.col(x) == F.col(y)
    if algorithm in (JoinAlgorithm.SNLJ, JoinAlgorithm.PNLJ) and a * b <= NESTED_LOOP_LIMIT:
        right = right.hint("shuffle_replicate_nl")
    elif algorithm is JoinAlgorithm.BNLJ and b * DECODED <= BROADCAST_LIMIT:
        right = right.hint("broadcast")
    elif algorithm is JoinAlgorithm.GHJ and a * DECODED <= BUILD_LIMIT:
        left = left.hint("shuffle_hash")
    elif algorithm is JoinAlgorithm.SMJ:
        right = right.hint("merge")
    return left.join(right, condition)
