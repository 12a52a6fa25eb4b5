"""Distributed connected components by alternating large-star and small-star.

Every step is a grouped minimum (combined before its shuffle) and an equi-join
back to the edges, so a vertex with very many edges is split by adaptive
skew-join handling and never gathered into one task.  The edge table is written
to the shared folder after each round; only two counts of it reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
    joined = both.join(least, both.src == least.u).filter("dst > src")
    return joined.select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
    moved = edges.join(least, edges.src == least.u).filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Map vertices of an undirected edge table to the least vertex they reach.

    Returns ``node, component`` for every vertex that has an edge and is not
    itself the least of its component; all other vertices are their own
    component.  Edges with a null end are ignored; repeated edges and loops are
    harmless; an empty edge table gives an empty result.  ``rows`` may bound the
    number of edges.
    """
    edges = edges.select(F.col(left).cast("long").alias("src"), F.col(right).cast("long").alias("dst")).filter("src is not null and dst is not null")
    current = materialize(_oriented(edges), "edges", rows)
    size, stars = _shape(current)
    for _ in range(max_rounds):
        if stars:
            break
        large = _oriented(_large_star(current))
        after_round = materialize(_oriented(_small_star(large)), "edges", 2 * size)
        release(current)
        current = after_round
        size, stars = _shape(current)
    else:
        raise RuntimeError("connected components did not converge")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """(edges, whether they are stars: each vertex is the centre of a star or has one edge to one).
    All steps keep what is connected, so stars are whole components around their least vertices."""
    out, into = F.lit(1).alias("out"), F.lit(1).alias("into")
    ends = edges.select(F.col("src").alias("v"), out, F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).alias("out"), into))
    vertices = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    row = vertices.agg(F.coalesce(F.sum("out"), F.lit(0)), F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()
    return row[0], row[1] == 0
