"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: sources share a word budget by weight; none is taken more than a
maximal number of times, and the excess goes to the others by weight (exact
water-filling over one row per source).

Positions: each source has a weight schedule that is linear in training time.
Its integral, normalised, is the share of the source's words demanded by time t.
The words that precede a document in its source are a share u of the target;
inverting the integral at u gives the time, and the total demand up to that time
gives the position in words at which the document is trained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

#: Parts of a source whose word totals give the offsets of running sums.
BUCKET_DIGITS = 3
#: (weight at the start, weight at the end) of the schedules, dealt to sources in turn.
DEFAULT_SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _dealt(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sources: DataFrame, weights: Sequence[float], ratio: float, max_repeats: int, schedules: Sequence[tuple[float, float]]) -> DataFrame:
    """Add ``target`` and the schedule's tilt to ``skey, source, source_size``; one row per source.

    A source is held at its limit if its limit for each unit of weight is at
    most the level at which all not yet held ones share the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name)
    tilt = [(a - b) / (a + b) if a + b else 0.0 for a, b in schedules]
    ranked = sources.withColumn("rank", rank)
    ranked = ranked.withColumns({"weight": _dealt(weights, F.col("rank")), "tilt": _dealt(tilt, F.col("rank")), "limit": F.lit(float(max_repeats)) * F.col("source_size")})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    held_before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(ratio))
    ranked = ranked.withColumns({"budget": budget, "held_before": held_before, "weight_left": weight_left})
    ranked = ranked.withColumn("held", F.col("limit") / F.col("weight") <= (F.col("budget") - F.col("held_before")) / F.col("weight_left"))
    everything = Window.partitionBy()
    held = F.sum(F.when(F.col("held"), F.col("limit")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("held"), F.col("limit")).otherwise((F.col("budget") - held) / free * F.col("weight"))
    ranked = ranked.withColumn("target", target)
    drift = F.sum(F.col("target") * F.col("tilt")).over(everything)
    demand = F.sum("target").over(everything)
    return ranked.select("skey", "source_size", "target", "tilt", drift.alias("drift"), demand.alias("demand"))


def _time_of(share: Column, tilt: Column) -> Column:
    """Inverse of t + tilt * (t - t * t), the integral of a linear schedule, on [0, 1]."""
    b = tilt + 1
    root = F.sqrt(F.greatest(b * b - tilt * share * 4, F.lit(0.0)))
    return F.when(F.abs(tilt) < 1e-9, share).otherwise((b - root) / F.when(F.abs(tilt) < 1e-9, F.lit(1.0)).otherwise(tilt * 2))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    max_repeats: int = 2,
    schedules: Sequence[tuple[float, float]] = DEFAULT_SCHEDULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Decide how many words of each document the mix takes, and when.

    ``docs`` has ``doc_id, text, source``.  Returns ``doc_id, source, size,
    source_size, target, taken, positions`` and the columns named in ``keep``
    (which also order rows of equal id and size), one row per input row.  Documents
    of a source are read in the order of a hash of their id, again from the
    start where the target exceeds the source; the document at which the target
    is reached is taken in part, so that the words taken differ from the target
    by less than one.  ``positions`` has one entry for each time a document is
    (wholly or in part) taken; see :func:`readings`.  Null and empty texts have no words
    and are never taken; long texts are counted whole.  Null sources form one source
    that ranks last.  Null ids sort first; ties of id and size go by ``keep``.
    Repeated ids stay separate rows.  Without documents the result is empty; further
    columns are ignored, whatever their names, if ``keep`` does not name them.
    """
    text = F.col("text").cast("string")
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), skey.alias("skey"), word_count(text).alias("size"), order.alias("turn"), *keep)
    sized = materialize(sized.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS)), "sizes")

    sources = source_targets(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, ratio, max_repeats, schedules)
    parts = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part").over(before), F.lit(0))).join(sources, "skey")

    within = Window.partitionBy("skey", "bucket").orderBy("turn", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets.drop("part"), ["skey", "bucket"])
    start = F.col("offset") + F.col("ahead")
    goal = F.floor("target")
    starts = [start + F.col("source_size") * e for e in range(max_repeats)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), goal - s)) for s in starts]
    rows = rows.withColumns({"taken": sum(takes[1:], takes[0]).cast("long"), "starts": F.array(*[F.when(t > 0, s.cast("double")) for t, s in zip(takes, starts)])})
    time = lambda s: _time_of(F.least(s / F.col("target"), F.lit(1.0)), F.col("tilt"))
    moment = lambda t: F.col("demand") * t + F.col("drift") * (t - t * t)
    positions = F.transform(F.filter("starts", lambda s: s.isNotNull()), lambda s: moment(time(s)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", positions.alias("positions"), *keep)


def readings(mixed: DataFrame) -> DataFrame:
    """One row ``position`` for each time that a document is taken, wholly or in part; the rest goes."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each reading, range-sorted by ``position``; what is not taken goes.  Equal
    positions go by id, null ids first."""
    return readings(mixed).orderBy("position", "doc_id", "size")
