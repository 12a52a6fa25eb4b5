"""Minimax contiguous sharding, in DataFrame functions only.

Documents with equal texts form an atomic group.  Groups are ordered by a hash
of their text and cut into contiguous shards whose largest byte size is the
smallest possible.  The search for that size runs on the driver over a bounded
summary: byte totals of hash ranges.  Ranges that a cut could fall into are
summarised again in finer ranges until the answer is exact, so the driver never
holds more than a few ten thousand totals however many groups there are.

A document's shard follows from its own hash and the cuts alone: texts are not
moved or joined to be assigned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize, release

#: Bits of the hash that the first summary drops, and bits that each finer one resolves.
FIRST_SHIFT, STEP = 52, 8
#: Parts of a shard that are numbered apart; their counts give the offsets.
SLOT_BUCKETS = 4096


class Ranges:
    """Ordered hash ranges with byte totals; a range with one group is atomic."""

    def __init__(self, ranges: list[tuple[int, int, int, int, int]]):
        self.ranges = sorted(ranges)  # (start, shift, bytes, groups, largest group)
        self.ends = list(accumulate(r[2] for r in self.ranges))
        self.total = self.ends[-1] if self.ends else 0
        self.largest = max((r[4] for r in self.ranges), default=0)

    def greedy(self, capacity: int, shards: int, split_open: bool) -> list[int] | None:
        """Byte positions of the cuts when each shard takes all it can, or None if
        that needs more shards.  A range of several groups is taken as divisible
        anywhere (``split_open``) or as atomic."""
        at, cuts = 0, []
        for _ in range(shards):
            if self.total - at <= capacity:
                return cuts
            k = bisect_right(self.ends, at + capacity)  # first range that does not fit whole
            start = self.ends[k - 1] if k else 0
            at_next = at + capacity if split_open and self.ranges[k][3] > 1 else start
            if at_next <= at:
                return None
            at = at_next
            cuts.append(at)
        return None

    def smallest(self, shards: int, split_open: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), max(self.total, self.largest)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, split_open) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def balanced(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Cuts within the capacity, each as near as possible to an even share of what
        is left, and the divisible ranges in which such a share ends.

        A cut stays where the rest still fits: at or behind the least position from
        which the shards to come can hold it, found greedily from the end.
        """
        starts = [0, *self.ends[:-1]]
        least, at = [0] * shards, self.total
        for j in range(shards - 1, 0, -1):
            at = least[j] = starts[min(bisect_left(starts, at - capacity), len(starts) - 1)]
        cuts: list[int] = []
        unclear: set[int] = set()
        have = 0
        for j in range(1, shards):
            share = have + (self.total - have) / (shards - j + 1)
            k = min(bisect_left(self.ends, share), len(self.ends) - 1)
            near = [p for p in (starts[k], self.ends[k], least[j]) if max(have + 1, least[j]) <= p <= have + capacity]
            near = near or [self.ends[bisect_right(self.ends, have)]]
            have = min(near, key=lambda p: abs(p - share))
            if have >= self.total:
                break
            if self.ranges[k][3] > 1:
                unclear.add(k)
            cuts.append(have)
        return cuts, unclear

    def uncertain(self, low: int, high: int, shards: int) -> list[int]:
        """Indexes of divisible ranges that a cut can fall into for some capacity from low to high."""
        found: set[int] = set()
        near, far = 0, 0
        for _ in range(shards - 1):
            k = bisect_right(self.ends, near + low)
            near = max(near, self.ends[k - 1] if k else 0)
            far = min(far + high, self.total)
            last = min(bisect_left(self.ends, far), len(self.ranges) - 1)
            found.update(i for i in range(min(k, len(self.ranges) - 1), last + 1) if self.ranges[i][3] > 1)
        return sorted(found)


def _summary(groups: DataFrame, shift: int) -> DataFrame:
    key = F.shiftright("h", shift) if shift else F.col("h")
    return groups.groupBy(key.alias("k")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most"))


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hashes of shards 1, 2, … and the smallest feasible capacity.

    The cuts keep to that capacity and lie as near as it admits to even shares.
    ``groups`` has one row ``h, bytes`` per atomic group; it is read once for
    each refinement of the summary, as a rule three to five times.
    """
    rows = _summary(groups, FIRST_SHIFT).collect()  # at most 2 ** (64 - FIRST_SHIFT) rows
    known = Ranges([(r["k"] << FIRST_SHIFT, FIRST_SHIFT, r["bytes"], r["n"], r["most"]) for r in rows])
    while True:
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        if low == high:
            break
        known = _finer(groups, known, set(known.uncertain(low, high, shards)) or {i for i, r in enumerate(known.ranges) if r[3] > 1})
    if not known.total:
        return [], 0
    while True:
        positions, unclear = known.balanced(high, shards)
        if not unclear:
            break
        known = _finer(groups, known, unclear)
    return [known.ranges[bisect_right(known.ends, p)][0] for p in positions], high


def _finer(groups: DataFrame, known: Ranges, chosen: set[int]) -> Ranges:
    """The summary with the chosen ranges replaced by finer ones."""
    finer = []
    for shift in sorted({known.ranges[i][1] for i in chosen}, reverse=True):
        keys = [known.ranges[i][0] >> shift for i in chosen if known.ranges[i][1] == shift]
        below = max(0, shift - STEP)
        parts = _summary(groups.filter(F.shiftright("h", shift).isin(keys)), below).collect()
        finer += [(r["k"] << below, below, r["bytes"], r["n"], r["most"]) for r in parts]
    return Ranges([r for i, r in enumerate(known.ranges) if i not in chosen] + finer)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_of(h: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the hash: a fixed expression, nothing is joined."""
    shard = F.lit(0)
    for k, cut in enumerate(cuts):
        shard = F.when(h >= F.lit(cut), F.lit(k + 1)).otherwise(shard)
    return shard.cast("int")


def with_slots(rows: DataFrame, key: str = "shard", spread: Column | None = None) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, the same in every run.

    Rows are numbered in small buckets of a shard, and bucket counts give the
    offsets, so a shard is not sorted in one task.
    """
    spread = spread if spread is not None else F.xxhash64("doc_id")
    rows = rows.withColumn("_t_bucket", F.pmod(spread, F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy(key, "_t_bucket").agg(F.count("*").alias("_t_n"))
    before = Window.partitionBy(key).orderBy("_t_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_t_bucket", F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_t_offset"))
    within = F.row_number().over(Window.partitionBy(key, "_t_bucket").orderBy("doc_id", "_t_crc", *[c for c in ("_t_size",) if c in rows.columns]))
    numbered = rows.withColumn("_t_within", within - 1)
    return numbered.join(offsets, [key, "_t_bucket"]).withColumn("slot", (F.col("_t_offset") + F.col("_t_within")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Assign every document to a shard and a slot.

    ``docs`` has ``doc_id, text``.  Returns the columns named in ``keep``
    (``doc_id`` if none are) and ``size, text_crc32, shard, slot``, one row per
    input row.  A null text has size 1 and a null checksum and forms a group of
    its own beside the empty text.  A group larger than an even share makes its
    shard larger, as equal texts stay together.  With few groups some shards
    are empty.  Null and repeated ids are kept and get slots of their own.  An
    empty table gives an empty one; further columns are ignored.
    """
    keep = keep or ["doc_id"]
    text = F.col("text").cast("string")
    sized = docs.select(text_hash(text).alias("h"), text_size(text).alias("bytes"))
    groups = materialize(sized.groupBy("h").agg(F.sum("bytes").alias("bytes")), "groups")
    cuts, _ = minimax_cuts(groups, shards)
    release(groups)
    carried = [c for c in dict.fromkeys(["doc_id", *keep])]
    rows = docs.select(*carried, text_size(text).alias("_t_size"), F.crc32(text).alias("_t_crc"), shard_of(text_hash(text), cuts).alias("_t_shard"))
    slotted = with_slots(rows, "_t_shard", F.xxhash64("doc_id", "_t_crc"))
    added = {"_t_size": "size", "_t_crc": "text_crc32", "_t_shard": "shard", "slot": "slot"}
    return slotted.select(*[c for c in keep if c not in added.values()], *[F.col(a).alias(b) for a, b in added.items()])
