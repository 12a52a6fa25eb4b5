"""Exact n-gram Jaccard join over whole texts, and its connected classes.

Nothing is sampled, capped or approximated:

1. Counting filter.  Blocks of documents send their distinct shingles, packed
   and by hash range, to be counted, and get back how many of each document's
   shingles another document holds.  A partner shares at least ``percent`` of
   a document's shingles, so documents with fewer shared ones are done.
2. Equal sets are collapsed; the sets that remain are counted exactly among
   each other.  Shingles that only one set holds find no partner, so the prefix
   of a set (any partner shares one of its entries) is taken from the shared
   ones, the rarest first.
3. Skipping by set relations.  Each index list first compares its members with
   one leader.  Lists whose members are then in one class are skipped whole.
   In the others only pairs of different classes are left: blocks of set sizes
   that an entry's position rules out are skipped, and answers already computed
   for a similar set that both were compared with (their anchor) bound the
   overlap from both sides, which settles most pairs without reading the sets.

A shingle is known by a 64-bit hash, a set by a 64-bit hash of its shingles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected_components
from .storage import materialize, release

WIDTH, PERCENT = 5, 75
#: A null document id; it comes after all others.
NULL_ID = (1 << 63) - 1
BLOCK_BYTES = 2 << 20
#: Shingles of sets that are counted together in the second step.
BLOCK_SHINGLES = 1 << 19
#: Entries that one counting range gets on average, and the least number of ranges.
RANGE_ENTRIES, MIN_RANGES = 1 << 21, 256
#: Leaders that a list draws in each round after the first, before all pairs left are compared.
DRAWS = (4, 32)
#: Size blocks: each holds the sizes within this ratio.
SIZE_RATIO = 1.15
MANY = 0xFFFF
#: Edges for each set that is left after the counting filter, from which the number
#: of files of tables of edges and classes follows (not a limit).
PER_SET = 20

_MESSAGE = "dest long, kind int, block long, a binary, b binary"


def needed(n, percent: int):
    """Least overlap with any partner of a set of ``n`` shingles."""
    return (percent * n + 99) // 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the row bounds among them."""
    starts, ends, first = tk.word_spans(data, offsets)
    words = tk.span_hashes(tk.LOWERED[data], starts, ends)
    hashes, bounds = tk.shingle_hashes(words, first, width)
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    new[heads] = True
    kept = np.concatenate(([0], np.cumsum(new)))[bounds]
    return hashes[new], kept


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit name of each set; 0 for the empty set."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(tk.mix(hashes), out=sums[1:])
        n = np.diff(bounds).astype(np.uint64)
        name = tk.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * np.uint64(0xC2B2AE3D27D4EB4F))
    name[n == 0] = 0
    return name.view(np.int64)


def _messages(dest, kind, block, a, b) -> pa.RecordBatch:
    arrays = [pa.array(dest, pa.int64()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["dest", "kind", "block", "a", "b"])


def _with_header(part: int, serial: int, bits: int) -> int:
    """Hash range that a block's header travels with.  Any will do; the steps of a
    sequence without clusters (powers of the plastic number) deal them evenly, however
    many tasks send and however many blocks each has."""
    return ((part * 0xC13FA9A9 + serial * 0x91E10DA5) & 0xFFFFFFFF) >> (32 - bits)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*[batch.column(n).to_pylist() for n in ("dest", "kind", "block", "a", "b")])


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys byte by byte, so that the high bytes compress."""
    return np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _send_shingles(bits: int, width: int):
    """Header of each block, and its distinct shingles by hash range with the
    document that holds each, or MANY (those are counted here already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            every = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tk.blocks(batch.column("text"), BLOCK_BYTES):
                hashes, bounds = shingle_sets(data, offsets, width)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                order = np.argsort(hashes)
                ordered, holder = hashes[order], doc[order]
                first = np.ones(len(ordered), bool)
                first[1:] = ordered[1:] != ordered[:-1]
                single = first.copy()
                single[:-1] &= first[1:]
                shared = np.bincount(holder[~single], minlength=j - i)
                holder = np.where(single, holder, MANY)[first].astype(np.uint16)
                keys = ordered[first]
                block, header_range = (part << 32) + serial, _with_header(part, serial, bits)
                serial += 1
                header = pickle.dumps((every[i:j], np.diff(bounds), set_names(hashes, bounds), shared))
                ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
                low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
                ends = [*cuts[1:], len(ranges)]
                yield _messages(
                    [header_range, *ranges[cuts].tolist()],
                    [0] + [1] * len(cuts),
                    [block] * (len(cuts) + 1),
                    [header, *[_planes(low[a:b]) for a, b in zip(cuts, ends)]],
                    [None, *[holder[a:b].tobytes() for a, b in zip(cuts, ends)]],
                )

    return run


def _count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes headers on; answers each block how many entries of each document another block holds too."""

    def answer(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(p[1]) for p in parts])
        keyed = np.concatenate([p[1] for p in parts]).astype(np.uint64) << np.uint64(32) | np.arange(sizes.sum(), dtype=np.uint64)
        keyed.sort()
        key = keyed >> np.uint64(32)
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        hit = np.zeros(len(key), bool)
        hit[(keyed[same] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        blocks, docs, counts = [], [], []
        at = 0
        for block, keys, holder in parts:
            found = holder[hit[at : at + len(keys)]]
            at += len(keys)
            doc, n = np.unique(found[found != MANY], return_counts=True)
            if len(doc):
                blocks.append(block)
                docs.append(doc.astype(np.uint16).tobytes())
                counts.append(n.astype(np.uint32).tobytes())
        return _messages([0] * len(blocks), [1] * len(blocks), blocks, docs, counts)

    current, parts = None, []
    for batch in batches:
        passed = []
        for dest, kind, block, a, b in _rows(batch):
            if kind == 0:
                passed.append((block, a))
                continue
            if dest != current:
                if len(parts) > 1:
                    yield answer(parts)
                current, parts = dest, []
            parts.append((block, _unplaned(a), np.frombuffer(b, np.uint16)))
        if passed:
            yield _messages([0] * len(passed), [0] * len(passed), [p[0] for p in passed], [p[1] for p in passed], [None] * len(passed))
    if len(parts) > 1:
        yield answer(parts)


def _judge(percent: int):
    def finish(header: tuple) -> pa.RecordBatch:
        ids, n, names, shared = header
        open_ = (n > 0) & (shared >= needed(n, percent))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(names), pa.array(open_)], names=["doc_id", "n", "node", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header = None
        for batch in batches:
            for _, kind, _, a, b in _rows(batch):
                if kind == 0:
                    if header is not None:
                        yield finish(header)
                    header = pickle.loads(a)
                else:
                    header[3][np.frombuffer(a, np.uint16)] += np.frombuffer(b, np.uint32)
        if header is not None:
            yield finish(header)

    return run


def _named_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tk.blocks(batch.column("text"), BLOCK_BYTES):
                hashes, bounds = shingle_sets(data, offsets, width)
                right = np.flatnonzero(set_names(hashes, bounds) == nodes[i:j])
                lists = [hashes[bounds[r] : bounds[r + 1]].view(np.int64) for r in right]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i:j][right]), pa.array(np.diff(bounds)[right].astype(np.int32)), pa.array(lists, pa.list_(pa.int64()))], names=["node", "n", "hashes"])

    return run


def _send_sets(bits: int):
    """Like ``_send_shingles`` for sets: headers carry the sets, and entries how many sets of the block hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            column = batch.column("hashes")
            bounds = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            flat = column.flatten().to_numpy().view(np.uint64)
            i = 0
            while i < len(nodes):
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_SHINGLES, "right")) - 1)
                hashes = flat[bounds[i] : bounds[j]]
                block, header_range = (part << 32) + serial, _with_header(part, serial, bits)
                serial += 1
                keys, counts = np.unique(hashes, return_counts=True)
                header = pickle.dumps((nodes[i:j], bounds[i : j + 1] - bounds[i], hashes))
                ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
                ends = [*cuts[1:], len(ranges)]
                yield _messages(
                    [header_range, *ranges[cuts].tolist()],
                    [0] + [1] * len(cuts),
                    [block] * (len(cuts) + 1),
                    [header, *[keys[a:b].tobytes() for a, b in zip(cuts, ends)]],
                    [None, *[counts[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, ends)]],
                )
                i = j

    return run


def _total_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes headers on; answers each block which of its shingles two or more sets hold, and how many."""

    def answer(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)[inverse]
        at, rows = 0, []
        for block, own, _ in parts:
            sums = total[at : at + len(own)]
            at += len(own)
            if (sums > 1).any():
                rows.append((block, own[sums > 1].tobytes(), sums[sums > 1].tobytes()))
        return _messages([0] * len(rows), [1] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    current, parts = None, []
    for batch in batches:
        passed = []
        for dest, kind, block, a, b in _rows(batch):
            if kind == 0:
                passed.append((block, a))
                continue
            if dest != current:
                if parts:
                    yield answer(parts)
                current, parts = dest, []
            parts.append((block, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))
        if passed:
            yield _messages([0] * len(passed), [0] * len(passed), [p[0] for p in passed], [p[1] for p in passed], [None] * len(passed))
    if parts:
        yield answer(parts)


def _prefixes(percent: int):
    """Index entries of each set: its shared shingles from the rarest on, as many
    as any partner must hit one of."""

    def finish(header: tuple, answers: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        nodes, bounds, hashes = header
        if not answers:
            return None
        keys, totals = (np.concatenate(x) for x in zip(*answers))
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        df = np.where(keys[at] == hashes, totals[at], 1)
        out = []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            n, own = b - a, np.flatnonzero(df[a:b] > 1) + a
            length = len(own) - needed(int(n), percent) + 1
            if length > 0:
                chosen = own[np.lexsort((hashes[own], df[own]))[:length]]
                out.append((hashes[chosen].view(np.int64), np.full(length, nodes[k]), np.full(length, n, np.int32), (n - len(own) + np.arange(length)).astype(np.int32)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["h", "node", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, answers = None, []
        for batch in batches:
            for _, kind, _, a, b in _rows(batch):
                if kind == 0:
                    if header is not None and (out := finish(header, answers)) is not None:
                        yield out
                    header, answers = pickle.loads(a), []
                else:
                    answers.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
        if header is not None and (out := finish(header, answers)) is not None:
            yield out

    return run


def _exchange(messages: DataFrame, by: str, parts: int) -> DataFrame:
    # By the number itself: hashing a few hundred ranges would give some tasks twice their share.
    return messages.repartitionById(parts, F.pmod(F.col(by) + F.shiftright(by, 32), F.lit(parts)).cast("int")).sortWithinPartitions(by, "kind")


def _range_bits(entries: int) -> int:
    return max(MIN_RANGES, -(-entries // RANGE_ENTRIES)).bit_length() - 1


class _Links:
    """Overlaps computed so far and the classes of linked sets."""

    def __init__(self, sets: DataFrame, count: int, percent: int):
        self.sets, self.count, self.percent = sets, count, percent
        self.checked: DataFrame | None = None  # a, b, na, nb, overlap with a < b
        self.edges: DataFrame | None = None
        self.classes: DataFrame | None = None  # node, component

    def passes(self, overlap: Column) -> Column:
        return overlap * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent

    def check(self, pairs: DataFrame) -> DataFrame:
        """Compute the overlaps of pairs ``a, b, na, nb`` that are new; returns the linked ones."""
        pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
        if self.checked is not None:
            pairs = pairs.join(self.checked.select("a", "b"), ["a", "b"], "left_anti")
        left = self.sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
        right = self.sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
        overlap = F.size(F.array_intersect("ha", "hb"))
        done = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", overlap.alias("overlap")), "overlaps")
        self.checked = done if self.checked is None else self.checked.unionByName(done)
        return done.filter(self.passes(F.col("overlap"))).select("a", "b")

    def merge(self, links: DataFrame) -> None:
        """Join the classes that links ``a, b`` connect.  Only links between different
        classes are followed, so a group is not walked again once it is one class."""
        old = self.classes
        if old is None:
            self.classes = connected_components(links, "a", "b", rows=self.count * PER_SET)
            return
        for end in ("a", "b"):
            links = links.join(old.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class")), end, "left").withColumn(end, F.coalesce(f"{end}_class", end)).select("a", "b")
        joined = connected_components(links.filter("a <> b").distinct(), "a", "b", rows=self.count * PER_SET)
        moved = old.join(joined.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        self.classes = materialize(moved.unionByName(joined), "classes", self.count)
        release(old)

    def labelled(self, postings: DataFrame) -> DataFrame:
        return postings.join(self.classes, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    def anchors(self) -> DataFrame:
        """For each set the most similar one it was compared with: ``node, anchor, common, anchor_n``."""
        ways = [self.checked.select(F.col(x).alias("node"), F.col(y).alias("anchor"), F.col("overlap").alias("common"), F.col(f"n{y}").alias("anchor_n")) for x, y in (("a", "b"), ("b", "a"))]
        likeness = F.col("common") / F.greatest("anchor_n", F.lit(1))
        return ways[0].unionByName(ways[1]).groupBy("node").agg(F.max_by(F.struct("anchor", "common", "anchor_n"), F.struct(likeness, F.col("anchor"))).alias("best")).select("node", "best.*")


def _first_leaders(postings: DataFrame) -> DataFrame:
    """Every entry of a list of two or more with the list's leader.  Most lists of
    a group share theirs, so that a set is compared with few others."""
    leader = F.min_by(F.struct("node", "n", "pos"), F.xxhash64("node")).alias("lead")
    lists = postings.groupBy("h").agg(leader, F.count("*").alias("size")).filter("size > 1").select("h", "lead.*")
    lists = lists.toDF("h", "m", "m_n", "m_pos")
    return postings.join(lists, "h").filter("node <> m")


def _drawn_leaders(rows: DataFrame, number: int, draws: int, percent: int) -> DataFrame:
    """Entries outside the largest class of their list with about ``draws`` entries
    of that class, drawn by a hash among those whose position admits partners of
    their own size.  Lists that lie in one class are skipped."""
    rows = rows.withColumn("fit", (F.col("n") - F.col("pos")) * (100 + percent) >= F.col("n") * 2 * percent)
    classes = rows.groupBy("h", "c").agg(F.count("*").alias("size"), F.count_if("fit").alias("fits"))
    main = F.max_by(F.struct(F.col("c").alias("main"), "fits"), F.struct("size", "c")).alias("main")
    lists = classes.groupBy("h").agg(main, F.count("*").alias("classes")).filter("classes > 1").select("h", "main.*")
    rows = rows.join(lists, "h")
    one_in = F.greatest(F.lit(1), F.floor(F.col("fits") / draws))
    drawn = rows.filter((F.col("c") == F.col("main")) & F.col("fit") & (F.pmod(F.xxhash64("node", "h", F.lit(number)), one_in) == 0))
    drawn = drawn.select("h", F.col("node").alias("m"), F.col("n").alias("m_n"), F.col("pos").alias("m_pos"))
    return rows.filter("c <> main").join(drawn, "h")


def _admissible(na: str, pa_: str, nb: str, pb: str, percent: int) -> Column:
    """Sizes and positions of a common entry still allow the needed overlap."""
    rest = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    both = (F.col(na) + F.col(nb)) * percent
    sizes = F.least(F.col(na), F.col(nb)) * 100 >= F.greatest(F.col(na), F.col(nb)) * percent
    return sizes & (rest * (100 + percent) >= both)


def _pair(x: str, nx: str, y: str, ny: str) -> list[Column]:
    first = F.col(x) < F.col(y)
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return [pick(x, y).alias("a"), pick(y, x).alias("b"), pick(nx, ny).alias("na"), pick(ny, nx).alias("nb")]


def _size_block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(log(SIZE_RATIO)) + F.lit(1e-9)).cast("int")


def _pairs_left(rows: DataFrame, links: _Links) -> DataFrame:
    """All pairs of different classes that lists and positions admit, with bounds
    ``low`` and ``high`` of their overlap from a common anchor.

    Each pair has a side outside the list's largest class; that side looks up
    the size blocks that its own size and position in the list allow.
    """
    percent = links.percent
    sizes = rows.groupBy("h", "c").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("h").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("classes")).filter("classes > 1").select("h", "main")
    rows = rows.join(lists, "h").join(links.anchors(), "node", "left")
    low = F.ceil(F.col("n") * percent / 100)
    by_position = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    high = F.least(F.floor(F.col("n") * 100 / percent), by_position)
    x = rows.filter("c <> main").filter(low <= high)
    x = x.withColumn("size_block", F.explode(F.sequence(_size_block(low), _size_block(high))))
    x = x.select("h", "size_block", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "c", "anchor", "common", "anchor_n")])
    y = rows.withColumn("size_block", _size_block(F.col("n")))
    y = y.select("h", "size_block", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos", "c", "anchor", "common")])
    joined = x.join(y, ["h", "size_block"]).filter(F.col("x_c") != F.col("y_c")).filter(_admissible("x_n", "x_pos", "y_n", "y_pos", percent))
    known = F.coalesce(F.col("x_anchor") == F.col("y_anchor"), F.lit(False))
    least = F.when(known, F.greatest(F.lit(0), F.col("x_common") + F.col("y_common") - F.col("x_anchor_n"))).otherwise(F.lit(0))
    outside = F.least(F.col("x_n") - F.col("x_common"), F.col("y_n") - F.col("y_common"))
    most = F.when(known, F.least("x_common", "y_common") + outside).otherwise(F.least("x_n", "y_n"))
    return joined.select(*_pair("x_node", "x_n", "y_node", "y_n"), least.alias("low"), most.alias("high"))


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Classes of documents that links of Jaccard similarity ``percent`` or more connect.

    ``docs`` has ``doc_id, text``.  A document's set holds its distinct
    shingles of ``width`` words (ASCII letters lower-cased); with fewer words,
    the whole sequence is its one shingle.  Returns ``doc_id, n_shingles,
    component_id`` (the smallest id reachable by links, itself included), one
    row per input row.  Null and empty texts have empty sets, link with nothing
    and are their own components.  Rows that repeat an id are documents of their
    own.  A null id comes after all others; a class of null ids alone has a
    null component.  An empty table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = docs.mapInArrow(_send_shingles(_range_bits(size // 6), width), _MESSAGE)
    counted = _exchange(sent, "dest", parts).mapInArrow(_count_ranges, _MESSAGE)
    stats = materialize(_exchange(counted, "block", parts).mapInArrow(_judge(percent), "doc_id long, n long, node long, open boolean"), "sets")

    reps = stats.filter("open").groupBy("node").agg(F.min("doc_id").alias("rep"))
    texts = docs.withColumn("rep", F.coalesce("doc_id", F.lit(NULL_ID))).join(reps, "rep").select("node", "text")
    sets = materialize(texts.mapInArrow(_named_sets(width), "node long, n int, hashes array<long>").dropDuplicates(["node"]), "shingles")
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = sets.select("node", "hashes").mapInArrow(_send_sets(_range_bits(total)), _MESSAGE)
    counted = _exchange(sent, "dest", parts).mapInArrow(_total_ranges, _MESSAGE)
    postings = materialize(_exchange(counted, "block", parts).mapInArrow(_prefixes(percent), "h long, node long, n int, pos int"), "postings")

    links = _Links(sets, count, percent)
    for number, draws in enumerate((1, *DRAWS)):
        met = _drawn_leaders(links.labelled(postings), number, draws, percent) if number else _first_leaders(postings)
        links.merge(links.check(met.filter(_admissible("n", "pos", "m_n", "m_pos", percent)).select(*_pair("node", "n", "m", "m_n"))))
    left = materialize(_pairs_left(links.labelled(postings), links).groupBy("a", "b", "na", "nb").agg(F.max("low").alias("low"), F.min("high").alias("high")), "left")
    open_ = left.filter(links.passes(F.col("high")) & ~links.passes(F.col("low")))
    links.merge(links.check(open_.select("a", "b", "na", "nb")).unionByName(left.filter(links.passes(F.col("low"))).select("a", "b")))

    rooted = stats.join(links.classes, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    # Written first, so that the join below is one of two tables and a large class can be split.
    least = materialize(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    real = lambda c: F.when(c != NULL_ID, c)
    out = rooted.join(least, "root", "left")
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("least", "doc_id")).alias("component_id"))
