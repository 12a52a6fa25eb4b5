"""Embedding near-duplicates with randomised-rotation binary codes.

Each vector is stored as a code: the signs of its random rotations, the correction
factor (inner product of the vector with its code) and the first rotation in four
bits a component.  Everything before the last step reads codes alone:

1. Equal vectors are collapsed.
2. Candidates meet in cells, whose numbers are groups of the code's bits; the
   length of a group follows from the number of vectors and the number of groups
   from the wanted recall at the threshold.
3. Within a cell one vector's four-bit form with the other's code and factor give
   an unbiased estimate of the inner product and a confidence bound.  Vectors
   without a possible partner are done.
4. The others' exact vectors are fetched, and the pairs that the bound does not
   rule out are computed in double precision.

A pair is counted in the first cell in which it meets, so pairs never need to be
written out: tasks return link counts and the edges of spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import materialize, release

THRESHOLD = 0.95
#: Chance that a pair at the threshold meets in some cell, before the bound's error.
RECALL = 0.999
#: Vectors that a cell holds on average if they lie at random.
CELL = 2048
#: Rows of a cell that one task compares with as many others; larger cells are split.
SPLIT = 8192
#: Width of the confidence bound in standard deviations of the estimate.
BOUND = 3.5
#: Rotations that an estimate uses give at most about so many components.
ESTIMATE_BITS = 256
SEED = 20240607
#: Bits of a cell's key that number its group, and those that hold the cell itself.
GROUP_BITS, CELL_BITS = 8, 28


def index_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a cell number, groups of bits) for ``n`` vectors; few vectors share one cell."""
    bits = min(CELL_BITS, round(log2(n / CELL))) if n > CELL else 0
    while True:
        agree = (1.0 - acos(threshold) / pi) ** bits
        groups = 1 if agree >= recall else ceil(log(1.0 - recall) / log(1.0 - agree))
        if groups < 1 << GROUP_BITS:
            return bits, groups
        bits -= 1


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotations(dim: int, bits: int, groups: int) -> int:
    """Rotations whose signs make up a code."""
    return max(1, -(-bits * groups // dim))


@lru_cache(maxsize=8)
def _from_first(dim: int, count: int) -> np.ndarray:
    """Turns a vector given in the first rotation into all ``count`` rotations, at unit length."""
    return (np.concatenate([rotation(dim, 0) @ rotation(dim, r).T for r in range(count)], axis=1) / sqrt(count)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Codes:
    """Stored codes of vectors of one dimension: sign bits, factors and four-bit forms."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, levels: np.ndarray):
        self.signs, self.factor, self.low, self.step, self.levels = signs, factor, low, step, levels

    @classmethod
    def of(cls, units: np.ndarray, count: int) -> Codes:
        dim = units.shape[1]
        turned = np.concatenate([units @ rotation(dim, r).T for r in range(count)], axis=1)
        used = _used(dim, count)
        factor = np.abs(turned[:, : used * dim]).sum(1) / (sqrt(used) * sqrt(used * dim))
        first = turned[:, :dim]
        low = first.min(1)
        step = np.maximum((first.max(1) - low) / 15.0, 1e-12)
        # Rounded at random, so that the rounding adds no bias.
        noise = np.random.default_rng([SEED, dim, len(units)]).random(first.shape)
        levels = np.clip(np.floor((first - low[:, None]) / step[:, None] + noise), 0, 15).astype(np.uint8)
        return cls(turned >= 0, factor.astype(np.float32), low.astype(np.float32), step.astype(np.float32), levels)

    def packed(self) -> list[bytes]:
        pairs = np.concatenate((self.levels, np.zeros((len(self.levels), self.levels.shape[1] % 2), np.uint8)), axis=1)
        numbers = np.stack((self.factor, self.low, self.step), axis=1).view(np.uint8)
        whole = np.concatenate((np.packbits(self.signs, axis=1), numbers, pairs[:, ::2] << 4 | pairs[:, 1::2]), axis=1)
        return [row.tobytes() for row in whole]

    @classmethod
    def unpacked(cls, packed: np.ndarray, dim: int, count: int) -> Codes:
        """From a matrix of bytes, one row a code."""
        at = -(-dim * count // 8)
        numbers = np.ascontiguousarray(packed[:, at : at + 12]).view(np.float32)
        pairs = packed[:, at + 12 :]
        levels = np.stack((pairs >> 4, pairs & 15), axis=2).reshape(len(packed), -1)[:, :dim]
        return cls(np.unpackbits(packed[:, :at], axis=1)[:, : dim * count].astype(bool), numbers[:, 0], numbers[:, 1], numbers[:, 2], levels)

    def cells(self, bits: int, groups: int) -> np.ndarray:
        """Cell of each vector in each group of bits."""
        own = self.signs[:, : bits * groups].reshape(len(self.signs), groups, bits)
        return own.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))

    def queries(self) -> np.ndarray:
        """Rotated vectors, from their four-bit forms."""
        dim = self.levels.shape[1]
        first = self.levels.astype(np.float32) * self.step[:, None] + self.low[:, None]
        return first @ _from_first(dim, _used(dim, self.signs.shape[1] // dim))

    def take(self, rows) -> Codes:
        return Codes(self.signs[rows], self.factor[rows], self.low[rows], self.step[rows], self.levels[rows])


def _used(dim: int, count: int) -> int:
    """Rotations of a code that estimates read."""
    return min(count, max(1, ESTIMATE_BITS // dim))


def possible_pairs(left: Codes, right: Codes | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs whose inner product the codes do not bound below the
    threshold, in strips; ``right`` None: pairs within ``left``.

    With v = c u + sqrt(1 - c^2) e, where u is the coded vector and e orthogonal to
    it, the estimate <code, v> / factor is c plus sqrt(1 - c^2) times the error of a
    random direction; this lower bound grows with c, so it is tested at the threshold.
    """
    others = left if right is None else right
    dim = left.levels.shape[1]
    used = _used(dim, left.signs.shape[1] // dim)
    length = used * dim
    code = np.where(others.signs[:, :length], np.float32(1), np.float32(-1)) / np.float32(sqrt(length))
    factor = np.maximum(others.factor, 1e-6)
    direction = (1.0 - factor**2) / factor**2 / max(used * (dim - 1), 1) * max(1.0 - threshold**2, 0.0)
    for a in range(0, len(left.levels), 256):
        strip = slice(a, min(a + 256, len(left.levels)))
        own = left.take(strip)
        estimate = (own.queries() @ code.T) / factor
        rounding = (own.step**2 / 4.0)[:, None] / factor**2  # the most that rounding to a step varies
        possible = estimate >= threshold - BOUND * np.sqrt(direction + rounding) - 1e-6
        if right is None:
            possible &= np.arange(len(others.levels))[None, :] > np.arange(strip.start, strip.stop)[:, None]
        x, y = np.nonzero(possible)
        if len(x):
            yield x + a, y


def _new_pairs(codes: Codes, side: np.ndarray, group: int, bits: int, groups: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a cell that may be near and that no earlier group of bits brought together."""
    earlier = codes.cells(bits, groups)[:, :group]
    if (side == 0).all():
        a = b = np.arange(len(side))
        found = possible_pairs(codes, None, threshold)
    else:
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        found = possible_pairs(codes.take(a), codes.take(b), threshold) if len(a) and len(b) else ()
    for x, y in found:
        for at in range(0, len(x), 1 << 16):
            i, j = a[x[at : at + (1 << 16)]], b[y[at : at + (1 << 16)]]
            new = ~(earlier[i] == earlier[j]).any(1)
            if new.any():
                yield i[new], j[new]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _valid(embedding: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether each row can link, values, starts, lengths)."""
    flat = embedding.flatten()
    lengths = np.nan_to_num(np.array(embedding.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    good = np.zeros(len(lengths), bool)
    rows = np.flatnonzero(lengths)
    if len(rows):
        finite = np.logical_and.reduceat(np.isfinite(values), starts[rows])
        good[rows] = finite & np.logical_or.reduceat(values != 0, starts[rows])
    return good, values, starts, lengths


def _key(dim: int, cells: np.ndarray) -> np.ndarray:
    """One number for a cell, its group of bits and the dimension: vectors of different lengths never meet."""
    return ((np.int64(dim) << CELL_BITS | cells) << GROUP_BITS) | np.arange(cells.shape[1])


def _encoder(bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, values, starts, lengths = _valid(batch.column("embedding"))
            good &= ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            code: list[bytes | None] = [None] * batch.num_rows
            keys: list[np.ndarray | None] = [None] * batch.num_rows
            for dim in np.unique(lengths[good]):
                rows = np.flatnonzero(good & (lengths == dim))
                codes = Codes.of(unit(values[starts[rows][:, None] + np.arange(dim)]), rotations(int(dim), bits, groups))
                for r, c, k in zip(rows, codes.packed(), _key(int(dim), codes.cells(bits, groups))):
                    code[r], keys[r] = c, k
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("rid"), pa.array(good), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["vec_id", "rid", "good", "code", "cells"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Key and rows of each run of equal ``cell, pair``; runs of one row are passed over."""

    def whole() -> Iterator[tuple[int, pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows > 1:
            yield last[0], table.to_batches()[0]

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, pair = batch.column("cell").to_numpy(), batch.column("pair").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1]))))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)]):
            key = (int(cell[a]), int(pair[a]))
            if key != last:
                if held:
                    yield from whole()
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield from whole()


def _codes_of(rows: pa.RecordBatch, cell: int, bits: int, groups: int) -> Codes:
    dim = cell >> (CELL_BITS + GROUP_BITS)
    packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return Codes.unpacked(packed, dim, rotations(dim, bits, groups))


def _filter(bits: int, groups: int, threshold: float):
    """Keeps the rows of each cell that have a possible partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _groups(batches):
            has = np.zeros(rows.num_rows, bool)
            side = rows.column("side").to_numpy()
            for i, j in _new_pairs(_codes_of(rows, cell, bits, groups), side, cell & ((1 << GROUP_BITS) - 1), bits, groups, threshold):
                has[i] = has[j] = True
            if has.any():
                yield rows.filter(pa.array(has))

    return run


def _linker(bits: int, groups: int, threshold: float):
    """Computes possible pairs exactly: link counts of rows (``other`` null) and edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _groups(batches):
            ids, copies, side = (rows.column(c).to_numpy() for c in ("rid", "copies", "side"))
            units = unit(rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))
            label, links = np.arange(len(ids)), np.zeros(len(ids))
            for i, j in _new_pairs(_codes_of(rows, cell, bits, groups), side, cell & ((1 << GROUP_BITS) - 1), bits, groups, threshold):
                hit = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
                i, j = i[hit], j[hit]
                links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                label = _forest(len(ids), np.concatenate((i, np.arange(len(ids)))), np.concatenate((j, label)))
            some, edge = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((ids[some], ids[edge]))), pa.array([None] * len(some) + ids[label[edge]].tolist(), pa.int64()), pa.array(np.concatenate((links[some], np.zeros(len(edge)))).astype(np.int64))],
                    names=["rid", "other", "links"],
                )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Link vectors by cosine and find the classes of linked vectors.

    ``vectors`` has ``vec_id, embedding`` (array of numbers).  Returns ``vec_id,
    n_links, component_id, kept``, one row per input row.  No pair below the
    threshold is linked; a pair at it is found with chance ``recall`` or more (less
    about 0.0003 for the bound), a closer one with a higher chance, and equal vectors
    always; up to ``CELL`` vectors share one cell.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of different lengths
    with each other.  A null id links with nothing and has null component and
    kept.  Rows that repeat an id are vectors of their own and count as links of
    each other.  Very long vectors take a matrix of their length squared for each
    rotation.  An empty table gives an empty one; further columns are ignored.
    """
    spark = vectors.sparkSession
    given = F.col("embedding")
    if vectors.schema["embedding"].dataType != T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull):
        given = given.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("embedding")).withColumn("rid", F.xxhash64("embedding"))
    bits, groups = index_shape(rows.count(), threshold, recall)
    members = materialize(rows.mapInArrow(_encoder(bits, groups), "vec_id long, rid long, good boolean, code binary, cells array<long>"), "members")
    # Distinct vectors: any of the equal rows stands for all.
    distinct = members.filter("good").groupBy("rid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("code").alias("code"), F.first("cells").alias("cells"))
    distinct = materialize(distinct, "codes")

    placed = distinct.select("rid", "code", F.explode("cells").alias("cell"))
    large = distinct.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > SPLIT)
    large = large.select("cell", F.ceil(F.col("size") / SPLIT).cast("int").alias("splits"))
    sided = placed.join(large, "cell", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("rid", F.lit(1)), F.col("splits")).cast("int"), F.lit(0)))
    sided = sided.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0)))))
    pair = (F.least("own", "with").cast("long") * (1 << 31) + F.greatest("own", "with")).alias("pair")
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).cast("int").alias("side")
    # A side that meets itself in a split cell has side 0; one that meets another has 1 or 2.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = sided.select("cell", pair, side, "rid", "code").repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair")
    near = materialize(met.mapInArrow(_filter(bits, groups, threshold), "cell long, pair long, side int, rid long, code binary"), "near")

    wanted = near.select("rid").distinct().join(distinct.select("rid", "rep", "copies"), "rid")
    exact = rows.join(wanted.withColumnRenamed("rep", "vec_id"), ["rid", "vec_id"]).groupBy("rid").agg(F.first("copies").alias("copies"), F.first("embedding").alias("embedding"))
    met = near.join(exact, "rid").repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair")
    found = materialize(met.mapInArrow(_linker(bits, groups, threshold), "rid long, other long, links long"), "links")
    release(near)

    links = found.filter("other is null").groupBy("rid").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("other is not null"), "rid", "other").select(F.col("node").alias("rid"), F.col("component").alias("root"))
    known = distinct.select("rid", "copies").join(links, "rid", "left").join(classes, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    linked = materialize(members.select("vec_id", "rid", "good").join(known, "rid", "left"), "linked")
    # Written first, so that the join below is one of two tables and a large class can be split.
    least = materialize(linked.filter("good").groupBy("root").agg(F.min("vec_id").alias("least")), "least")
    n_links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    component = F.when(F.col("good"), F.col("least")).otherwise(F.col("vec_id"))
    out = linked.join(least, "root", "left").select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
