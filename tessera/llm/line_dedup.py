"""Exact line deduplication over a sharded minimal perfect hash.

1. Each block of documents is reduced to its line hashes (a block is the unit of
   all later messages, so a line that very many documents hold costs one entry
   for each block and not one for each document).
2. Hashes are grouped; those that lie in two or more documents are dealt to
   shards, and each shard becomes a minimal perfect hash with arrays of
   fingerprints, document counts and owners (the smallest document id).
3. Blocks probe the shards with their distinct hashes; answers return to the
   block, which tells its documents the hashes they lose.
4. Documents meet these short lists by id and drop the lines.

Lines are told apart by 64-bit hashes of their keys, which are also the stored
fingerprints: among n distinct keys about n * n / 2**65 pairs are confused.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .storage import materialize

#: Keys of fewer code points are left alone.
MIN_CODE_POINTS = 10
#: Keys of a shard of the index, and the least number of shards.
SHARD_KEYS, MIN_SHARDS = 1 << 16, 96
BLOCK_BYTES = 2 << 20
#: A null document id counts as one document that comes last.
NULL_ID = (1 << 63) - 1
#: Slots for each key at a level of the hash, and levels before the rest is kept as a list.
SLACK, LEVELS = 2, 40


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys that
    are alone in their slot are placed, the others go on to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (placed, rank of each slot)
        self.base = 0
        for level in range(LEVELS):
            if not len(keys):
                break
            slots = SLACK * len(keys) + 1
            at = self._slot(keys, level, slots)
            alone = np.bincount(at, minlength=slots) == 1
            self.levels.append((alone, (self.base + np.cumsum(alone) - 1).astype(np.int64)))
            self.base += int(alone.sum())
            keys = keys[~alone[at]]
        self.rest = np.sort(keys)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (tk.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, distinct for the keys built from; -1 or any place for others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (placed, rank) in enumerate(self.levels):
            if not len(todo):
                return out
            at = self._slot(keys[todo], level, len(placed))
            hit = placed[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.base + at[hit]
        return out


class LineShard:
    """The perfect hash of a shard's keys and the arrays it points into."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.hash = PerfectHash(keys)
        at = self.hash.index(keys)
        self.fingerprints = np.zeros(len(keys), np.uint64)
        self.counts = np.zeros(len(keys), np.uint32)
        self.owners = np.zeros(len(keys), np.int64)
        self.fingerprints[at], self.counts[at], self.owners[at] = keys, np.minimum(counts, 0xFFFFFFFF), owners

    def packed(self) -> bytes:
        """All arrays, without reference to this class (workers may hold another copy of it)."""
        return pickle.dumps((self.hash.levels, self.hash.base, self.hash.rest, self.fingerprints, self.counts, self.owners))

    @classmethod
    def unpacked(cls, packed: bytes) -> LineShard:
        shard = cls.__new__(cls)
        shard.hash = PerfectHash(np.zeros(0, np.uint64))
        shard.hash.levels, shard.hash.base, shard.hash.rest, shard.fingerprints, shard.counts, shard.owners = pickle.loads(packed)
        return shard

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are in the shard, their owners)."""
        if not len(self.fingerprints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.hash.index(keys)
        found = np.flatnonzero((at >= 0) & (self.fingerprints[at] == keys))
        found = found[self.counts[at[found]] >= 2]
        return found, self.owners[at[found]]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of a block, also empty ones, and the first line of each row."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    in_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.concatenate(([0], np.cumsum(in_row)))


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line's key and whether the key is long enough to count."""
    solid = np.flatnonzero(~tk.WHITESPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = low < high
    a, b = starts.copy(), starts.copy()
    a[some], b[some] = solid[low[some]], solid[high[some] - 1] + 1
    points = tk.code_point_starts(data)
    long = points[b] - points[a] >= MIN_CODE_POINTS
    hashes = np.zeros(len(starts), np.uint64)
    hashes[long] = tk.span_hashes(tk.LOWERED[data], a[long], b[long])
    return hashes, long


def _blocks_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: ids and hashes of the texts, number of distinct line hashes by row, and these hashes."""
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        texts = batch.column("text_hash").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in tk.blocks(batch.column("text"), BLOCK_BYTES):
            starts, ends, first = line_spans(data, offsets)
            hashes, long = line_keys(data, starts, ends)
            row = np.repeat(np.arange(j - i), np.diff(first))[long]
            hashes = hashes[long]
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            counts = np.bincount(row[new], minlength=j - i).astype(np.int32)
            arrays = [pa.array([(part << 32) + serial], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids[i:j], texts[i:j], counts, hashes[new])]]
            serial += 1
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "texts", "counts", "hashes"])


def _unpacked(ids: bytes, counts: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document id and hash of each entry of a block."""
    return np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)), np.frombuffer(hashes, np.uint64)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    yield from zip(*[batch.column(n).to_pylist() for n in names])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, least and greatest document and number of documents, within each block."""
    for batch in batches:
        for packed in _rows(batch, "ids", "counts", "hashes"):
            ids, hashes = _unpacked(*packed)
            if len(hashes):
                order = np.lexsort((ids, hashes))
                ids, hashes = ids[order], hashes[order]
                start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
                end = np.concatenate((start[1:], [len(hashes)]))
                arrays = [hashes[start].view(np.int64), ids[start], ids[end - 1], (end - start).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["h", "least", "greatest", "n"])


def _build(table: pa.Table) -> pa.Table:
    keys, counts, owners = (table.column(c).to_numpy() for c in ("h", "n", "least"))
    shard = LineShard(keys.view(np.uint64), counts, owners)
    return pa.table({"shard": table.column("shard")[:1], "kind": pa.array([0], pa.int32()), "block": pa.array([-1], pa.int64()), "packed": pa.array([shard.packed()], pa.binary())})


def _probes(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes in _rows(batch, "block", "hashes"):
                distinct = np.unique(np.frombuffer(hashes, np.uint64))
                shard = _shard_of(distinct, shards)
                order = np.argsort(shard, kind="stable")
                distinct, shard = distinct[order], shard[order]
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
                parts = [distinct[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(shard)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts].astype(np.int32)), pa.array(np.ones(len(cuts), np.int32)), pa.array(np.full(len(cuts), block, np.int64)), pa.array(parts, pa.binary())],
                    names=["shard", "kind", "block", "packed"],
                )

    return run


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes.view(np.int64) % shards).astype(np.int32)  # as pmod


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes come after their shard's index; only hits are answered."""
    current, shard = None, None
    for batch in batches:
        blocks, hashes, owners = [], [], []
        for number, kind, block, packed in _rows(batch, "shard", "kind", "block", "packed"):
            if kind == 0:
                current, shard = number, LineShard.unpacked(packed)
            elif number == current:
                keys = np.frombuffer(packed, np.uint64)
                found, owner = shard.probe(keys)
                if len(found):
                    blocks.append(block)
                    hashes.append(keys[found].tobytes())
                    owners.append(owner.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(hashes, pa.binary()), pa.array(owners, pa.binary())], names=["block", "hashes", "owners"])


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block comes after the answers to it; gives the hashes that each of its rows loses."""
    current, keys, owners = None, [], []
    for batch in batches:
        docs, texts, lost = [], [], []
        for kind, block, ids, names, counts, hashes in _rows(batch, "kind", "block", "ids", "texts", "counts", "hashes"):
            if block != current:
                current, keys, owners = block, [], []
            if kind == 0:
                keys.append(np.frombuffer(hashes, np.uint64))
                owners.append(np.frombuffer(ids, np.int64))
            elif keys:
                known, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(known)
                known, owner = known[order], owner[order]
                doc, entry = _unpacked(ids, counts, hashes)
                row = np.repeat(np.arange(len(counts) // 4), np.frombuffer(counts, np.int32))
                at = np.minimum(np.searchsorted(known, entry), len(known) - 1)
                loses = np.flatnonzero((known[at] == entry) & (owner[at] != doc))
                doc, row, entry = doc[loses], row[loses], entry[loses]
                cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                docs += doc[cuts].tolist()
                texts += np.frombuffer(names, np.int64)[row[cuts]].tolist()
                lost += [entry[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(row)])]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(lost, pa.binary())], names=["_t_id", "_t_hash", "_t_lost"])


def drop_lines(text: str, lost: np.ndarray) -> tuple[int, int, str]:
    """(lines, lines dropped, the rest) when all lines whose key hashes into ``lost`` go."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = line_spans(data, np.array([0, len(data)]))
    hashes, long = line_keys(data, starts, ends)
    gone = long & np.isin(hashes, lost)
    raw = data.tobytes()
    return len(starts), int(gone.sum()), b"\n".join(raw[starts[k] : ends[k]] for k in np.flatnonzero(~gone)).decode()


def duplicate_line_lists(docs: DataFrame) -> DataFrame:
    """``_t_id, _t_hash, _t_lost``: for each row that loses lines, its id, the hash of
    its text and the packed hashes of these lines.  Rows that agree in id and text agree in all."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    blocks = materialize(rows.mapInArrow(_blocks_of_lines, "block long, ids binary, texts binary, counts binary, hashes binary"), "lines")
    grouped = blocks.mapInArrow(_distinct, "h long, least long, greatest long, n long").groupBy("h").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))
    shared = materialize(grouped.filter("least < greatest").select("h", "least", "n"), "shared")
    shards = max(MIN_SHARDS, -(-shared.count() // SHARD_KEYS))
    shared = shared.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    index = shared.groupBy("shard").applyInArrow(_build, "shard int, kind int, block long, packed binary")  # about SHARD_KEYS rows each
    probes = blocks.select("block", "hashes").mapInArrow(_probes(shards), "shard int, kind int, block long, packed binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = index.unionByName(probes).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    answers = met.mapInArrow(_answers, "block long, hashes binary, owners binary")
    empty = F.lit(None).cast("binary")
    both = answers.select(F.lit(0).alias("kind"), "block", F.col("owners").alias("ids"), empty.alias("texts"), empty.alias("counts"), "hashes").unionByName(blocks.select(F.lit(1).alias("kind"), "block", "ids", "texts", "counts", "hashes"))
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_losses, "_t_id long, _t_hash long, _t_lost binary")


def deduplicate_lines(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Drop lines that an earlier document holds.

    ``docs`` has ``doc_id, text``.  Returns the columns named in ``keep`` and
    ``n_lines, n_dropped, kept`` (the text that stays) and ``kept_sha256`` (its digest), one
    row per input row.  Null and empty texts have one empty line; whole texts are
    read, however long.  Rows with equal ids are one document and lose the same
    lines, but keep those that they hold first; null ids are one document that comes
    after all others.  An empty table gives an empty one; further columns are
    ignored, and those in ``keep`` must not be named as results.
    """
    keep = keep or ["doc_id"]
    # By id and text: however many rows share an id, none but equal texts meet in a group, and one list stands for them.
    lists = materialize(duplicate_line_lists(docs), "losses").dropDuplicates(["_t_id", "_t_hash"])
    text = F.col("text").cast("string")
    sided = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_t_id"), F.xxhash64(text).alias("_t_hash"), text.alias("_t_text"))
    joined = sided.join(lists, ["_t_id", "_t_hash"], "left").select(*keep, "_t_text", "_t_lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column("_t_text").to_pylist(), batch.column("_t_lost").to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for text, packed in zip(texts, lost):
                text = text or ""
                if packed:
                    total, gone, text = drop_lines(text, np.frombuffer(packed, np.uint64))
                else:
                    total, gone = text.count("\n") + 1, 0
                n_lines.append(total)
                n_dropped.append(gone)
                kept.append(text)
            columns = [batch.column(i) for i in range(len(keep))]
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                names=[*keep, "n_lines", "n_dropped", "kept", "kept_sha256"],
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(run, f"{fields}, n_lines long, n_dropped long, kept string, kept_sha256 string")
