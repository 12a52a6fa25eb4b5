"""Benchmark decontamination by BM25 with block-max pruning.

Test items are cut into chunks and indexed; weights are BM25 weights divided by
the score of the whole chunk, so that 1 means every term is there.  Each passage
of each document (windows of words that overlap so that any chunk lies whole in
one) is a query, and all chunks at or above the threshold are retrieved:

* frequent terms that cannot reach the threshold together are non-essential, so
  only essential terms open candidates (the pivot rule of WAND);
* windows, then blocks of chunks, then chunks are dropped when the sum of their
  maxima and the largest non-essential rest stay below the threshold.

Pruning uses upper bounds only: the result equals that of scoring everything.
Items whose parts lie apart reach no threshold in one window.  They are opened by
the rarest n-grams of their longer part: so many that no document that holds half
of the part's n-grams can lack all of them.  Opened and retrieved items count when
n-grams of both their question and their answer are found in the document, or a
short part of the two with few words edited.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Longest chunk, the distance of windows and their length, in words: a window is three steps.
CHUNK, STEP, STEPS = 48, 24, 3
K1, B = 1.2, 0.75
#: Share of a chunk's own score that a passage must reach.
SCORE = 0.6
#: Share of the question's and of the answer's n-grams that the document must hold.
OVERLAP = 0.5
GRAM = 3
#: Parts of at most ``SHORT`` words may instead be held with one edit in ``EDIT_EVERY``
#: words; parts of fewer words, but ``GRAM``, with one edit if n-grams show the other part.
SHORT, EDIT_EVERY = 24, 5
#: Words that an answer takes from the end of an item at least.
ANSWER_WORDS = 5
#: Chunks of an index block.
BLOCK = 16
#: Non-essential terms reach at most this share of any chunk's score.
REST = 0.35
#: Bytes of item text in one index; more items make several.
INDEX_BYTES = 16 << 20
#: Bytes of documents that a task takes through all indexes at a time, if there are several.
GROUP_BYTES = 64 << 20

_MATCH = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_ANSWER = re.compile(r"(?i)(?:\banswer\s*[:.\-]|^\s*a\s*:)", re.MULTILINE)


def _separators() -> np.ndarray:
    table = np.ones(256, bool)
    table[0x80:] = False
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(low) : ord(high) + 1] = False
    return table


SEPARATORS = _separators()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and non-ASCII bytes) and each row's first."""
    starts, ends, first = tk.word_spans(data, offsets, SEPARATORS)
    return tk.span_hashes(tk.LOWERED[data], starts, ends), first


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


def grams(words: np.ndarray, width: int = GRAM) -> np.ndarray:
    return np.unique(tk.shingle_hashes(words, np.array([0, len(words)]), width)[0])


def part_grams(text: str) -> tuple[np.ndarray, int, np.ndarray]:
    """n-grams of a question or an answer, their width and its words; a part of fewer than ``GRAM`` words is one n-gram."""
    words = _words(text)
    return grams(words), min(len(words), GRAM), words


def least_edits(part: np.ndarray, words: np.ndarray) -> int:
    """Least number of words to replace, insert or leave out so that ``part`` is a run of ``words``."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(part, 1):
        new = np.full(len(row), i)
        new[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at a mark for the answer, else after the last question
    mark, else before the last sentences that have ``ANSWER_WORDS`` words; an
    item that has no two parts is both."""
    found = list(_ANSWER.finditer(text))
    if found and len(_words(text[: found[-1].start()])) and len(_words(text[found[-1].end() :])):
        return text[: found[-1].start()], text[found[-1].end() :]
    at = text.rfind("?") + 1
    if at and len(_words(text[:at])) >= GRAM and len(_words(text[at:])) >= GRAM:
        return text[:at], text[at:]
    for m in reversed(list(re.finditer(r"[.!?]\s+|\n+", text))):
        if len(_words(text[m.end() :])) >= ANSWER_WORDS and len(_words(text[: m.start()])) >= GRAM:
            return text[: m.start() + 1], text[m.end() :]
    return text, text


def chunks_of(words: np.ndarray) -> list[np.ndarray]:
    """Runs of ``CHUNK`` words; a short tail is filled up with the words before it."""
    starts = range(0, len(words), CHUNK)
    return [words[max(0, len(words) - CHUNK) if a and len(words) - a < CHUNK // 4 else a :][:CHUNK] for a in starts]


class ChunkTotals(NamedTuple):
    """What weights need to know of all chunks: terms, chunks that hold each, number of chunks and of their words."""

    terms: np.ndarray
    counts: np.ndarray
    size: int
    words: int

    @classmethod
    def of(cls, texts: Iterable[str]) -> ChunkTotals:
        chunks = [c for text in texts for c in chunks_of(_words(text))]
        terms, counts = np.unique(np.concatenate([np.unique(c) for c in chunks] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(terms, counts, len(chunks), sum(map(len, chunks)))

    def plus(self, other: ChunkTotals) -> ChunkTotals:
        terms, at = np.unique(np.concatenate((self.terms, other.terms)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((self.counts, other.counts)), len(terms)).astype(np.int64)
        return ChunkTotals(terms, counts, self.size + other.size, self.words + other.words)


class ItemIndex:
    """Inverted index over chunks of test items."""

    def __init__(self, items: list[tuple[int | None, str]], totals: ChunkTotals | None = None):
        self.ids = [i for i, _ in items]
        self.questions, self.answers, chunks, owner = [], [], [], []
        for k, (_, text) in enumerate(items):
            question, answer = split_item(text)
            self.questions.append(part_grams(question))
            self.answers.append(part_grams(answer))
            words = _words(text)
            for part in chunks_of(words):
                chunks.append(np.unique(part, return_counts=True))
                owner.append(k)
        self.owner = np.array(owner, np.int64)
        self.size = len(chunks)
        self.terms = np.unique(np.concatenate([c[0] for c in chunks])) if chunks else np.zeros(0, np.uint64)
        lengths = np.array([c[1].sum() for c in chunks], float)
        term = np.concatenate([np.searchsorted(self.terms, c[0]) for c in chunks]) if chunks else np.zeros(0, np.int64)
        chunk = np.repeat(np.arange(self.size), [len(c[0]) for c in chunks]) if chunks else np.zeros(0, np.int64)
        tf = np.concatenate([c[1] for c in chunks]).astype(float) if chunks else np.zeros(0)
        df = np.bincount(term, minlength=len(self.terms))
        if totals is None:
            totals = ChunkTotals(self.terms, df, self.size, int(lengths.sum()))
        spread = totals.counts[np.searchsorted(totals.terms, self.terms)]
        idf = np.log(1 + (totals.size - spread + 0.5) / (spread + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[chunk] / max(totals.words / totals.size, 1.0))) if self.size else np.zeros(0)
        weight = weight / np.maximum(np.bincount(chunk, weight, self.size), 1e-12)[chunk] if self.size else weight
        order = np.lexsort((chunk, term))
        self.chunk, self.weight = chunk[order], weight[order]
        self.by_chunk, self.chunk_start = np.argsort(self.chunk, kind="stable"), np.searchsorted(np.sort(self.chunk), np.arange(self.size + 1))
        self.term = term[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(self.terms) else np.zeros(0)
        # The most frequent terms are non-essential as long as no chunk's share of them exceeds REST.
        self.essential = np.ones(len(self.terms), bool)
        self.rest = np.zeros(self.size)
        for t in np.argsort(-df, kind="stable"):
            own = slice(self.start[t], self.start[t + 1])
            if (self.rest[self.chunk[own]] + self.weight[own]).max() > REST:
                break
            self.rest[self.chunk[own]] += self.weight[own]
            self.essential[t] = False
        # Blocks of each list: (block, maximum, first and end posting).
        block = self.chunk // BLOCK
        head = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (term[order][1:] != term[order][:-1])))) if len(block) else np.zeros(0, np.int64)
        self.block, self.block_low = block[head], head
        self.block_high = np.concatenate((head[1:], [len(block)])).astype(np.int64)
        self.block_most = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.block_start = np.searchsorted(head, self.start)
        self.blocks = -(-self.size // BLOCK)
        self.block_rest = np.maximum.reduceat(self.rest, np.arange(0, self.size, BLOCK)) if self.size else np.zeros(0)
        self._index_openers()

    def _index_openers(self) -> None:
        """For each width the n-grams that open items: of the longer part so many of the
        rarest that a document without any of them holds less than ``OVERLAP`` of the part."""
        longer = [max(parts, key=lambda p: len(p[2])) for parts in zip(self.questions, self.answers)]
        self.openers = {}
        for width in sorted({w for _, w, _ in longer if w}):
            own = [(k, g) for k, (g, w, _) in enumerate(longer) if w == width]
            every, held = np.unique(np.concatenate([g for _, g in own]), return_counts=True)
            picked = []
            for k, g in own:
                rare = g[np.argsort(held[np.searchsorted(every, g)], kind="stable")]
                rare = rare[: len(g) - max(1, int(np.ceil(OVERLAP * len(g) - 1e-9))) + 1]
                picked.append((rare, np.full(len(rare), k)))
            h, item = (np.concatenate(x) for x in zip(*picked))
            by = np.argsort(h, kind="stable")
            hashes = np.unique(h)
            self.openers[width] = hashes, np.searchsorted(h[by], hashes), np.searchsorted(h[by], hashes, "right"), item[by]

    def candidates(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float | None]]:
        """What :meth:`retrieve` finds, and without a score all others that can hold half of both parts."""
        found: dict[tuple[int, int], float | None] = {}
        for width, (hashes, low, high, items) in self.openers.items():
            h, bounds = tk.shingle_hashes(words, first, width)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            place = np.flatnonzero(hashes[at] == h)
            source, posting = _expand(low[at[place]], high[at[place]])
            row = np.searchsorted(bounds, place, "right") - 1
            pairs = np.unique(row[source] * len(self.ids) + items[posting])
            found |= dict.fromkeys(zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist()))
        found |= {(r, k): s for r, k, s in self.retrieve(words, first)}
        return [(r, k, found[r, k]) for r, k in sorted(found)]

    def best_score(self, words: np.ndarray, k: int) -> float:
        """Best score of an item's chunks in any window."""
        best = 0.0
        for c in range(*np.searchsorted(self.owner, [k, k + 1])):
            own = self.by_chunk[self.chunk_start[c] : self.chunk_start[c + 1]]  # by term
            terms = self.terms[self.term[own]]
            at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
            place = np.flatnonzero(terms[at] == words)
            held = np.zeros((-(-len(words) // STEP) + STEPS - 1, len(terms)), bool)
            for later in range(STEPS):
                held[place // STEP + later, at[place]] = True
            best = max(best, float((held @ self.weight[own]).max()))
        return best

    def retrieve(self, words: np.ndarray, first: np.ndarray, threshold: float = SCORE) -> list[tuple[int, int, float]]:
        """(row, item, best score of its chunks in any window) for all that reach the threshold."""
        if not self.size or not len(words):
            return []
        slack = threshold - 1e-9
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == words)
        term = at[place]
        counts = np.diff(first)
        base = np.concatenate(([0], np.cumsum(-(-counts // STEP) + STEPS - 1)))  # steps of each row, and a gap
        row = np.searchsorted(first, place, "right") - 1
        step = base[row] + (place - first[row]) // STEP
        # Windows: three steps each; bounds from the essential terms in them.
        mass = np.bincount(step, np.where(self.essential[term], self.most[term], 0.0), int(base[-1]) + STEPS)
        bound = mass[:-2] + mass[1:-1] + mass[2:]
        window = np.flatnonzero(bound + self.block_rest.max() >= slack)
        if not len(window):
            return []
        low, high = np.searchsorted(step, window), np.searchsorted(step, window + STEPS)
        which, item = _expand(low, high)
        pair = np.unique(which * len(self.terms) + term[item])
        which, term = pair // len(self.terms), pair % len(self.terms)
        needs = self.essential[term]
        # Blocks, then chunks, that essential terms open.
        opened, entry = _expand(self.block_start[term[needs]], self.block_start[term[needs] + 1])
        opened = which[needs][opened]
        key = opened * self.blocks + self.block[entry]
        keys, inverse = np.unique(key, return_inverse=True)
        alive = (np.bincount(inverse, self.block_most[entry]) + self.block_rest[keys % self.blocks] >= slack)[inverse]
        opened, entry = opened[alive], entry[alive]
        source, posting = _expand(self.block_low[entry], self.block_high[entry])
        key = opened[source] * self.size + self.chunk[posting]
        keys, inverse = np.unique(key, return_inverse=True)
        score = np.bincount(inverse, self.weight[posting], len(keys))
        alive = score + self.rest[keys % self.size] >= slack if len(keys) else np.zeros(0, bool)
        keys, score = keys[alive], score[alive]
        if not len(keys):
            return []
        # Exact scores: add the non-essential terms of the windows that are left.
        left = ~needs & np.isin(which, keys // self.size)
        source, posting = _expand(self.start[term[left]], self.start[term[left] + 1])
        key = which[left][source] * self.size + self.chunk[posting]
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[spot] == key
        score += np.bincount(spot[same], self.weight[posting][same], len(keys))
        found = score >= slack
        rows = np.searchsorted(base, window[keys[found] // self.size], "right") - 1
        best: dict[tuple[int, int], float] = {}
        for r, k, s in zip(rows.tolist(), self.owner[keys[found] % self.size].tolist(), score[found].tolist()):
            best[r, k] = max(best.get((r, k), 0.0), s)
        return [(r, k, s) for (r, k), s in sorted(best.items())]

    def verified(self, words: np.ndarray, hits: list[tuple[int, float | None]], overlap: float = OVERLAP) -> list[tuple[int | None, float, float, float]]:
        """(item id, score, share of question, share of answer) of the items whose both parts the words hold."""
        own, out = {GRAM: grams(words)}, []

        def share(part: np.ndarray, width: int) -> float:
            if width not in own:
                own[width] = grams(words, width)
            return float(np.isin(part, own[width], assume_unique=True).mean()) if len(part) else 0.0

        for k, score in hits:
            parts = (self.questions[k], self.answers[k])
            held = [share(*part[:2]) for part in parts]
            shares = list(held)
            for i, (_, _, sequence) in enumerate(parts):
                n = len(sequence)
                if held[i] < overlap and n <= SHORT and (n >= EDIT_EVERY or n >= GRAM and held[1 - i] >= overlap):
                    edits = least_edits(sequence, words)
                    if edits <= max(1, n // EDIT_EVERY):
                        shares[i] = max(held[i], 1 - edits / n)
            if min(shares) >= overlap:
                out.append((self.ids[k], self.best_score(words, k) if score is None else score, *shares))
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges: (index of the range, member)."""
    n = high - low
    source = np.repeat(np.arange(len(n)), n)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + low[source]


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Find the test items that each document holds.

    ``docs`` has ``text``; ``benchmark`` has ``item_id, text``.  Returns the
    columns named in ``keep`` and ``matches``, an array of ``item_id, score,
    question_overlap, answer_overlap`` by item, one row per input row; the
    array is empty for clean documents, null and empty texts, and an empty
    benchmark.  A question or answer of fewer than ``GRAM`` words counts where
    all its words follow each other in the document, one of at most ``SHORT`` words
    also with an edit of one word in ``EDIT_EVERY``.  Items without words match
    nothing; repeated items count once; a null item id stays null.  The index is broadcast in parts of at most
    ``INDEX_BYTES`` of item text; a task holds one of them at a time and takes it to
    ``GROUP_BYTES`` of documents.  Long texts are read whole: parts of an item may lie
    apart in them.  Repeated rows and null ids of documents are judged each by itself, ties
    go by item, an empty table gives an empty one, and further columns of either table are ignored.
    """
    keep = keep or ["doc_id"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-2 * size // INDEX_BYTES)) if size > INDEX_BYTES else 1
    out = docs.select(*keep, F.col("text").cast("string").alias("_t_text"), F.array().cast(_MATCH).alias("matches"))
    parts = [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number) for number in range(passes)]
    # Weights come from all items, so that scores do not depend on the number of passes.
    totals = reduce(ChunkTotals.plus, (ChunkTotals.of(r["text"] for r in mine.select("text").collect()) for mine in parts)) if passes > 1 else None
    shared = []
    for mine in parts:
        index = ItemIndex(sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r)), totals)  # at most about INDEX_BYTES
        shared.append(docs.sparkSession.sparkContext.broadcast(index.__dict__))
        if passes > 1:
            _forget(shared[-1])
    return out.mapInArrow(_scanner(shared), out.schema).drop("_t_text")


def _forget(part: Broadcast) -> None:
    """Drops this process's copy of a broadcast value; its next use reads the file again."""
    part.__dict__.pop("_value", None)


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _search(known: ItemIndex, texts: pa.Array, matches: list[list[dict]]) -> None:
    """Adds to each row's matches the index's items that its text holds."""
    for i, _, data, offsets in tk.blocks(texts):
        words, first = words_of(data, offsets)
        hits: dict[int, list[tuple[int, float | None]]] = {}
        for r, k, s in known.candidates(words, first):
            hits.setdefault(r, []).append((k, s))
        for r, own in hits.items():
            names = ("item_id", "score", "question_overlap", "answer_overlap")
            matches[i + r] = matches[i + r] + [dict(zip(names, m)) for m in known.verified(words[first[r] : first[r + 1]], own)]


def _scanner(shared: list[Broadcast]):
    """One scan that walks the parts of the index one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, GROUP_BYTES if len(shared) > 1 else 0):
            matches = [batch.column("matches").to_pylist() for batch in group]
            for part in shared:
                known = ItemIndex.__new__(ItemIndex)
                known.__dict__.update(part.value)
                for batch, own in zip(group, matches):
                    _search(known, batch.column("_t_text"), own)
                if len(shared) > 1:
                    _forget(part)
            for batch, own in zip(group, matches):
                at = batch.schema.get_field_index("matches")
                own = [sorted(m, key=lambda x: (x["item_id"] is None, x["item_id"])) for m in own]
                yield batch.set_column(at, batch.schema.field(at), pa.array(own, batch.schema.field(at).type))

    return run
