"""Language identification of whole texts, by spans.

A word's score for a language is the sum of log-likelihoods of its byte
trigrams.  The script of a word (from ranges of code points) excludes the
languages that do not use it.  Viterbi decoding with a penalty for switching then
labels spans of mixed-language text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

TRIGRAMS = 1 << 16
#: Documents that training reads at most (chosen by a hash of the id); a documented bound.
MAX_TRAINING_DOCS = 8000
#: Cost of changing the language between two words, in nats.
SWITCH_PENALTY = 12.0
#: A word counts at most so much against a language that uses its script, and so much
#: against any other: more than it costs to leave a language for one word.
WORST_WORD, EXCLUDED = 6.0, 60.0
#: Words after which a long text may be cut, and those in which a language has to take the lead.
PIECE, WINDOW = 512, 64
#: A language uses a script if at least this share of its training words does.
SCRIPT_SHARE = 0.01
#: Bytes of text decoded at a time.
BLOCK_BYTES = 2 << 20

#: Scripts by code points (end exclusive), as in the public blocks of Unicode.
SCRIPT_RANGES = (
    ("latin", 0x41, 0x5B), ("latin", 0x61, 0x7B), ("latin", 0xC0, 0xD7), ("latin", 0xD8, 0xF7), ("latin", 0xF8, 0x250), ("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530),
    ("armenian", 0x530, 0x590), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x700), ("arabic", 0x750, 0x780), ("devanagari", 0x900, 0x980), ("bengali", 0x980, 0xA00),
    ("gurmukhi", 0xA00, 0xA80), ("gujarati", 0xA80, 0xB00), ("oriya", 0xB00, 0xB80), ("tamil", 0xB80, 0xC00), ("telugu", 0xC00, 0xC80), ("kannada", 0xC80, 0xD00),
    ("malayalam", 0xD00, 0xD80), ("sinhala", 0xD80, 0xE00), ("thai", 0xE00, 0xE80), ("lao", 0xE80, 0xF00), ("tibetan", 0xF00, 0x1000), ("burmese", 0x1000, 0x10A0),
    ("georgian", 0x10A0, 0x1100), ("hangul", 0x1100, 0x1200), ("ethiopic", 0x1200, 0x13A0), ("khmer", 0x1780, 0x1800), ("mongolian", 0x1800, 0x18B0), ("latin", 0x1E00, 0x1F00),
    ("greek", 0x1F00, 0x2000), ("kana", 0x3040, 0x3100), ("hangul", 0x3130, 0x3190), ("han", 0x3400, 0x4DC0), ("han", 0x4E00, 0xA000), ("hangul", 0xAC00, 0xD7B0),
    ("han", 0xF900, 0xFB00), ("arabic", 0xFB50, 0xFE00), ("arabic", 0xFE70, 0xFF00), ("kana", 0xFF66, 0xFFA0), ("han", 0x20000, 0x40000),
)


def _script_tables() -> tuple[list[str], np.ndarray, np.ndarray]:
    names = ["none", *dict.fromkeys(r[0] for r in SCRIPT_RANGES)]
    scripts = np.zeros(0x110000, np.uint8)
    for name, low, high in SCRIPT_RANGES:
        scripts[low:high] = names.index(name)
    letters = np.full(256, 0x20, np.uint8)
    letters[0x80:] = np.arange(0x80, 0x100)
    for low, high in ((ord("A"), ord("Z") + 1), (ord("a"), ord("z") + 1)):
        letters[low:high] = np.arange(low, high) | 0x20
    return names, scripts, letters


SCRIPTS, SCRIPT_OF, LETTER_OF = _script_tables()


def scripts_of(data: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each byte of UTF-8; 0 at its further bytes."""
    out = SCRIPT_OF[:256][data]
    out[data >= 0x80] = 0
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF5, 0x07, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        point = padded[at].astype(np.int64) & bits
        for k in range(1, more + 1):
            point = point << 6 | padded[at + k] & 0x3F
        out[at] = SCRIPT_OF[np.minimum(point, len(SCRIPT_OF) - 1)]
    return out


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code of the three letters that end at each byte; what is no letter is a space."""
    x = LETTER_OF[data].astype(np.uint32)
    one, two = np.full_like(x, 0x20), np.full_like(x, 0x20)
    one[1:], two[2:] = x[:-1], x[:-2]
    starts = offsets[:-1][offsets[:-1] < len(x)]
    one[starts] = two[starts] = 0x20
    seconds = starts + 1
    two[seconds[seconds < len(x)]] = 0x20
    with np.errstate(over="ignore"):
        return (((two << np.uint32(16)) | (one << np.uint32(8)) | x) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trigrams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, data, offsets in tk.blocks(batch.column("text"), BLOCK_BYTES):
            codes = trigram_codes(data, offsets)
            starts, _, first = tk.word_spans(data, offsets)
            script = np.maximum.reduceat(scripts_of(data), starts) if len(starts) else np.zeros(0, np.uint8)
            for r in range(j - i):
                lang = langs[i + r]
                if lang not in trigrams:
                    trigrams[lang], scripts[lang] = np.zeros(TRIGRAMS, np.int64), np.zeros(len(SCRIPTS), np.int64)
                trigrams[lang] += np.bincount(codes[offsets[r] : offsets[r + 1]], minlength=TRIGRAMS)
                scripts[lang] += np.bincount(script[first[r] : first[r + 1]], minlength=len(SCRIPTS))
    if trigrams:
        names = sorted(trigrams)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array(names, pa.string()),
            "trigrams": pa.array([trigrams[x].astype(np.uint32).tobytes() for x in names], pa.binary()),
            "scripts": pa.array([scripts[x].astype(np.int64).tobytes() for x in names], pa.binary()),
        })


class LanguageModel:
    """Log-likelihoods by language and the scripts each language uses."""

    def __init__(self, languages: list[str], trigrams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = trigrams.sum(1, keepdims=True)
        self.table = np.log((trigrams + 0.5) / (totals + 0.5 * TRIGRAMS)).astype(np.float32) if languages else np.zeros((0, TRIGRAMS), np.float32)
        used = scripts / np.maximum(scripts[:, 1:].sum(1, keepdims=True), 1)
        self.uses = used >= SCRIPT_SHARE  # by language and script
        self.uses[:, 0] = True
        if languages:
            self.uses[:, ~self.uses.any(0)] = True  # a script that no language uses tells nothing

    def word_scores(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, at most 0 with 0 for the best; whether the word has letters."""
        script = np.maximum.reduceat(scripts_of(data), starts)
        codes = trigram_codes(data, offsets)
        present = np.flatnonzero(np.bincount(script, minlength=len(SCRIPTS)))
        scores = np.full((len(starts), len(self.languages)), -np.inf, np.float32)
        for k in range(len(self.languages)):
            if self.uses[k, present].any():
                scores[:, k] = np.add.reduceat(self.table[k][codes], starts)
        permitted = self.uses[:, script].T
        scores[~permitted] = -np.inf
        scores -= scores.max(1, keepdims=True)
        np.maximum(scores, -WORST_WORD, out=scores)
        scores[~permitted] = -EXCLUDED
        scores[script == 0] = 0
        return scores, script > 0

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most likely language of each word under the switching penalty."""
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        sums = np.zeros((len(scores) + 1, scores.shape[1]))
        np.cumsum(scores, axis=0, out=sums[1:])
        total = sums[first[1:]] - sums[first[:-1]]
        best = total.argmax(1)
        out = best[row].astype(np.uint8 if scores.shape[1] < 256 else np.int32)
        # Where no stretch favours another language by over half the penalty, no path with a switch can win.
        open_rows = np.zeros(len(counts), bool)
        ahead = scores - scores[np.arange(len(scores)), best[row]][:, None]
        far = 2.0 * EXCLUDED * (len(scores) + 1)
        for k in range(scores.shape[1]):
            gain = np.concatenate(([0.0], np.cumsum(ahead[:, k], dtype=np.float64)))
            level, base = gain[1:] - far * row, gain[:-1] - far * row
            rise = level - np.minimum.accumulate(base)
            open_rows[row[rise > SWITCH_PENALTY / 2]] = True
        rows = np.flatnonzero(open_rows)
        if len(rows):
            self._viterbi(scores, *self._pieces(scores, first, rows), out)
        return out

    @staticmethod
    def _pieces(scores: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, language before, language of the last word) of the pieces in which
        the rows can be decoded apart; -1: free.

        A row is cut in the middle of a window if every best path is in one language
        there.  A path that is not could take that language for the stretch of the window
        around the middle in which it is elsewhere: this gains the stretch's lead over the best
        of the others, saves a switch at each end of the stretch inside the window, and
        costs one at each end where the stretch goes on outside.
        """
        ends = [np.arange(first[r] + PIECE - 1, first[r + 1] - WINDOW // 2, PIECE) for r in rows]
        at = np.concatenate(ends)
        middle = WINDOW // 2 - 1  # the place of ``at`` in its window
        window = scores[at[:, None] - middle + np.arange(WINDOW)].astype(np.float64)
        lead = window.sum(1).argmax(1)
        own = np.take_along_axis(window, lead[:, None, None], 2)[:, :, 0]
        np.put_along_axis(window, lead[:, None, None], -np.inf, 2)
        sums = np.cumsum(own - window.max(2), axis=1)
        after, before = sums[:, middle:].min(1), np.maximum(sums[:, :middle].max(1), 0.0)
        sure = (sums[:, -1] > 2 * SWITCH_PENALTY) & (after > 0) & (sums[:, -1] > before) & (after - before > -2 * SWITCH_PENALTY)
        at, lead = at[sure], lead[sure]
        begins = np.concatenate((first[rows], at + 1))
        before = np.concatenate((np.full(len(rows), -1), lead))
        stops = np.concatenate((first[rows + 1], at + 1))
        last = np.concatenate((np.full(len(rows), -1), lead))
        # Pieces in order of their place: begins and stops sort alike.
        order, other = np.argsort(begins), np.argsort(stops)
        return begins[order], stops[other], before[order], last[other]

    @staticmethod
    def _viterbi(scores: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """Decode pieces in step, the longest first; writes their labels into ``out``."""
        order = np.argsort(begins - ends, kind="stable")
        begin, length, before, last = begins[order], (ends - begins)[order], before[order], last[order]
        active = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than t
        own = np.arange(scores.shape[1], dtype=out.dtype)
        known = (before[:, None] >= 0) & (own[None, :] != before[:, None])
        state = scores[begin].astype(np.float64) - SWITCH_PENALTY * known
        came = np.zeros(scores.shape, out.dtype)
        for t in range(1, int(length[0])):
            n = int(active[t])
            now = state[:n]
            top = now.argmax(1)
            moved = now[np.arange(n), top][:, None] - SWITCH_PENALTY
            switch = moved > now
            at = begin[:n] + t
            came[at] = np.where(switch, top[:, None].astype(out.dtype), own)
            state[:n] = np.where(switch, moved, now) + scores[at]
        label = np.where(last >= 0, last, state.argmax(1))
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(active[t])
            at = begin[:n] + t
            out[at] = label[:n]
            label[:n] = came[at, label[:n]] if t else label[:n]


def train(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> LanguageModel:
    """Fit on rows of ``doc_id, text, lang`` with a language, about ``max_docs`` of them at
    most; of rows that repeat an id, or have none, one is used."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    n = labelled.count()
    share = min(1.0, max_docs / n) if n else 0.0
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1.0))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("own")).select("own.*")  # one of rows that repeat an id
    rows = sample.repartition(8).mapInArrow(_count, "lang string, trigrams binary, scripts binary").collect()  # at most 8 rows a language
    names = sorted({r["lang"] for r in rows})
    trigrams, scripts = np.zeros((len(names), TRIGRAMS), np.int64), np.zeros((len(names), len(SCRIPTS)), np.int64)
    for r in rows:
        k = names.index(r["lang"])
        trigrams[k] += np.frombuffer(r["trigrams"], np.uint32)
        scripts[k] += np.frombuffer(r["scripts"], np.int64)
    return LanguageModel(names, trigrams, scripts)


def _has_letter(data: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script: settled by bytes where an ASCII or
    listed letter shows, else by decoding the row."""
    plain = np.concatenate(([0], np.cumsum((data < 0x80) & (SCRIPT_OF[:256][data] == 1))))
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for r in np.flatnonzero(~found & some):
        text = bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace")
        found[r] = any(c.isalpha() for c in text)
    return found


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Label whole texts.

    Returns the columns named in ``keep`` and ``lang_pred, score, spans``, one
    row per input row.  ``lang_pred`` holds the most words of the decoded spans
    (of equal ones the first by name) and ``score`` is its share of the words
    that have letters.  ``und`` with score 0 for null texts, texts without any
    letter, and if no language was learned.  ``spans`` lists
    ``[first word, end word, language]`` as JSON for mixed texts, else is null.
    Texts are decoded whole; long ones in pieces, cut where the cut cannot change the
    result.  Repeated rows are judged each by itself, an empty table gives an empty one,
    and further columns are ignored; those in ``keep`` must not be named as results.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.uses))  # 256 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = LanguageModel.__new__(LanguageModel)
        fitted.languages, fitted.table, fitted.uses = shared.value
        for batch in batches:
            preds, shares, spans = [], [], []
            for _, _, data, offsets in tk.blocks(batch.column("_t_text"), BLOCK_BYTES):
                n = len(offsets) - 1
                starts, _, first = tk.word_spans(data, offsets)
                pred, share, mixed = np.full(n, -1), np.zeros(n), [None] * n
                if len(starts) and fitted.languages:
                    scores, counted = fitted.word_scores(data, offsets, starts)
                    label = fitted.labels(scores, first)
                    row = np.repeat(np.arange(n), np.diff(first))
                    votes = np.bincount(row[counted] * len(fitted.languages) + label[counted], minlength=n * len(fitted.languages)).reshape(n, -1)
                    words = votes.sum(1)
                    every = np.bincount(row * len(fitted.languages) + label, minlength=n * len(fitted.languages)).reshape(n, -1)
                    pred = np.where(words > 0, votes.argmax(1), every.argmax(1))
                    share = np.where(words > 0, votes.max(1) / np.maximum(words, 1), 0.0)
                    pred[~_has_letter(data, offsets, np.diff(first) > 0)] = -1
                    share[pred < 0] = 0
                    change = np.flatnonzero((label[1:] != label[:-1]) & (row[1:] == row[:-1])) + 1
                    for r in np.unique(row[change]) if len(change) else ():
                        cuts = [first[r], *change[row[change] == r], first[r + 1]]
                        mixed[r] = json.dumps([[int(a - first[r]), int(b - first[r]), fitted.languages[label[a]]] for a, b in zip(cuts, cuts[1:])])
                preds += [fitted.languages[p] if p >= 0 else "und" for p in pred]
                shares.append(share)
                spans += mixed
            columns = [batch.column(i) for i in range(len(keep))]
            score = pa.array(np.concatenate(shares) if shares else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(preds, pa.string()), score, pa.array(spans, pa.string())], names=[*keep, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("_t_text")).mapInArrow(run, f"{fields}, lang_pred string, score double, spans string")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
