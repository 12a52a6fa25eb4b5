"""Secret scan: fixed patterns, and a guess-cost dynamic programme for values in credential context.

The cost of guessing a value is the least total, in bits, over all ways to cut
it into words, dates, repeats, sequences, keyboard walks and brute-force
characters.  A value that follows a credential's name and costs at least
``MIN_BITS`` is a secret even if no fixed pattern fits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Collection, Iterator, Mapping
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

KINDS = ("assign", "access", "hex", "guess")

#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Names after which a value is weighed, wider than the base pattern's.  A value in
#: quotes reaches to the same quote on its line; any other ends at a mark or a space.
CONTEXT = re.compile(
    r"""(?i:(?<![a-z])(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth(?:orization)?))["']?[ \t]*(?:[:=]|=>|:=)[ \t]*(?:"(?i:(?:bearer|basic)[ \t]+)?([^"\r\n]{6,}+)"(?!\w)|'(?i:(?:bearer|basic)[ \t]+)?([^'\r\n]{6,}+)'(?!\w)|["']?(?i:(?:bearer|basic)[ \t]+)?([^\s"'<>,;]{6,}))""",
    re.ASCII,
)
#: Lower-case bytes of which a text with a credential context has one.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"key", b"credential", b"auth")

#: A value that costs less is a placeholder or a weak word rather than a secret.
MIN_BITS = 34.0
#: Cost of each segment that is not a brute-force character.
SEGMENT_BITS = 1.0
LONGEST_WORD, SHORTEST_WORD = 24, 3
#: Sequences, walks and repeats are cut after at most so many characters, or at their end.
LONGEST_RUN = 32
#: Words of the corpus that guessers are taken to try, the most frequent by documents
#: first, and the least number of documents that hold one.
DICTIONARY, LEAST_DOCUMENTS = 50_000, 2

#: Words that guessers try first, most common first.
COMMON_WORDS = (
    "password passwd secret token key admin root user login test example changeme default letmein welcome "
    "qwerty monkey dragon master shadow sunshine princess football baseball iloveyou trustno superman batman "
    "access hello world guest public private demo sample your here none null true false value string api "
    "server client database mysql postgres oracle spring summer autumn winter monday friday january december "
    "love god money pass temp dummy placeholder insert redacted hidden xxxx hunter correct horse battery staple"
).split()
#: Rows of a US keyboard, as they lie under each other.
KEY_ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
LEET = str.maketrans("@4013$5!7", "aaoiessit")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d", re.ASCII)

WORD = re.compile(r"[^\W\d_]{3,24}")


KEY_AT = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row) if c != " "}
NEIGHBOURS = {(a, b) for a, (x, y) in KEY_AT.items() for b, (u, v) in KEY_AT.items() if a != b and abs(y - v) <= 1 and -1 <= u - x <= 1}
RANK_BITS = {w: log2(i + 2) for i, w in enumerate(COMMON_WORDS)}
#: Bits of the first key of a walk, of a year and of a day.
KEY_BITS, YEAR_BITS, DAY_BITS = log2(47), log2(130), log2(130 * 365) + 2.0


def _character_bits(c: str) -> float:
    if c.isascii():
        return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)
    return 12.0


def _run_ends(n: int, holds) -> list[int]:
    """For each start the end of the longest run in which ``holds(i)`` joins i to i + 1."""
    ends = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if holds(i):
            ends[i] = ends[i + 1]
    return ends


def _stops(start: int, end: int, step: int = 1, least: int = 3) -> list[int]:
    """Ends of the segments of a run: up to ``LONGEST_RUN`` characters, or the whole rest of the run."""
    stops = [j for j in range(start + step, min(end, start + LONGEST_RUN) + 1, step) if j - start >= least]
    if end - start > LONGEST_RUN:
        stops.append(end)
    return stops


def guess_bits(value: str, words: Collection[str] | None = None, ranks: Mapping[str, float] = RANK_BITS) -> float:
    """Least cost of guessing ``value``, in bits, over all segmentations; linear in its length.

    ``words`` are further words that a guesser would try, such as those of the
    surrounding text; ``ranks`` gives the bits of the words of a ranked list.  The
    empty value costs nothing.
    """
    n = len(value)
    lower = value.lower()
    if len(lower) != n:  # a few capitals change their length
        lower = value
    plain = lower.translate(LEET)
    extra = 1.0 + log2(len(words) + len(ranks) + 1) if words else 0.0
    bits_of = [_character_bits(c) for c in value]
    code = [ord(c) for c in value]
    up = _run_ends(n, lambda i: code[i + 1] - code[i] == 1)
    down = _run_ends(n, lambda i: code[i] - code[i + 1] == 1)
    walk = _run_ends(n, lambda i: (lower[i], lower[i + 1]) in NEIGHBOURS)
    # turns[k]: changes of direction of walks at the characters before k.
    place = [KEY_AT.get(c, (0, 0)) for c in lower]
    move = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(place, place[1:])]
    turns = [0, 0, *accumulate(a != b for a, b in zip(move, move[1:]))]
    same = {p: _matches(value, p) for p in range(1, 5)}
    dates: dict[int, int] = {m.start(): m.end() for m in DATE.finditer(value)}
    best = [0.0] + [float("inf")] * n
    for i in range(n):
        have = best[i]

        def offer(j: int, bits: float, have: float = have) -> None:
            if have + bits < best[j]:
                best[j] = have + bits

        offer(i + 1, bits_of[i])
        for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
            for word, changed in ((lower[i:j], 0.0), (plain[i:j], 1.5)):
                bits = ranks.get(word)
                if bits is None and words and word in words:
                    bits = extra
                if bits is not None:
                    capitals = sum(c.isupper() for c in value[i:j])
                    offer(j, SEGMENT_BITS + bits + changed + (0.0 if not capitals else 1.0 if capitals in (1, j - i) else min(capitals, j - i - capitals) * 1.5 + 1.0))
        for ends in (up, down):
            if ends[i] - i >= 3:
                for j in _stops(i, ends[i]):
                    offer(j, SEGMENT_BITS + bits_of[i] + 1.0 + log2(j - i))
        if walk[i] - i >= 3:
            for j in _stops(i, walk[i]):
                offer(j, SEGMENT_BITS + KEY_BITS + log2(j - i) + 2.0 * (turns[j - 1] - turns[i + 1]))
        if i in dates:
            offer(dates[i], SEGMENT_BITS + (YEAR_BITS if dates[i] - i == 4 else DAY_BITS))
        for p, run in same.items():
            if run[i] >= p:
                unit = sum(bits_of[i : i + p])
                for j in _stops(i, i + (run[i] + p) // p * p, p, max(2 * p, 3)):
                    offer(j, SEGMENT_BITS + unit + log2((j - i) // p))
    return best[n]


def _matches(value: str, p: int) -> list[int]:
    """For each i, how many characters from i on equal the ones p further."""
    n = len(value)
    run = [0] * (n + 1)
    for i in range(n - p - 1, -1, -1):
        run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
    return run


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


class _Elsewhere:
    """Words that a text holds more often than one of its values does."""

    def __init__(self, counts: Counter, own: Counter):
        self.counts, self.own = counts, own

    def __contains__(self, word: str) -> bool:
        return self.counts[word] > self.own[word]

    def __len__(self) -> int:
        return len(self.counts)


def _word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def credential_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in credential context."""
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while m.lastindex == 3 and end > start and text[end - 1] in ".!?)]}":
            end -= 1
        if end - start >= 6:
            out.append((start, end))
    return out


def guess_spans(text: str, ranks: Mapping[str, float] = RANK_BITS) -> list[tuple[int, int, int]]:
    """Values in credential context that are costly to guess; the span is the value alone."""
    values = credential_values(text)
    counts = _word_counts(text) if values else Counter()
    return [(a, 3, b) for a, b in values if guess_bits(text[a:b], _Elsewhere(counts, _word_counts(text[a:b])), ranks) >= MIN_BITS]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[[*b"0123456789abcdef"]] = True
_EQUALS = np.zeros(256, bool)
_EQUALS[[*b":="]] = True
NO_SPANS = hashlib.sha256(b"").hexdigest()


def candidate_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a block that may hold any span; all others certainly hold none."""
    found: list[np.ndarray] = []
    breaks = np.concatenate(([-1], np.flatnonzero(~_HEXADECIMAL[data]), [len(data)]))
    long = np.flatnonzero(np.diff(breaks) > MIN_HEX)
    for a, b in zip(breaks[long] + 1, breaks[long + 1]):  # a run may reach over several rows
        found.append(np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")))
    sets = np.concatenate(([0], np.cumsum(_EQUALS[data])))
    assigns = sets[offsets[1:]] > sets[offsets[:-1]]
    for hints, among, plain in ((HINTS, assigns, tk.LOWERED[data].tobytes()), ((b"AKIA",), np.ones(len(assigns), bool), data.tobytes())):
        for hint in hints:
            at = plain.find(hint)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if among[row]:
                    found.append(np.array([row]))
                at = plain.find(hint, max(at + 1, int(offsets[row + 1])))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _letters() -> np.ndarray:
    """Bytes that part words: all ASCII but letters."""
    table = np.ones(256, bool)
    table[0x80:] = False
    for low, high in (("A", "Z"), ("a", "z")):
        table[ord(low) : ord(high) + 1] = False
    return table


_PARTS_WORDS = _letters()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each block outside of secrets and credential values, with the number of its documents that hold them."""
    for batch in batches:
        for _, _, data, offsets in tk.blocks(batch.column("_t_text")):
            data = tk.LOWERED[data]
            for r in candidate_rows(data, offsets):
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
                for a, b in [*credential_values(text), *((a, b) for a, _, b in base_spans(text))]:
                    at = offsets[r] + len(text[:a].encode())
                    data[at : at + len(text[a:b].encode())] = 0x20
            starts, ends, first = tk.word_spans(data, offsets, _PARTS_WORDS)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            fit = (ends - starts >= SHORTEST_WORD) & (ends - starts <= 4 * LONGEST_WORD)
            starts, ends, row = starts[fit], ends[fit], row[fit]
            if not len(starts):
                continue
            hashes = tk.span_hashes(data, starts, ends)
            order = np.lexsort((row, hashes))
            h, r = hashes[order], row[order]
            new_word = np.concatenate(([True], h[1:] != h[:-1]))
            new_pair = new_word | np.concatenate(([True], r[1:] != r[:-1]))
            counts = np.add.reduceat(new_pair.astype(np.int64), np.flatnonzero(new_word))
            words = [data[a:b].tobytes() for a, b in zip(starts[order][new_word], ends[order][new_word])]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "n"])


def ranked_words(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> dict[str, float]:
    """Bits of the ``most`` words that the most texts hold, at least ``least``, and of the common
    ones.  Words are counted over all texts, apart from secrets and credential values, so that a
    secret in many copies does not become a word.  Equal counts rank by the word."""
    counted = docs.select(F.col("text").cast("string").alias("_t_text")).mapInArrow(_count_words, "word binary, n long")
    word = F.lower(F.col("word").cast("string"))
    sums = counted.groupBy("word").agg(F.sum("n").alias("n")).select(word.alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    fit = sums.filter((F.col("n") >= least) & F.length("word").between(SHORTEST_WORD, LONGEST_WORD))
    rows = fit.orderBy(F.desc("n"), "word").limit(most).collect()  # at most ``most`` words
    return {r["word"]: log2(i + 2) for i, r in reversed(list(enumerate(rows, len(COMMON_WORDS))))} | RANK_BITS


def scan(docs: DataFrame, keep: list[str] | None = None, ranks: Mapping[str, float] = RANK_BITS) -> DataFrame:
    """Find secrets in whole texts.

    ``ranks`` gives the bits of dictionary words, such as :func:`ranked_words`.
    Returns the columns named in ``keep`` and ``n_assign, n_access, n_hex,
    n_guess, base_sha256, spans``, one row per input row.  Positions are code
    points.  Null and empty texts have no spans.  A text is read as a whole in one
    task, in time linear in its length.  Repeated rows are judged each by itself, an empty table
    gives an empty one, and further columns are ignored; those in ``keep`` must not have the names of results.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks))  # at most DICTIONARY words, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            digest, spans = [NO_SPANS] * n, [""] * n
            for first, _, data, offsets in tk.blocks(batch.column("_t_text")):
                for r in candidate_rows(data, offsets):
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    every = sorted(base + guess_spans(text, shared.value))
                    for _, kind, _ in every:
                        counts[kind, first + r] += 1
                    digest[first + r] = hashlib.sha256(_written(base).encode()).hexdigest()
                    spans[first + r] = _written(every)
            columns = [batch.column(i) for i in range(len(keep))]
            arrays = [*columns, *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("_t_text")).mapInArrow(run, f"{fields}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
