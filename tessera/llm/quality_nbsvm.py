"""Quality classifier: a linear hinge-loss model on naive Bayes features.

Indicators of hashed byte trigrams and word pairs are scaled by the log-ratio of their
counts in the two classes; a support vector machine on these features is fitted by dual
coordinate descent on a bounded sample of labelled rows, and its margin is
turned into a probability by a logistic fit.  Scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Buckets of hashed byte trigrams, and as many of hashed pairs of words.
BUCKETS = 1 << 15
FEATURES = 2 * BUCKETS
#: Rows whose features are marked at a time.
ROWS = 256
#: Labelled documents that training reads at most (chosen by a hash of the id); a documented bound.
MAX_TRAINING_DOCS = 4000
#: Added to both classes' counts.
SMOOTHING = 1.0
#: Upper bound of a dual variable; the rarer class gets the larger one.
COST = 1.0
EPOCHS = 30
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 20


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that ends at each byte; before a row's first byte stands byte 0, digits count as one."""
    x = data.astype(np.uint32)
    x[(data >= 0x30) & (data <= 0x39)] = 0x30
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[1:], two[2:] = x[:-1], x[:-2]
    starts = offsets[:-1][offsets[:-1] < len(x)]
    one[starts] = two[starts] = 0
    seconds = starts + 1
    two[seconds[seconds < len(x)]] = 0
    with np.errstate(over="ignore"):
        return (((two << np.uint32(16)) | (one << np.uint32(8)) | x) * np.uint32(0x85EBCA6B)) >> np.uint32(17)


def _word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs of consecutive words, and the row bounds among them; a single word is a pair."""
    starts, ends, first = tk.word_spans(data, offsets)
    hashes, bounds = tk.shingle_hashes(tk.span_hashes(tk.LOWERED[data], starts, ends), first, 2)
    return (hashes >> np.uint64(49)).astype(np.int64), bounds


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each feature present, ordered by row; rows are taken in
    groups so that the presence table stays small."""
    codes = _codes(data, offsets)
    n = len(offsets) - 1
    pairs, bounds = _word_pairs(data, offsets)
    rows, features = [], []
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        seen = np.zeros((b - a) * FEATURES, bool)
        seen[row * FEATURES + codes[offsets[a] : offsets[b]]] = True
        row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        seen[row * FEATURES + BUCKETS + pairs[bounds[a] : bounds[b]]] = True
        at = np.flatnonzero(seen)
        rows.append(at // FEATURES + a)
        features.append(at % FEATURES)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(features) if features else np.zeros(0, np.int64)


class QualityModel:
    """Log-count ratios and weights by feature, intercept, and the logistic map from margin to probability."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.ratios, self.weights, self.bias, self.slope, self.shift = ratios, weights, bias, slope, shift

    def margins(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Margins of the scaled indicators at unit length, as in training: short and long texts compare."""
        ratio = self.ratios[feature]
        length = np.sqrt(np.bincount(row, weights=ratio * ratio, minlength=n) + 1.0)
        return (np.bincount(row, weights=self.weights[feature] * ratio, minlength=n) + self.bias) / length

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        margin = self.margins(row, feature, n)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def fit(examples: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Fit on feature lists and 0/1 labels; without both classes, the constant share of label 1."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(y) or len(set(y)) < 2:
        share = float(np.clip((labels == 1).mean() if len(y) else 0.5, 0.01, 0.99))
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.full((2, FEATURES), SMOOTHING)
    for f, label in zip(examples, labels):
        counts[int(label == 1), f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts.sum(0) == 2 * SMOOTHING] = 0.0  # never seen
    values = [ratio[f] for f in examples]
    norms = np.array([np.sqrt(v @ v + 1.0) for v in values])
    values = [v / s for v, s in zip(values, norms)]  # unit length, so a long text is no outlier
    ones = 1.0 / norms
    share = (y > 0).mean()
    bound = np.where(y > 0, COST * 0.5 / share, COST * 0.5 / (1 - share)) * 10
    w, b, _ = dual_descent(examples, values, ones, y, bound)
    model = QualityModel(ratio, w, b, 1.0, 0.0)
    row = np.repeat(np.arange(len(examples)), [len(f) for f in examples])
    model.slope, model.shift = _logistic(model.margins(row, np.concatenate(examples), len(examples)), (y > 0).astype(float))
    return model


def dual_descent(examples: list[np.ndarray], values: list[np.ndarray], ones: np.ndarray, y: np.ndarray, bound: np.ndarray, epochs: int = EPOCHS, close: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Hinge-loss model of sparse examples of unit length (with ``ones``, their constant
    feature) by coordinate descent on the dual: (weights, intercept, dual variables)."""
    alpha, w, b = np.zeros(len(y)), np.zeros(FEATURES), 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f, v = examples[i], values[i]
            gradient = y[i] * (w[f] @ v + b * ones[i]) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), bound[i])  # the squared length is 1
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                b += step * ones[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < close:
            break
    return w, b, alpha


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's smoothed logistic fit of labels on margins, by Newton steps."""
    scale = np.abs(margin).mean() or 1.0
    x = margin / scale
    up = label.sum()
    goal = np.where(label == 1, (up + 1) / (up + 2), 1 / (len(label) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
        h = p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-6) / scale), float(b)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[bytes] = []
        for _, _, data, offsets in tk.blocks(batch.column("text"), BLOCK_BYTES):
            row, feature = indicators(data, offsets)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            found += [feature[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "features"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> QualityModel:
    """Fit on documents with a label, about ``max_docs`` of them at most.

    ``labels`` has ``doc_id, quality``; null labels and ids are left out, and
    of rows that repeat an id and a label the least text is used.  Without labelled
    documents the score is constant.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").distinct()
    n = known.count()
    share = min(1.0, max_docs / n) if n else 0.0
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1.0))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most about max_docs rows of 12 bytes are broadcast
    rows = sample.mapInArrow(_featurize, "doc_id long, quality int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    return fit([np.frombuffer(r["features"], np.uint16).astype(np.int64) for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """Score whole texts.

    Returns the columns named in ``keep`` and ``score`` (0 to 1, higher: label 1
    is likelier), one row per input row.  Null and empty texts have no features
    and get the score of the intercept.  Whole texts are scored, however long, and
    repeated rows each by itself.  An empty table gives an empty one, and further
    columns are ignored; those in ``keep`` must not be named as the result.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, model.weights, model.bias, model.slope, model.shift))  # 512 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = QualityModel(*shared.value)
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, data, offsets in tk.blocks(batch.column("_t_text"), BLOCK_BYTES):
                out.append(fitted.scores(*indicators(data, offsets), j - i))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out), pa.float64())], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("_t_text")).mapInArrow(run, f"{fields}, score double")
