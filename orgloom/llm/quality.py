"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams (of its bytes, and of the shapes of its
words), hashed, scaled by the log-count ratio of the two classes; a linear hinge-loss model on them is fitted by dual coordinate
descent, and its margins are turned into probabilities by a logistic curve fitted
on rows that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.labels import fitting_labels, held_out
from orgloom.llm.storage import tidy

BITS = 18
BYTE_GRAM = 3
SHAPE_GRAMS = (1, 2, 3)
SAMPLE_ROWS = 6000

# Classes of bytes: lower letters and parts of non-ASCII ones, capitals, digits, full stop, comma, other marks.
_KIND = np.full(256, 5, np.uint8)
_KIND[97:123] = _KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[ord(".")] = 3
_KIND[ord(",")] = 4


def shapes(words: W.Words) -> np.ndarray:
    """A small number per word: case, digits, marks at its end, length class, and whether it repeats the word before it."""
    n = len(words.start)
    if not n:
        return np.empty(0, np.uint64)
    kind = _KIND[words.data]
    size = words.end - words.start
    count = lambda k: np.add.reduceat(np.append(kind == k, False).astype(np.int32), np.ravel(np.column_stack((words.start, words.end))))[::2]
    lower, upper, digit = count(0), count(1), count(2)
    last, prior = kind[words.end - 1], kind[np.maximum(words.end - 2, words.start)]
    case = np.where(upper == 0, 0, np.where((upper == 1) & (kind[words.start] == 1), 1, np.where(lower == 0, 2, 3)))
    again = np.zeros(n, bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    code = again * 2 + (digit > 0)
    code = code * 4 + case
    code = code * 6 + np.where(last < 2, 0, last)
    code = code * 2 + ((last > 2) & (prior > 2) & (size > 1))
    code = code * 3 + np.searchsorted([3, 10], size)
    return (code + 1).astype(np.uint64)


def indicators(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct slots of a text's byte n-grams and of the n-grams of its words' shapes."""
    mark = np.zeros(1 << BITS, bool)

    def add(symbols: np.ndarray, k: int, width: int, seed: int) -> None:
        n = len(symbols) - k + 1
        if n > 0:
            code = np.full(n, seed, np.uint64)
            for j in range(k):
                code = (code << np.uint64(width)) | symbols[j:n + j]
            code *= np.uint64(0x9E3779B97F4A7C15)
            mark[(code >> np.uint64(64 - BITS)).astype(np.int64)] = True

    for lo in range(0, len(raw), 1 << 20):  # very long texts in steps
        add(raw[lo:lo + (1 << 20) + BYTE_GRAM - 1].astype(np.uint64), BYTE_GRAM, 8, 1)
    if len(raw):
        shape = shapes(W.words_of(raw, np.array([0, len(raw)]), W.SPACES, False))
        for k in SHAPE_GRAMS:
            add(shape, k, 10, 1 + k)
    return np.flatnonzero(mark)


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, log-count ratio included
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.bias
        r = self.ratios[slots]
        return float(self.weights[slots].sum() / max(1e-9, np.sqrt(r @ r)) + self.bias)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for slots, label in zip(rows, y):
        counts[label, slots] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def _descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float, passes: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the classes' costs balance their sizes."""
    scaled = [ratios[s] / max(1e-9, np.sqrt(ratios[s] @ ratios[s])) for s in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = penalty * np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    alpha, w, bias = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    norm = np.array([x @ x for x in scaled]) + 1.0  # the bias is a feature of value 1
    order = np.random.default_rng(5)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slots, x = rows[i], scaled[i]
            gradient = sign[i] * (w[slots] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[slots] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratios, bias  # w counts per scaled feature


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve (Newton steps, targets drawn in by the class sizes)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, q = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[q @ margins**2 + 1e-3, q @ margins], [q @ margins, q.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, penalty: float = 1.0, passes: int = 8, folds: int = 3) -> Model:
    """A model of sparse indicator rows and their 0/1 labels. One class alone, or no rows, give a constant score."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        inner = [r for r, f in zip(rows, fold) if f != k]
        if len(set(y[fold != k].tolist())) == 2:
            ratios = _ratios(inner, y[fold != k])
            part = Model(*(lambda wb: (wb[0], ratios, wb[1]))(_descend(inner, y[fold != k], ratios, penalty, passes)), 1.0, 0.0)
            margins[fold == k] = [part.margin(r) for r, f in zip(rows, fold) if f == k]
    slope, shift = _logistic(margins, y)
    ratios = _ratios(rows, y)
    weights, bias = _descend(rows, y, ratios, penalty, passes)
    return Model(weights, ratios, bias, slope, shift)


def sampled_indicators(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The indicator rows and labels of at most ``rows`` labelled documents, chosen by a hash of the identifier."""
    sample = fitting_labels(labels, id_col, label_col).orderBy("turn", "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            slots = [indicators(raw[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch["turn"], batch["id"], batch["label"], pa.array(slots, pa.binary())], ["turn", "id", "label", "slots"])

    # the sample is bounded by ``rows``
    chosen = texts.join(F.broadcast(sample), "id").mapInArrow(tidy(reduce), "turn bigint, id bigint, label int, slots binary")
    got = chosen.orderBy("turn", "id", "slots").limit(rows).toArrow()
    return [np.frombuffer(s, np.int32) for s in got["slots"].to_pylist()], got["label"].to_numpy().astype(np.int64)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7,
) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted.

    The model is fitted on at most ``sample_rows`` labelled documents that are not
    held out; every whole text is scored. score is the probability of label 1, predicted is 1
    from ``threshold`` on. Columns of ``docs`` with those three names are replaced.

    A null or empty text has no features and gets the model's bias; null labels are
    left out; repeated rows are scored one by one; without usable labels all scores are
    the share (1 / 2); an empty table gives no rows.
    """
    model = fit(*sampled_indicators(docs, labels, id_col, text_col, label_col, sample_rows))
    kept = docs.drop("held_out", "score", "predicted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(pa.compute.cast(batch[text_col], pa.string()))
            scores = [model.score(indicators(raw[a:b])) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    schema = kept.withColumn("score", F.lit(0.0)).schema
    return kept.mapInArrow(tidy(score), schema).withColumns({
        "held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
