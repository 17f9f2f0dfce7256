"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A first part of the labelled rows teaches a lexicon of words and word beginnings (a
table of fixed size beside the fixed word list), a second part the trees, a third the
isotonic curve that turns the trees' margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.labels import fitting_labels, held_out
from orgloom.llm.storage import tidy, written

# Common words of abuse, and pronouns of the second person, in four languages.
ABUSE = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "clowns",
    "dumb", "fool", "jerk", "bastard", "bitch", "asshole", "crap", "shit", "fuck", "fucking", "retard", "hate", "ugly", "vermin", "filth", "kill",
    "dumm", "idioten", "arschloch", "scheisse", "scheiße", "abschaum", "versager", "trottel", "ekelhaft", "wertlos",
    "imbécile", "crétin", "connard", "salaud", "merde", "stupide", "minable", "ordure", "dégoûtant",
    "imbécil", "estúpido", "estúpida", "basura", "mierda", "asqueroso", "patético", "inútil", "escoria",
)
YOU = ("you", "your", "yours", "you're", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous",
       "votre", "tú", "ti", "usted", "ustedes", "vosotros", "vos")
# Characters that stand for letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")

BEGINNINGS = (5, 6, 7, 8, 10)  # bytes of a word
TABLE_BITS = 20
SAMPLE_ROWS = 8000
NEAR_WORDS = 5
NAMES = (
    "words", "abuse_rate", "abuse_count", "learnt_rate", "learnt_strong_rate", "learnt_strong_count", "learnt_most", "near_you_rate", "capitals",
    "capital_words", "exclaiming", "marks", "obfuscated", "disguised_abuse",
)
_OBFUSCATED = re.compile(r"(?=[^\s]*[A-Za-z])[^\s]*[A-Za-z][0-9@$!|*]+[A-Za-z][^\s]*")


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    raw, at = W.raw_column(pa.array(words))
    return np.sort(np.concatenate([W.words_of(raw, at[i:i + 2], W.NON_ALNUM, True).hash[:1] for i in range(len(words))]))


_ABUSE, _YOU = _hashes(tuple(w for w in ABUSE if "'" not in w)), _hashes(tuple(w for w in YOU if "'" not in w))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _slots(words: W.Words) -> list[np.ndarray]:
    """Table slots of each word and of its beginnings (of a shorter word: the word again)."""
    out = [words.hash]
    size = words.end - words.start
    for k in BEGINNINGS:
        out.append(np.where(size > k, W.beginnings(words, k), words.hash))
    return [(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for h in out]


def text_slots(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct slots of a text."""
    if not len(raw):
        return np.empty(0, np.int64)
    return np.unique(np.concatenate(_slots(W.words_of(raw, np.array([0, len(raw)]), W.NON_ALNUM, True))))


def learn_lexicon(rows: list[np.ndarray], y: np.ndarray, least: int = 4) -> np.ndarray:
    """Weight of each slot: the log-odds of label 1 where at least ``least`` rows of label 1 have it and it speaks clearly for it, else 0."""
    counts = np.zeros((2, 1 << TABLE_BITS))
    for slots, label in zip(rows, y):
        counts[label, slots] += 1
    odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / (len(y) - y.sum() + 1))
    return np.where((counts[1] >= least) & (odds > 1.5), odds, 0.0).astype(np.float32)


def features(raw: np.ndarray, lexicon: np.ndarray) -> list[float]:
    """The dense features of one text, in the order of NAMES."""
    if not len(raw):
        return [0.0] * len(NAMES)
    words = W.words_of(raw, np.array([0, len(raw)]), W.NON_ALNUM, True)
    n = len(words.hash)
    per = 1 / max(1, n)
    abuse, you = _among(words.hash, _ABUSE), _among(words.hash, _YOU)
    learnt = np.zeros(n, np.float32)
    for s in _slots(words):
        np.maximum(learnt, lexicon[s], out=learnt)
    strong = learnt > 2.5
    seen = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(abuse | strong)
    near = (seen[np.minimum(at + NEAR_WORDS + 1, n)] - seen[np.maximum(at - NEAR_WORDS, 0)]) > 0
    by_byte = np.bincount(raw, minlength=256)
    letters = by_byte[65:91].sum() + by_byte[97:123].sum()
    plain = W.words_of(raw, np.array([0, len(raw)]), W.NON_LETTERS, False)
    upper = np.concatenate([[0], np.cumsum((plain.data >= 65) & (plain.data <= 90))])
    size = plain.end - plain.start
    loud = ((upper[plain.end] - upper[plain.start]) == size) & (size > 1)
    marks = by_byte[[35, 36, 37, 38, 42, 64]].sum()
    odd = 0
    hidden = 0
    if marks + by_byte[48:58].sum() + by_byte[33] + by_byte[124]:
        for m in _OBFUSCATED.finditer(raw.tobytes().decode("utf-8", "replace")):
            odd += 1
            core = m[0].lower().translate(DISGUISE).strip(".,;:?*")
            hidden += core in ABUSE
    return [
        float(np.log1p(n)), abuse.sum() * per, float(np.log1p(abuse.sum())), float(learnt.sum()) * per, strong.sum() * per,
        float(np.log1p(strong.sum())), float(learnt.max(initial=0)), near.sum() * per, by_byte[65:91].sum() / max(1, letters),
        loud.sum() / max(1, len(size)), (by_byte[33] + by_byte[63]) * per, marks * per, odd * per, float(np.log1p(hidden)),
    ]


@dataclass
class Curve:
    """An increasing step-free curve through (margin, probability) points; constant beyond them."""

    margins: list[float]
    shares: list[float]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, rounds: int = 25, depth: int = 4,
) -> DataFrame:
    """One row per document row: ``id_col``, held_out, score, predicted.

    The lexicon is learnt from at most ``sample_rows`` labelled documents, the trees and the
    isotonic curve from all others; none of them is held out. Every whole text is
    scored; score is the calibrated probability of label 1, predicted is 1 from ``threshold`` on.

    A null or empty text has features of zero; null labels are left out; repeated rows
    are scored one by one; where the usable labels are all alike or missing, every score
    is their share of ones (1 / 2 without any); an empty table gives no rows; other columns are ignored.
    """
    usable = fitting_labels(labels, id_col, label_col).withColumn("third", F.pmod("turn", F.lit(10)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = usable.filter("third < 4").orderBy("turn", "id").limit(sample_rows)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            slots = [text_slots(raw[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch["turn"], batch["label"], pa.array(slots, pa.binary())], ["turn", "label", "slots"])

    chosen = rows.withColumn("id", F.col("id").cast("long")).join(F.broadcast(sample), "id").select("turn", "label", "text")
    got = chosen.mapInArrow(tidy(reduce), "turn bigint, label int, slots binary").orderBy("turn", "slots").limit(sample_rows).toArrow()
    lexicon = learn_lexicon([np.frombuffer(s, np.int32) for s in got["slots"].to_pylist()], got["label"].to_numpy().astype(np.int64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            found = [features(raw[a:b], lexicon) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.list_(pa.float64()))], ["id", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    described = written(rows.mapInArrow(tidy(describe), f"id {kind}, found array<double>"), "features")
    rest = described.join(usable.withColumnRenamed("id", "key"), F.col("id").cast("long") == F.col("key")).filter("third >= 4")
    rest = written(rest.select("third", "label", "found"), "labelled").withColumn("features", array_to_vector("found")).withColumn("label", F.col("label").cast("double"))
    seen = {(r.label, r.grown): r.n for r in rest.groupBy("label", (F.col("third") < 8).alias("grown")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, n = sum(c for (label, _), c in seen.items() if label == 1), sum(seen.values())
    if {k for k, c in seen.items() if c} != {(0.0, True), (1.0, True), (0.0, False), (1.0, False)}:
        scored = described.select("id", F.lit((ones + 1) / (n + 2)).alias("score"))
    else:
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, cacheNodeIds=False).fit(rest.filter("third < 8"))
        curve = _isotonic(trees, rest.filter("third >= 8"))
        margins, shares = np.array(curve.margins), np.array(curve.shares)

        def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.interp(batch["margin"].to_numpy(zero_copy_only=False), margins, shares)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score)], ["id", "score"])

        margin = _margin(trees, described.withColumn("features", array_to_vector("found"))).select("id", "margin")
        scored = margin.mapInArrow(tidy(calibrate), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])


def _isotonic(trees: GBTClassificationModel, rows: DataFrame, cells: int = 400) -> Curve:
    """The isotonic curve over the shares of label 1 in at most ``cells`` cells of the margin."""
    cell = F.least(F.greatest(F.floor((F.col("margin") + 2) * (cells / 4)), F.lit(0)), F.lit(cells - 1))
    grouped = _margin(trees, rows).groupBy(cell.alias("cell")).agg(
        F.avg("margin").alias("margin"), F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(grouped.coalesce(1))
    # a little of the overall share keeps the ends off 0 and 1, so that scores still tell margins apart
    points = sorted(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))
    shares = [min(max(0.002 + 0.996 * s + 1e-3 * np.tanh(m), 0.0), 1.0) for m, s in points]
    ends = [(-4.0, max(0.0, shares[0] - 1e-3)), (4.0, min(1.0, shares[-1] + 1e-3))]
    inner = list(zip([m for m, _ in points], shares))
    return Curve(*map(list, zip(*([ends[0]] + inner + [ends[1]]))))
