"""Severity of toxic texts by cumulative-link ordinal regression.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector for all grades and ordered thresholds between them.
The features are words and the first four to six letters of words that labelled documents of higher grades
use more (a bounded number, chosen by a z-score of document counts). The model is fitted on a bounded
sample of the labelled rows; all documents are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import AT_ONCE, slices, staged

SAMPLE_ROWS = 20_000
FEATURES = 512
LEAST_Z = 3.0
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    return tuple({word} | {f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n})


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, texts, known: Known | None = None) -> np.ndarray:
        """P(grade <= k) for each text and each grade but the last; only the features that a text has enter. known: the features of words seen before."""
        known = Known(self.features) if known is None else known
        score = np.array([sum(self.weights[f] * np.log1p(n) for f, n in sorted(counted(t, known).items())) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def counted(text: str | None, known: dict[str, tuple[int, ...]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for found in map(known.get, LETTERS.findall((text or "").lower())):
        for f in found or ():
            out[f] = out.get(f, 0) + 1
    return out


class Known(dict):
    """The features of a word, kept for words seen lately."""

    def __init__(self, features: dict[str, int]):
        self.features = features

    def get(self, word: str):
        found = super().get(word)
        if found is None:
            if len(self) > 1 << 18:
                self.clear()
            found = self[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
        return found


def fit_ordinal(x: np.ndarray, grade: np.ndarray, times: np.ndarray, grades: int, l2: float = 1e-5, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of largest penalised likelihood, by gradient steps (Adam) from a fixed start; row k counts times[k] times.

    The thresholds are a first one and positive gaps (their logarithms are fitted), so they stay in order.
    """
    n, m = times.sum(), x.shape[1]
    share = np.clip(np.array([times[grade <= k].sum() / n for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    p = np.concatenate((np.zeros(m), start[:1], gaps))
    one, two = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gap = p[:m], np.exp(p[m + 1 :])
        cuts = np.concatenate(([-np.inf], p[m] + np.concatenate(([0.0], np.cumsum(gap))), [np.inf]))
        score = x @ w
        upper, lower = 1 / (1 + np.exp(-np.clip(cuts[grade + 1] - score, -40, 40))), 1 / (1 + np.exp(-np.clip(cuts[grade] - score, -40, 40)))
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = times * upper * (1 - upper) / mass, times * lower * (1 - lower) / mass
        by_cut = np.array([du[grade == k].sum() - dl[grade == k + 1].sum() for k in range(grades - 1)]) / n
        grad = np.concatenate((-(x.T @ (du - dl)) / n - l2 * w, [by_cut.sum()], gap * by_cut[::-1].cumsum()[::-1][1:]))
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        p = p + 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return p[:m], p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1 :]))))


def _document_features(batches):
    for batch in slices(batches, 200):
        grade, rows = batch.column("grade").to_pylist(), []
        for g, text in zip(grade, batch.column("text").to_pylist(), strict=True):
            words = set(LETTERS.findall((text or "").lower()))
            rows.append((g, sorted({f for w in words for f in word_features(w)})))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["grade", "features"])


def labelled_texts(documents: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, grade, text), written: the graded rows that come first by a hash of doc_id, `sample_rows` at most, with their texts."""
    sample = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").select(F.col("doc_id").alias("graded_id"), F.col("grade").cast("int").alias("grade"))
    sample = sample.orderBy(F.xxhash64("graded_id"), "graded_id", "grade").limit(sample_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("graded_id"))  # sample_rows rows
    return staged(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text"), "labelled")


def severity_terms(texts: DataFrame, features: int = FEATURES) -> dict[str, int]:
    """The features that texts of grades above 0 use more, at most `features`, the surest first and by name at a tie; none if the grades don't differ."""
    used = texts.select("grade", "text").mapInArrow(_document_features, "grade int, features array<string>").select("grade", F.explode("features").alias("feature"))
    sizes = texts.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("p")).first()
    if not sizes["p"] or sizes["p"] == sizes["n"]:
        return {}
    counts = used.groupBy("feature").agg(F.sum((F.col("grade") > 0).cast("long")).alias("a"), F.sum((F.col("grade") == 0).cast("long")).alias("b"))
    expected = F.col("b") * F.lit(sizes["p"] / (sizes["n"] - sizes["p"]))
    z = (F.col("a") - expected) / F.sqrt(F.col("a") + expected + 1)
    best = counts.select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(features).collect()
    return {r["feature"]: k for k, r in enumerate(best)}


def fitted(texts: DataFrame, known: dict[str, int], often: int = 0) -> OrdinalModel:
    """The model of labelled_texts() on known features. often: a grade of 1 becomes 2 where one feature occurs that often; 0 leaves grades as they are."""

    def rows_of(batches):
        table = Known(known)
        for batch in batches:
            found = [counted(t, table) for t in batch.column("text").to_pylist()]
            grade = [g + (g == 1 and 0 < often <= max(x.values(), default=0)) for g, x in zip(batch.column("grade").to_pylist(), found, strict=True)]
            yield pa.record_batch([pa.array(grade, pa.int32()), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], ["grade", "at", "n"])

    gathered = texts.select("grade", "text").mapInArrow(rows_of, "grade int, at array<int>, n array<int>").collect()  # sample_rows rows
    if len({r["grade"] > 0 for r in gathered}) < 2:
        return OrdinalModel({}, np.zeros(0), np.array([-np.inf if any(r["grade"] > 0 for r in gathered) else np.inf]))
    rows = sorted(Counter((r["grade"], *sorted(zip(r["at"], r["n"], strict=True))) for r in gathered).items())
    x, grade, times = np.zeros((len(rows), len(known))), np.array([r[0][0] for r in rows]), np.array([float(r[1]) for r in rows])
    for k, ((_, *found), _) in enumerate(rows):
        for f, n in found:
            x[k, f] = np.log1p(n)
    weights, thresholds = fit_ordinal(x, grade, times, int(grade.max()) + 1)
    return OrdinalModel(known, weights, thresholds)


def train_severity(documents: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> OrdinalModel:
    """documents(doc_id, text) and graded(doc_id, grade from 0, null rows ignored) to a model.

    The sample is the graded rows that come first by a hash of doc_id, `sample_rows` at most. Grades above 1 may be
    absent; if no row is graded above 0, the model rejects nothing.
    """
    texts = labelled_texts(documents, graded, sample_rows)
    return fitted(texts, severity_terms(texts, features))


def train_from_labels(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, often: int = 4) -> OrdinalModel:
    """A model from labels(doc_id, toxic 0 or 1) alone, graded 0 to 2: not toxic, toxic, and toxic with a term of toxic documents `often` times or more.

    The terms are the model's own features, chosen once. Null labels are left out.
    """
    binary = labels.where("toxic IS NOT NULL").select("doc_id", F.least(F.col("toxic").cast("int"), F.lit(1)).alias("grade"))
    texts = labelled_texts(documents, binary, sample_rows)
    return fitted(texts, severity_terms(texts), often)


def score_severity(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """Every row of documents(doc_id, text, ...) to (doc_id, severity int, expected_severity double, p_toxic double, toxic boolean).

    severity is the likeliest grade, p_toxic the chance of a grade above 0, toxic whether that is at least one half.
    Null and empty texts have no features. Rows with null or repeated ids are each scored. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            below = model.at_most(batch.column("text").to_pylist())
            each = np.diff(np.column_stack((np.zeros(len(below)), below, np.ones(len(below)))), axis=1)
            p = 1 - below[:, 0]
            columns = [batch.column("doc_id"), pa.array(each.argmax(1).astype(np.int32)), pa.array((1 - below).sum(1)), pa.array(p), pa.array(p >= 0.5)]
            yield pa.record_batch(columns, ["doc_id", "severity", "expected_severity", "p_toxic", "toxic"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, severity int, expected_severity double, p_toxic double, toxic boolean")


def keep_harmless(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of documents, all columns, whose p_toxic is below one half."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(model.features)
        for array in texts:
            yield harmless(array, model, known)

    return documents.where(F.arrow_udf(run, "boolean")("text"))


def harmless(texts: pa.Array, model: OrdinalModel, known: Known) -> pa.Array:
    """Whether each text's p_toxic is below one half; AT_ONCE texts are Python objects at a time."""
    below = [model.at_most(texts.slice(at, AT_ONCE).to_pylist(), known)[:, 0] for at in range(0, len(texts), AT_ONCE)]
    return pa.array(1 - np.concatenate(below or [np.zeros(0)]) < 0.5)
