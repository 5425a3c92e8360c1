"""Toxicity: cumulative-link ordinal regression of a severity grade on sparse text features.

Features are words and the beginnings of words, so that inflected and compounded forms count with their stem. Those that
stand out in labelled toxic text are kept; a document's value of a feature is log(1 + its occurrences). One weight vector
serves all thresholds: P(grade > k) = logistic(weights . x - threshold k), thresholds increasing. The output is the
probability of any toxicity, the expected severity and the likeliest grade.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import common

PER_CLASS = 2_500  # labelled documents of each class at most that the model is fitted on
BEGINNINGS = range(3, 8)  # lengths in characters
LEAST_CHI2 = 25.0  # of a feature with the label, on the sample
LEAST_DOCUMENTS = 5
MOST_FEATURES = 5_000  # a parameter of the model: those that stand out most
GRADE_FROM = (4, 10)  # hits from which a labelled document without a grade is of grade 2, of grade 3
CACHED_WORDS = 300_000
CACHED_LENGTH = 64


def word_features(word: str) -> list[str]:
    """Of a space-separated part of a text: the word without outer punctuation, in lower case, and its beginnings."""
    w = word.strip(punctuation).lower()
    return [f"={w}", *(f"^{w[:k]}" for k in BEGINNINGS if len(w) >= k)] if w else []


class _Hits(dict):
    """Indexes of kept features by word."""

    def __init__(self, kept: dict[str, int]):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.kept[f] for f in word_features(word) if f in self.kept)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


class OrdinalModel:
    """Kept features, shared weights and ordered thresholds; of bounded size."""

    def __init__(self, kept: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.kept, self.weights, self.thresholds, self._hits = kept, weights, thresholds, None

    def __getstate__(self):
        return self.__dict__ | {"_hits": None}

    def counts(self, text: str) -> Counter:
        if self._hits is None:
            self._hits = _Hits(self.kept)
        return Counter(i for h in map(self._hits.__getitem__, text.split()) if h for i in h)

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        score = sum(self.weights[i] * math.log1p(n) for i, n in self.counts(text).items())
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -30, 30)))


def keep_features(texts: list[str], toxic: list[int]) -> dict[str, int]:
    """The features that stand out in toxic texts by chi-square over documents, from most to least."""
    with_it, n_toxic = (Counter(), Counter()), sum(toxic)
    for text, t in zip(texts, toxic, strict=True):
        with_it[bool(t)].update({f for w in set(text.split()) for f in word_features(w)})
    n, n_clean, found = len(texts), len(texts) - n_toxic, []
    for f, a in with_it[1].items():
        b = with_it[0][f]
        if a < LEAST_DOCUMENTS or a * n_clean <= b * n_toxic:
            continue
        c, d = n_toxic - a, n_clean - b
        chi2 = n * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n_toxic * n_clean)
        if chi2 >= LEAST_CHI2:
            found.append((-chi2, f))
    return {f: i for i, (_, f) in enumerate(sorted(found)[:MOST_FEATURES])}


def fit_ordinal(rows: list[Counter], grades: list[int], n_features: int, n_grades: int, steps: int = 600, ridge: float = 1e-4, weights: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on whole passes; rows count by their weights (1 each
    by default)."""
    y = np.array(grades)
    each = np.ones(len(y)) if weights is None else np.array(weights, float) * len(y) / sum(weights)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.array([i for r in rows for i in r], int)
    value = np.log1p(np.array([n for r in rows for n in r.values()], float))
    above = np.array([(np.sum(each * (y > k)) + 0.5) / (len(y) + 1) for k in range(n_grades - 1)])
    theta = np.log((1 - above) / above)
    # thresholds as the first and the logs of the steps between them
    p = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, cuts = p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
        score = np.bincount(at, w[index] * value, len(rows)) if len(index) else np.zeros(len(rows))
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        s = np.column_stack([np.ones(len(rows)), s, np.zeros(len(rows))])
        low, high = s[np.arange(len(rows)), y], s[np.arange(len(rows)), y + 1]
        prob = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_score = -each * (d_low - d_high) / prob / len(rows)
        d_cut = np.zeros(n_grades + 1)
        np.add.at(d_cut, y, each * d_low / prob / len(rows))
        np.add.at(d_cut, y + 1, -each * d_high / prob / len(rows))
        tail = np.cumsum(d_cut[1:-1][::-1])[::-1]
        g = np.concatenate([np.bincount(index, d_score[at] * value, n_features) + ridge * w if len(index) else ridge * w, tail[:1], tail[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def _family(text: str) -> int:
    """The same for copies and most near copies: the smallest checksum of five words in a row."""
    w = text.split()
    return min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))


def fit(texts: list[str | None], toxic: list[int], grades: list[int] | None = None, weights: list[float] | None = None) -> OrdinalModel:
    """From labelled texts, one of each family of copies. Grades run from 0 (clean); without them a toxic text's grade
    follows from its number of hits (GRADE_FROM). With no toxic or no clean text the model finds nothing toxic. Weights say
    how many texts one stands for; they count in the regression, features are chosen by the texts at hand."""
    rows = {}
    for k in sorted(range(len(texts)), key=lambda k: ((texts[k] or ""), toxic[k])):
        rows.setdefault((_family(texts[k] or ""), toxic[k]), k)
    chosen = list(rows.values())
    weights = weights and [weights[k] for k in chosen]
    texts, toxic, grades = [texts[k] or "" for k in chosen], [toxic[k] for k in chosen], grades and [grades[k] for k in chosen]
    if not any(toxic) or all(toxic):
        return OrdinalModel({}, np.zeros(0), np.array([30.0, 31.0, 32.0]))
    kept = keep_features(texts, toxic)
    model = OrdinalModel(kept, np.zeros(len(kept)), np.zeros(1))
    counts = [model.counts(t) for t in texts]
    if grades is None:
        hits = [sum(bool(model._hits[w]) for w in t.split()) for t in texts]
        grades = [t and 1 + sum(h >= g for g in GRADE_FROM) for t, h in zip(toxic, hits, strict=True)]
    model.weights, model.thresholds = fit_ordinal(counts, grades, len(kept), max(2, max(grades) + 1), weights=weights)
    return model


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> OrdinalModel:
    """On a bounded sample of labelled documents."""
    sample = common.labelled(docs, labels, "toxic", per_class)
    return fit([t for t, _, _ in sample], [y for _, y, _ in sample], weights=[w for _, _, w in sample])


def grade_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """All columns of docs, with toxic (1 where toxicity is at least as likely as not), p_toxic, severity (expected grade)
    and grade (the likeliest).

    Null text counts as empty and has no features; a whole text is read. Rows without a doc_id and repeated rows are graded
    like any other; columns of docs with these names are replaced. Without labels of both kinds nothing is toxic.
    """
    model = fit_labelled(docs, labels, per_class)
    added = "toxic integer, p_toxic double, severity double, grade integer"
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*names)
    columns = docs.columns
    at, all_names = columns.index("text"), [*columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, severity, grade = [], [], []
            for t in batch.column(at):
                above = model.above(t.as_py() or "")
                p.append(float(above[0]))
                severity.append(float(above.sum()))
                each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                grade.append(int(each.argmax()))
            more = [pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(p, pa.float64()), pa.array(severity, pa.float64()), pa.array(grade, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], all_names)

    schema = StructType([*docs.schema.fields, *(StructField(x.split()[0], DoubleType() if "double" in x else IntegerType()) for x in added.split(", "))])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's toxicity."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_toxicity(docs, common.table(spark, sf_dir, "labels")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic.

    Null and empty texts have no features and stay with a model that has any label; rows without an id and repeated rows are
    graded like any other; columns may have any names and stay as they are; an empty table stays empty; very long texts are
    read whole.
    """
    common.tune(spark)
    model = fit_labelled(docs, common.table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array([k for k, t in enumerate(batch.column(at)) if model.above(t.as_py() or "")[0] < 0.5], pa.int64()))

    return docs.mapInArrow(run, docs.schema)
