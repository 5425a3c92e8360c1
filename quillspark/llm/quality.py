"""Quality by compression: two zstandard dictionaries, one trained on good and one on bad text.

A text is cut into pieces of PIECE bytes and each piece is compressed with either dictionary; the difference of the two
total sizes over the text's size says which kind it resembles. A logistic fit on labelled texts that the dictionaries have
not seen turns it, with the compressed ratio and the text's length, into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS = 2_000  # labelled documents of each class at most that the model is fitted on
PIECE = 512  # bytes compressed at a time; a dictionary matters little further into a text
DICTIONARY = 64 << 10  # bytes
TRAIN_PIECES = 12_800  # pieces of a class at most that its dictionary is trained on, those with the lowest checksums
LEVEL = 3
LEAST_PIECES = 50  # below so many pieces a dictionary isn't trained but made of them


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def dictionary(texts: list[bytes], most: int = TRAIN_PIECES) -> bytes:
    """A dictionary's content, trained on at most so many pieces of the texts in an order fixed by their checksums."""
    found = sorted((p for t in texts for p in pieces(t)), key=lambda p: (zlib.crc32(p), p))[:most]
    if len(found) >= LEAST_PIECES:
        try:
            return zstandard.train_dictionary(DICTIONARY, found).as_bytes()
        except zstandard.ZstdError:
            pass  # too few distinct pieces to train on
    return b"".join(found)[-DICTIONARY:]


class CompressionModel:
    """Dictionaries and calibration; of bounded size."""

    def __init__(self, good: bytes, bad: bytes):
        self.content, self.weights = (good, bad), np.zeros(5)
        self.scale = (np.zeros(4), np.ones(4))
        self._packers = None

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def sizes(self, raw: bytes) -> tuple[int, int]:
        if self._packers is None:
            kind = lambda c: zstandard.ZstdCompressionDict(c) if c else None
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=kind(c), write_content_size=False, write_dict_id=False).compress for c in self.content]
        cut = pieces(raw)
        good, bad = (sum(map(len, map(pack, cut))) for pack in self._packers)
        return good, bad

    def features(self, raw: bytes) -> list[float]:
        n, (good, bad) = max(1, len(raw)), self.sizes(raw)
        return [(bad - good) / n, (bad - good) / (bad + good + 1), (good + bad) / 2 / n, np.log1p(len(raw))]

    def calibrate(self, raws: list[bytes], labels: list[int], weights: list[float] | None = None) -> None:
        """Logistic regression by Newton's method, with a light ridge; rows count by their weights (1 each by default)."""
        x, y = np.array([self.features(r) for r in raws]).reshape(-1, 4), np.array(labels, float)
        each = np.ones(len(y)) if weights is None else np.array(weights, float) * len(y) / sum(weights)
        self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(y) else self.scale
        x = np.column_stack([(x - self.scale[0]) / self.scale[1], np.ones(len(y))])
        w, ridge = np.zeros(5), np.diag([1e-2] * 4 + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (each * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
            w += step
            if abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, raw: bytes) -> float:
        x = (np.array(self.features(raw)) - self.scale[0]) / self.scale[1]
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:4] + self.weights[4], -30, 30))))


def fit(texts: list[str | None], labels: list[int], weights: list[float] | None = None) -> CompressionModel:
    """Dictionaries from every second text of each class, calibration on the others, then the same with the halves'
    roles kept; without one of the classes every score is the smoothed share of good ones. A text of a label stands for as
    many as its weight says (one by default), the same for all texts of the label."""
    rows = sorted({(zlib.crc32((t or "").encode()), (t or "").encode(), y) for t, y in zip(texts, labels, strict=True)})
    held = {y: [r for _, r, k in rows if k == y] for y in (0, 1)}
    weight = dict(zip(labels, weights, strict=True)) if weights else {0: 1.0, 1: 1.0}
    if not held[0] or not held[1]:
        model, share = CompressionModel(b"", b""), (len(held[1]) + 0.5) / (len(rows) + 1)
        model.weights = np.array([0, 0, 0, 0, np.log(share / (1 - share))])
        return model
    model = CompressionModel(*(dictionary(held[y][::2]) for y in (1, 0)))
    rest = {y: held[y][1::2] or held[y] for y in (0, 1)}
    model.calibrate(rest[1] + rest[0], [1] * len(rest[1]) + [0] * len(rest[0]), [weight[1]] * len(rest[1]) + [weight[0]] * len(rest[0]))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a label is kept from the fit: crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (1 from 0.5 on).

    The score depends on the text alone; null counts as empty, and empty texts get a score too. Equal texts have equal
    scores. Every row is scored, repeated ones each; other columns are not read; an empty table gives no row.
    """
    sample = common.labelled(docs, labels, "quality", per_class, ~held_out(F.col("doc_id")))
    model = fit([t for t, _, _ in sample], [y for _, y, _ in sample], [w for _, _, w in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return ids.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's quality."""
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
