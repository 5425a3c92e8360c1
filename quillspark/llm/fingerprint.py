"""Document fingerprints: a homomorphic multiset hash over the paragraphs of a text.

Every paragraph (a line that isn't empty) hashes to a vector of WIDE lanes of 64 bits, and each of its parts, that is its
sentences (and of a sentence beyond LONG characters what stands between words that their own hash chooses), to SIGNS lanes
of +1 or -1. A text's fingerprint is the sum of these vectors, lanes modulo 2**64 and 2**16, and the numbers of paragraphs
and parts modulo 2**64. So the order of paragraphs doesn't matter, and one is put in or taken out by adding or subtracting
its vectors, without the rest of the text. Fingerprints of equal multisets of paragraphs are equal; those of different ones
differ but for a chance of about 2**-256. The sum of squares of the difference of the sign lanes estimates how many parts
differ, which gives a likeness.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDE = 4
SIGNS = 256
LONG = 300  # characters
CUT = 8  # a word in so many ends a piece of a long sentence
ALMOST = 1 - 1e-6  # the likeness at most of texts that differ
STATE = np.dtype([("count", "<u8"), ("parts", "<u8"), ("wide", "<u8", WIDE), ("signs", "<u2", SIGNS)])
TEXTS_AT_ONCE = 100
ROWS_A_RANGE = 4096
MOST_RANGES = 10_000  # of doc_ids; their bounds are the only thing the driver holds


def paragraphs(text: str) -> list[str]:
    """The lines of a text, empty ones left out."""
    return [p for p in text.split("\n") if p]


def parts(text: str) -> list[str]:
    """The parts of a text's paragraphs, empty ones left out."""
    out = []
    for p in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if len(p) <= LONG:
            if p:
                out.append(p)
            continue
        piece = []
        for w in p.split(" "):
            piece.append(w)
            if zlib.crc32(w.encode()) % CUT == 0:
                out.append(" ".join(piece))
                piece = []
        if piece and (piece != [""]):
            out.append(" ".join(piece))
    return out


def wide_lanes(found: list[str]) -> np.ndarray:
    """Of each paragraph."""
    return np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=8 * WIDE).digest() for p in found), "<u8").reshape(len(found), WIDE)


def sign_lanes(found: list[str]) -> np.ndarray:
    """Of each part."""
    raw = np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=SIGNS // 8).digest() for p in found), np.uint8)
    return (np.unpackbits(raw.reshape(len(found), -1), axis=1).astype(np.int16) << 1) - 1


def _summed(cut: list[list[str]], lanes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of strings, places of the lists that hold any, and those lists' sums of lanes."""
    n = np.array([len(c) for c in cut])
    place = {p: i for i, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
    if not place:
        return n, np.zeros(0, int), np.zeros((0, 1), kind)
    index = np.array([place[p] for c in cut for p in c])
    return n, np.flatnonzero(n), np.add.reduceat(lanes(list(place))[index], (np.cumsum(n) - n)[n > 0], axis=0, dtype=kind)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A STATE per text."""
    out = np.zeros(len(texts), STATE)
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts[at : at + TEXTS_AT_ONCE]
        n, held, sums = _summed([paragraphs(t) for t in some], wide_lanes, np.uint64)
        out["count"][at : at + len(some)] = n
        out["wide"][held + at] = sums
        n, held, sums = _summed([parts(t) for t in some], sign_lanes, np.int16)
        out["parts"][at : at + len(some)] = n
        out["signs"][held + at] = sums.view(np.uint16)
    return out


def inserted(state: np.ndarray, paragraph: str, times: int = 1) -> np.ndarray:
    """state with a paragraph put in; negative times take it out."""
    found, new = parts(paragraph), state.copy()
    new["count"] = (int(new["count"]) + times) % (1 << 64)
    new["parts"] = (int(new["parts"]) + times * len(found)) % (1 << 64)
    new["wide"] += wide_lanes([paragraph])[0] * np.uint64(times % (1 << 64))
    if found:
        new["signs"] += (sign_lanes(found).sum(axis=0, dtype=np.int64) * times).astype(np.uint16)
    return new


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of parts, counted in both, that are in common; 1 exactly where the fingerprints are equal. For arrays of states."""
    d = (a["signs"] - b["signs"]).view(np.int16).astype(np.float64)
    total = a["parts"].astype(np.float64) + b["parts"]
    near = 1 - (d**2).mean(axis=1) / np.maximum(total, 1)
    equal = (a["count"] == b["count"]) & (a["parts"] == b["parts"]) & (a["wide"] == b["wide"]).all(axis=1) & (d == 0).all(axis=1)
    return np.where(equal, 1.0, np.clip(near, 0, ALMOST))


def text_of(states: np.ndarray) -> list[str]:
    """States as base64."""
    raw, size = states.tobytes(), STATE.itemsize
    return [base64.b64encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)]


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and order: every document, then, at the end of each range of ids, the first document of the following
    range again with tail set (after the last range the first one's). A partition holds whole ranges, sorted by range, tail,
    doc_id (nulls first) and text. Texts are shuffled once; only doc_ids, one per range, reach the driver."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = min(MOST_RANGES, docs.count() // ROWS_A_RANGE + 1)
    found = docs.agg(F.min("key").alias("first"), F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)] or [0.5], F.lit(max(10_000, 10 * n))).alias("cuts")).first()
    bounds = np.unique([found.first or 0, *(found.cuts or [])[: n - 1]]).astype(np.int64)
    last = len(bounds) - 1

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        at = np.searchsorted(bounds, k, side="right") - 1
        starts = bounds[at] == k
        return pd.Series([[a, (a or last + 1) - 1 + (last + 1)] if s else [a] for a, s in zip(at.tolist(), starts.tolist(), strict=True)])

    # a tail's range is given as range + number of ranges
    rows = docs.withColumn("r", F.explode(ranges("key"))).withColumn("tail", F.col("r") > last).withColumn("r", F.col("r") % (last + 1))
    return rows.repartitionById(last + 1, F.col("r")).sortWithinPartitions("r", "tail", "key", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null text counts as empty; the next document is by ascending doc_id, null ids first, equal ids by text, and after the
    last comes the first, so a lone document follows itself. Repeated rows are documents of their own; other columns are not
    read; an empty table gives no row. Two empty texts are alike (1).
    """
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last document of the rows so far, whose next one is still to come
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            rows = [waiting, *rows] if waiting else rows
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[2] == b[2]]
            waiting = rows[-1] if not rows[-1][3] else None
            if not pairs:
                continue
            texts = [a[1] for a, _ in pairs]
            new = [edited(a[1], b[1]) for a, b in pairs]
            states = fingerprints([x for a, b, e in zip(texts, (b[1] for _, b in pairs), new, strict=True) for x in (a, b, e)])
            own, other, changed = states[::3], states[1::3], states[2::3]
            columns = [[a[0] for a, _ in pairs], list(map(len, texts)), [hashlib.sha256(e.encode()).hexdigest() for e in new], text_of(own), text_of(changed), likeness(own, changed), likeness(own, other)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), [x.split()[0] for x in names.split(", ")])

    return with_next(docs).select("doc_id", "text", "r", "tail").mapInArrow(run, names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document and its edited text."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
