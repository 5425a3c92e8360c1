"""Replay of edit logs: every character of the final text keeps the event that wrote it.

A log is a sequence, so the fold itself is Python, one log at a time and Arrow batches between; what follows from the
replayed events are columns and windows (operators.process). The fold keeps the text as a string and the writing events of
its characters as an array, and recounts words only around an edit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import WORD

TEXT_EVENTS = ["insert", "paste", "delete", "replace", "snapshot"]
MOVE_LENGTH, MOVE_SHARE = 20, 0.8
_WORD, _PART = re.compile(WORD), re.compile("[A-Za-zÀ-ɏ'’]")
#: Columns of replayed events; ranges are those of the final text, as start and end characters.
REPLAYED = (
    "sample_id string, id int, t long, type string, pos int, length int, text string, inserted int, deleted int, inserted_words int, surviving int, surviving_words int, "
    "mid boolean, internal_move boolean, words_after int, chars_after int, deleted_text string, ranges array<struct<start:int,end:int>>, final_text string, warnings int"
)


def count_words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


def diff(a: str, b: str) -> tuple[int, int, str] | None:
    """The one region in which b differs from a: its place, the length removed and the text put in."""
    if a == b:
        return None
    most, p = min(len(a), len(b)), 0
    while p < most and a[p] == b[p]:
        p += 1
    s = 0
    while s < most - p and a[len(a) - 1 - s] == b[len(b) - 1 - s]:
        s += 1
    return p, len(a) - p - s, b[p : len(b) - s]


def is_internal_move(text: str, deleted: list[str]) -> bool:
    """Whether a pasted text was cut from the same document: it is in an earlier deletion, or is little more than one."""
    t = text.strip()
    if len(t) < MOVE_LENGTH:
        return False
    return any(t in d or (len(d.strip()) >= MOVE_LENGTH and d.strip() in t and len(d.strip()) / len(t) > MOVE_SHARE) for d in deleted)


@dataclass
class Event:
    id: int
    t: int
    type: str
    pos: int | None = None
    length: int | None = None
    text: str | None = None
    inserted: int = 0
    deleted: int = 0
    inserted_words: int = 0
    surviving: int = 0
    surviving_words: int = 0
    mid: bool = False
    internal_move: bool = False
    words_after: int = 0
    chars_after: int = 0
    deleted_text: str = ""
    ranges: list = field(default_factory=list)


class Document:
    """A text under edit; may also be kept between batches of a stream."""

    def __init__(self):
        self.text, self.writers, self.words, self.removed, self.warnings = "", array("i"), 0, [], 0

    def _splice(self, at: int, length: int, new: str, writer: int) -> str:
        left, right = at, at + length
        while left > 0 and _PART.match(self.text, left - 1):
            left -= 1
        while right < len(self.text) and _PART.match(self.text, right):
            right += 1
        gone = self.text[at : at + length]
        before = count_words(self.text[left:right])
        self.text = self.text[:at] + new + self.text[at + length :]
        self.writers[at : at + length] = array("i", [writer]) * len(new)
        self.words += count_words(self.text[left : right + len(new) - len(gone)]) - before
        return gone

    def _insert(self, e: Event, pos: int, text: str) -> None:
        at = min(pos, len(self.text))
        self.warnings += pos > len(self.text)
        e.mid |= bool(self.text[at:].strip())
        self._splice(at, 0, text, e.id)
        e.inserted += len(text)
        e.inserted_words += count_words(text)

    def _delete(self, e: Event, pos: int, length: int) -> None:
        if length <= 0:
            return
        self.warnings += pos + length > len(self.text)
        gone = self._splice(min(pos, len(self.text)), min(length, max(0, len(self.text) - pos)), "", e.id)
        e.deleted += len(gone)
        e.deleted_text += gone
        self.removed.append(gone)

    def apply(self, e: Event) -> None:
        if e.type in ("insert", "paste"):
            if e.type == "paste":
                e.internal_move = is_internal_move(e.text, self.removed)
            self._insert(e, e.pos, e.text)
        elif e.type == "delete":
            self._delete(e, e.pos, e.length)
        elif e.type == "replace":
            self._delete(e, e.pos, e.length)
            self._insert(e, e.pos, e.text)
        elif e.type == "snapshot":
            found = diff(self.text, e.text)
            if found:
                self._delete(e, found[0], found[1])
                if found[2]:
                    self._insert(e, found[0], found[2])
        e.chars_after, e.words_after = len(self.text), self.words

    def settle(self, events: dict[int, Event]) -> None:
        """Surviving characters, words and ranges of each event."""
        at, w = 0, self.writers
        while at < len(w):
            end = at + 1
            while end < len(w) and w[end] == w[at]:
                end += 1
            e = events[w[at]]
            e.surviving += end - at
            e.ranges.append((at, end))
            e.surviving_words += count_words(self.text[at:end])
            at = end


def replay(events: list[Event]) -> Document:
    """Applies events in their order and settles them."""
    doc = Document()
    for e in events:
        doc.apply(e)
    doc.settle({e.id: e for e in events})
    return doc


def normalized(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, numbered from 0 by time and then source within a sample, and rejected ones with their problem.

    Columns: sample_id, source, t (ms), type, pos, length, text. As in a tolerant reader a type may be in any case.
    """
    kind = F.lower(F.coalesce("type", F.lit("")))
    needs = lambda c, *types: kind.isin(*types) & c
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(True)) | (F.col(c) != F.floor(c))
    problem = (
        F.when(F.col("t").isNull(), "missing or invalid time")
        .when(~kind.isin(*TEXT_EVENTS, "focus", "blur", "submit", "session-start", "session-end"), "unknown type")
        .when(needs(F.col("text").isNull(), "insert", "paste", "replace", "snapshot"), "text is missing")
        .when(needs(bad("pos"), "insert", "paste", "delete", "replace"), "invalid position")
        .when(needs(bad("length"), "delete", "replace"), "invalid length")
    )
    from pyspark.sql import Window

    marked = events.withColumns({"type": kind, "problem": problem})
    order = Window.partitionBy("sample_id").orderBy("t", "source")
    good = marked.where("problem is null").drop("problem").withColumn("id", F.row_number().over(order) - 1)
    return good, marked.where("problem is not null").select("sample_id", "source", "problem")


def replayed(events: DataFrame) -> DataFrame:
    """REPLAYED rows of normalized events (sample_id, id, t, type, pos, length, text). One shuffle, by sample; a log is
    folded by one task, as its events depend on each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if rows and r.sample_id != rows[0].sample_id:
                    yield folded(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield folded(rows)

    columns = ["sample_id", "id", "t", "type", "pos", "length", "text"]
    dealt = events.select(F.col("sample_id").cast("string").alias("sample_id"), *columns[1:]).repartition("sample_id").sortWithinPartitions("sample_id", "id")
    return dealt.mapInPandas(run, REPLAYED)


def folded(rows: list) -> pd.DataFrame:
    whole = lambda v: None if pd.isna(v) else int(v)
    events = [Event(int(r.id), int(r.t), r.type, whole(r.pos), whole(r.length), r.text) for r in rows]
    doc = replay(events)
    out = []
    for k, e in enumerate(events):
        last = k == len(events) - 1
        out.append((rows[0].sample_id, e.id, e.t, e.type, e.pos, e.length, e.text, e.inserted, e.deleted, e.inserted_words, e.surviving, e.surviving_words, e.mid, e.internal_move, e.words_after, e.chars_after, e.deleted_text, [{"start": a, "end": b} for a, b in e.ranges], doc.text if last else None, doc.warnings if last else None))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])
    for c in ("pos", "length", "warnings"):
        frame[c] = frame[c].astype("Int32")
    return frame


def log_of(docs: DataFrame, chunk: int = 40) -> DataFrame:
    """A log that rebuilds each text of docs (doc_id, text): words put in chunk by chunk at the end, every fifth chunk also
    deleted and put in again. Used where a table has texts but no logs."""
    parts = F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % chunk), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.posexplode(parts).alias("k", "part"))
    pos = F.col("k") * chunk
    base = F.col("k").cast("long") * 3
    insert = F.struct((base * 1000).alias("t"), F.lit("insert").alias("type"), pos.alias("pos"), F.lit(None).cast("int").alias("length"), F.col("part").alias("text"), base.alias("source"))
    delete = F.struct((base * 1000 + 500).alias("t"), F.lit("delete").alias("type"), pos.alias("pos"), F.length("part").alias("length"), F.lit(None).cast("string").alias("text"), (base + 1).alias("source"))
    again = F.struct((base * 1000 + 900).alias("t"), F.lit("insert").alias("type"), pos.alias("pos"), F.lit(None).cast("int").alias("length"), F.col("part").alias("text"), (base + 2).alias("source"))
    some = F.when(F.col("k") % 5 == 4, F.array(insert, delete, again)).otherwise(F.array(insert))
    return rows.select("sample_id", F.explode(some).alias("e")).select("sample_id", "e.*")
