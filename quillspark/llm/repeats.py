"""Suffix-array dedup: removes every byte that lies in a string of 400 bytes which also starts anywhere else; and finds
51 words in a row that stand again, whatever their length in bytes.

Both are the same work on symbols: the bytes of a text, or hashes of its words (a Unit). Below, windows are as many symbols
in a row as the unit compares.

Cutting up. Every window is given to one anchor: of the strings of unit.anchor symbols in it, the leftmost one whose hash is
smallest. Equal windows have equal anchors at equal places. Successive windows of one anchor make a piece: the symbols from
the first window's start to the last one's end. So a window can only be repeated by one in a piece with the same anchor
string, wherever that is; within one piece no window is repeated.

Deciding. Anchor strings that occur once are done. Of equal pieces one is looked at, with their number: where there are two
or more all of its windows are repeated. Where an anchor string has several different pieces, all pieces of some anchor
strings make a shard: its suffix array is induced, and the permuted common prefixes tell which windows share all their
symbols with a neighbour in the array. Of a piece only those windows enter a shard whose core, what windows with nearby
places of the anchor have in common, another piece has too. An anchor string with very many different pieces is split first,
by the place of the anchor in the window, in halves; all windows of a half share more symbols than the anchor, by whose hash
they are dealt out again.

Hashes only bring windows together: pieces count as equal if both a 64-bit hash of the anchor string and another of the
whole piece agree; what isn't equal is compared symbol by symbol through the suffix array. Words are equal if their 64-bit
hashes are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffixarray import common_prefixes, suffix_array


@dataclass(frozen=True)
class Unit:
    """What is compared: strings of repeat symbols, dealt out by anchors of anchor symbols of width bytes."""

    repeat: int
    anchor: int
    words: bool

    @property
    def width(self) -> int:
        return 8 if self.words else 1


REPEAT = 400  # bytes that op1 compares
WORDS = 51  # words in a row that the pipeline's stage removes, too, however short
UNITS = (Unit(REPEAT, 128, False), Unit(WORDS, 8, True))  # the lowest bit of an anchor's hash is the unit's place in here
CUT_AT_ONCE = 1 << 20  # symbols that are cut up together
CODED_AT_ONCE = 1 << 20  # bytes of text whose words are hashed together, or one text
SHARD = 1_000_000  # symbols of pieces in a suffix array, or one anchor string's if those are more
MOST_PIECES = 2_000  # different pieces of an anchor string from which it is split
CORES = 8  # stretches of places of the anchor that have a core each

_PLACE = 24  # low bits that hold a place while anchors are chosen; CUT_AT_ONCE and REPEAT stay below 2**24
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, CUT_AT_ONCE + 4 * REPEAT), base, np.uint64)
        kept[0] = 1
        kept = _POWERS[base] = np.cumprod(kept)
    return kept[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any stretches of a text."""

    def __init__(self, data: np.ndarray, base: int):
        self.inverse = _powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(base, len(data)))])

    def of(self, starts, ends) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(values) - width + 1
    rows = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def word_codes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text a 64-bit hash of every word (anything between ASCII white space)."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CODED_AT_ONCE):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b" ".join([*texts[at:end], b""]), np.uint8)
        gaps = np.flatnonzero(_SPACE[data])
        starts = np.concatenate([[0], gaps[:-1] + 1])
        real = gaps > starts
        starts, ends = starts[real], gaps[real]
        codes = _mix(_Hashes(data.astype(np.uint64), _BASES[1]).of(starts, ends) + (ends - starts).astype(np.uint64))
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[at:end]])[:-1])
        out += np.split(codes, cuts)
        at = end
    return out


def symbols(texts: list[bytes], unit: Unit) -> list[np.ndarray]:
    return word_codes(texts) if unit.words else [np.frombuffer(t, np.uint8) for t in texts]


def cut_up(texts: list[np.ndarray], unit: Unit = UNITS[0]) -> tuple[np.ndarray, ...]:
    """Text number, start, number of windows, place of the anchor from the start, anchor hash and piece hash of each piece."""
    repeat, size = unit.repeat, unit.anchor
    data = np.concatenate([np.zeros(0, np.uint64), *texts]).astype(np.uint64)
    if len(data) < repeat:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    first, second = _Hashes(data, _BASES[0]), _Hashes(data, _BASES[1])
    at = np.arange(n - size + 1)
    anchors = first.of(at, at + size)
    low = np.uint64((1 << _PLACE) - 1)
    anchor = (_least((anchors & ~low) | at.astype(np.uint64), repeat - size + 1) & low).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + repeat <= ends[text])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor, text = anchor[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(new, len(start)))
    x, a, t = start[new], anchor[new], text[new]
    piece = second.of(x, x + windows + repeat - 1) ^ _mix((windows << 16 | (a - x)).astype(np.uint64))
    tag = (anchors[a] & ~np.uint64(1)) | np.uint64(unit.words)
    return t, x - (ends - lengths)[t], windows, a - x, tag.view(np.int64), piece.view(np.int64)


def _stretches(texts: list[np.ndarray], repeat: int = REPEAT) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Numbers of texts, offsets and stretches of them to cut up together; stretches of a long text overlap by a window."""
    numbers, offsets, some, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - repeat + 1), CUT_AT_ONCE):
            s = t[at : at + CUT_AT_ONCE + repeat - 1] if len(t) > CUT_AT_ONCE else t
            if some and size + len(s) > CUT_AT_ONCE:
                yield numbers, offsets, some
                numbers, offsets, some, size = [], [], [], 0
            numbers.append(k)
            offsets.append(at)
            some.append(s)
            size += len(s)
    if some:
        yield numbers, offsets, some


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash that tells texts of one doc_id apart) and text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("h"), text.alias("text"))


def pieces(texts: DataFrame, units: tuple[Unit, ...] = UNITS) -> DataFrame:
    """The pieces of keyed texts: doc_id, h, x (start), n (windows), off (the anchor's place), g and c (hashes)."""
    names = ["doc_id", "h", "x", "n", "off", "g", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).cast(pa.binary()).to_pylist()
            for unit in units:
                for numbers, offsets, some in _stretches(symbols(raws, unit), unit.repeat):
                    t, x, n, off, g, c = cut_up(some, unit)
                    where = pa.array(np.array(numbers)[t] if len(t) else t, pa.int64())
                    x = x + np.array(offsets)[t] if len(t) else x
                    columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array(x.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(off.astype(np.int16)), pa.array(g), pa.array(c)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(lambda rows: common.released(run(rows)), "doc_id long, h int, x int, n short, off short, g long, c long")


def packed(texts: DataFrame) -> DataFrame:
    """Keyed texts with z, the compressed text, in place of text: less to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [pack(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "h", "z"])

    return texts.mapInArrow(lambda rows: common.released(run(rows)), "doc_id long, h int, z binary")


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z, max_output_size=max(1, zstandard.frame_content_size(z)))


#: Columns of pieces with their bytes: key and part are what they are compared by (g and c until split), places p to q of the
#: anchor in the window are what the piece's windows have, and shift is their first one's number in the whole piece.
PART = "key long, part long, g long, c long, m long, n int, off int, p int, q int, shift int, bytes binary"
_NAMES = [x.split()[0] for x in PART.split(", ")]


def with_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """PART columns of wanted pieces (doc_id, h, x, n, off, g, c, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, found = [unpack(z) for z in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            coded = [k for k, f in enumerate(found) if any(r["g"] & 1 for r in f)]
            codes = dict(zip(coded, word_codes([raws[k] for k in coded]), strict=True))
            for k, (raw, f) in enumerate(zip(raws, found, strict=True)):
                cut = []
                for r in f:
                    source, length = (codes[k], r["n"] + WORDS - 1) if r["g"] & 1 else (raw, r["n"] + REPEAT - 1)
                    cut.append(bytes(source[r["x"] : r["x"] + length]))
                g, c = [r["g"] for r in f], [r["c"] for r in f]
                most = [UNITS[r["g"] & 1].repeat - UNITS[r["g"] & 1].anchor for r in f]
                columns = [g, c, g, c, [r["m"] for r in f], [int(r["n"]) for r in f], [r["off"] for r in f], [0] * len(f), most, [0] * len(f), cut]
                kinds = [pa.int64()] * 5 + [pa.int32()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), _NAMES)

    by_text = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("x", "n", "off", "g", "c", "m")).alias("found"))
    z = packed(texts)
    joined = z.join(by_text, z["doc_id"].eqNullSafe(by_text["doc_id"]) & (z["h"] == by_text["h"]))
    # rows repeated in full give their pieces each
    return joined.select("z", "found").mapInArrow(lambda rows: common.released(run(rows)), PART)


def _hash(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(4, "little") + p)
    return int.from_bytes(h.digest(), "little", signed=True)


def core(raw: bytes, off: int, p: int, q: int, unit: Unit) -> bytes:
    """What the windows with the anchor at places p to q have in common, of a piece whose first one has it at off."""
    return raw[(off - p) * unit.width : (off - q + unit.repeat) * unit.width]


def halved(parts: DataFrame) -> DataFrame:
    """Each piece's windows in two, by the place of the anchor; key is by the symbols that all windows of a half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                unit = UNITS[r["g"] & 1]
                high, low = r["off"], r["off"] - (r["n"] - 1)
                middle = (r["p"] + r["q"]) // 2
                for p, q in ((r["p"], middle), (middle + 1, r["q"])):
                    a, b = max(p, low), min(q, high)
                    if p > q or a > b:
                        continue
                    raw = r["bytes"][(high - b) * unit.width : (high - a + unit.repeat) * unit.width]
                    tag = f"{p},{q}".encode()
                    key = _hash(r["key"].to_bytes(8, "little", signed=True), tag, core(r["bytes"], high, p, q, unit)) & ~1 | unit.words
                    out.append((key, _hash(tag, str(b).encode(), raw), r["g"], r["c"], r["m"], b - a + 1, b, p, q, r["shift"] + high - b, raw))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 11, kinds, strict=True)], _NAMES)

    return parts.mapInArrow(lambda rows: common.released(run(rows)), PART)


def repeated_windows(cut: list[bytes], unit: Unit = UNITS[0]) -> list[list[tuple[int, int]]]:
    """Of each piece of a shard the runs (first, last) of its windows that occur again in the shard."""
    lengths = np.array([len(b) // unit.width for b in cut], np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    raw = np.frombuffer((b"\0" * unit.width).join([*cut, b""]), "<u8" if unit.words else np.uint8)
    raw = (np.unique(raw, return_inverse=True)[1] if unit.words else raw).astype(np.int64) + 2
    raw[starts + lengths] = 1
    text = np.append(raw, 0)
    windows = lengths - unit.repeat + 1
    before, shared = common_prefixes(text, suffix_array(text), starts, starts + windows, unit.repeat)
    hit = np.zeros(len(text) + 1, bool)
    own = np.flatnonzero(shared >= unit.repeat)
    hit[own] = hit[before[own]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in cut]
    first, last = edge[::2], edge[1::2] - 1
    for k, a, b in zip((np.searchsorted(starts, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
        out[k].append((a - int(starts[k]), b - int(starts[k])))
    return out


def shared_cores(group: list[tuple], unit: Unit) -> Iterator[tuple[int, int, int, bytes]]:
    """Of different pieces (key, part, n, off, p, q, bytes) of one key those that have a core in common with another: key,
    part, the first window that may be repeated, and the symbols from there to the end of the last one."""
    seen: dict[tuple[int, int], int] = {}
    own = []
    for _, _, n, high, p0, q0, raw in group:
        low, step, mine = high - (n - 1), -(-(q0 - p0 + 1) // CORES), []
        for p in range(p0 + max(0, low - p0) // step * step, min(high, q0) + 1, step):
            q = min(p + step - 1, q0)
            k = (p, hash(core(raw, high, p, q, unit)))  # only brings pieces together, within this task
            seen[k] = seen.get(k, 0) + 1
            mine.append((k, max(p, low), min(q, high)))
        own.append(mine)
    for (key, part, _, off, _, _, raw), mine in zip(group, own, strict=True):
        found = [(a, b) for k, a, b in mine if seen[k] > 1]
        if found:
            low, high = found[0][0], found[-1][1]
            yield key, part, off - high, raw[(off - high) * unit.width : (off - low + unit.repeat) * unit.width]


def compared(parts: DataFrame) -> DataFrame:
    """key, part, a, b: the runs of windows that stand in different parts (PART columns) of a key; those of one key and part
    are equal, and one of them is compared."""
    names = ["key", "part", "a", "b"]

    def decide(unit: Unit, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_windows([raw for *_, raw in rows], unit)
        out = [(key, part, first + a, first + b) for (key, part, first, _), runs in zip(rows, found, strict=True) for a, b in runs]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and r[0] != group[-1][0]:
                    yield group
                    group = []
                if not group or r[1] != group[-1][1]:  # else from a row that is repeated in full
                    group.append(r)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, kind = [], 0, None
        for group in groups(batches):
            unit = UNITS[group[0][0] & 1]
            if rows and (size >= SHARD or unit != kind):
                yield decide(kind, rows)
                rows, size = [], 0
            some = list(shared_cores(group, unit))
            rows, size, kind = rows + some, size + sum(len(raw) for *_, raw in some) // unit.width, unit
        if rows:
            yield decide(kind, rows)

    dealt = parts.select("key", "part", "n", "off", "p", "q", "bytes").repartition("key").sortWithinPartitions(F.col("key").bitwiseAND(1), "key", "part")
    return dealt.mapInArrow(lambda rows: common.released(run(rows)), "key long, part long, a int, b int")


def split_and_compared(rows: DataFrame, most: int) -> DataFrame | None:
    """g, c, a, b for the pieces of anchor strings that have more than most different ones."""
    found = None
    while True:
        rows = common.written(halved(rows), "halves")
        if rows.isEmpty():
            return found
        kept = [F.first(k).alias(k) for k in ("n", "off", "p", "q", "bytes")]
        parts = rows.groupBy("key", "part").agg(*kept)
        groups = common.written(rows.groupBy("key", "part").agg(F.sum("m").alias("m")).groupBy("key").agg(F.count("*").alias("d"), F.sum("m").alias("all")).where("`all` > 1"), "groups")
        some = common.written(parts.join(groups.where(F.col("d").between(2, most)), "key"), "parts")
        runs = compared(some)
        same = rows.groupBy("key", "part").agg(F.sum("m").alias("m"), F.first("n").alias("n")).where("m > 1").select("key", "part", F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
        here = rows.select("key", "part", "g", "c", "shift").join(runs.unionByName(same), ["key", "part"]).select("g", "c", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
        here = common.written(here, "found")
        found = here if found is None else found.unionByName(here)
        rows = rows.join(groups.where(F.col("d") > most).select("key"), "key", "left_semi")


def removals(docs: DataFrame, most: int = MOST_PIECES, units: tuple[Unit, ...] = UNITS) -> DataFrame:
    """doc_id, h and spans (array of words, start and end, that may overlap) of the texts in which windows stand again:
    places of bytes, or of words where words is true."""
    texts = keyed(docs)
    cut = common.written(pieces(texts, units), "pieces")
    total = cut.count()
    again = cut.groupBy("g").agg(F.count("*").alias("times")).where("times > 1")
    cut = common.written(common.join_hot(cut, again, ["g"], total, "left_semi"), "shared")
    contents = common.written(cut.groupBy("g", "c").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "h", "x", "n", "off")).alias("rep")), "contents")
    groups = contents.groupBy("g").agg(F.count("*").alias("d")).where("d > 1")
    several = contents.join(groups, "g").select("g", "c", "m", "rep.*", "d")
    hot = groups.where(F.col("d") > most).select("g")
    whole = contents.where("m > 1").select("g", "c", F.lit(0).alias("a"), (F.col("rep.n").cast("int") - 1).alias("b"))
    parts = common.written(with_bytes(several, texts), "bytes")
    split = common.written(parts.join(hot, parts["key"] == hot["g"], "left_semi").dropDuplicates(["g", "c"]), "hot")
    rest = parts
    found = whole
    if not split.isEmpty():
        rest = parts.join(hot, parts["key"] == hot["g"], "left_anti")
        more = split_and_compared(split, most)
        found = found if more is None else found.unionByName(more)
    found = found.unionByName(compared(rest).select(F.col("key").alias("g"), F.col("part").alias("c"), "a", "b"))
    runs = common.written(found.groupBy("g", "c").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "runs")
    runs = runs.join(contents.select("g", "c", F.col("m").alias("times")), ["g", "c"])
    spans = common.join_hot(cut, runs, ["g", "c"], total).select("doc_id", "h", "g", "x", F.explode("runs").alias("r"))
    words = F.col("g").bitwiseAND(1) == 1
    end = F.col("x") + F.col("r.b") + F.when(words, WORDS).otherwise(REPEAT)
    spans = spans.select("doc_id", "h", F.struct(words.alias("words"), (F.col("x") + F.col("r.a")).alias("start"), end.alias("end")).alias("span"))
    return spans.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))


def merged_spans(spans: pa.ListArray) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Of each row the maximal runs of bytes and of words that its spans cover."""
    out: list[tuple[list, list]] = [([], []) for _ in range(len(spans))]
    flat = spans.flatten()
    if not len(flat):
        return out
    words, start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    group = pc.list_parent_indices(spans).to_numpy().astype(np.int64) * 2 + words
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(group * top + end) - group * top
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])]).nonzero()[0]
    last = np.append(new[1:], len(group)) - 1
    for g, a, b in zip(group[new].tolist(), start[new].tolist(), reach[last].tolist(), strict=True):
        out[g >> 1][g & 1].append((a, b))
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for r in runs for e in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and n_repeated_words: how many of its words lie in
    WORDS words in a row that stand again, in any text or length (none of them is removed for that).

    Null text counts as empty. Rows repeated in full are documents of their own, so all of theirs is repeated from REPEAT
    bytes on; a null doc_id stays null; other columns are not read; an empty table gives no row. A text below REPEAT bytes
    loses nothing. What is repeated is judged on the input, not on what is left.
    """
    texts = keyed(docs)
    lost = removals(docs)
    z = packed(texts)
    rows = z.join(lost, z["doc_id"].eqNullSafe(lost["doc_id"]) & (z["h"] == lost["h"]), "left").select(z["doc_id"], "z", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for z, (runs, words) in zip(batch.column(1).to_pylist(), merged_spans(batch.column(2)), strict=True):
                raw = unpack(z)
                kept = without(raw, runs)
                row = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in words))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)

    return rows.mapInArrow(lambda rows: common.released(run(rows)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what every document loses."""
    return remove_repeats(common.table(spark, sf_dir, "documents"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CONTINUES = re.compile(rb"[\x80-\xbf]*").match


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """runs without the bytes of characters that they hold a part of."""
    out = []
    for a, b in runs:
        a = _CONTINUES(raw, a).end()
        while b < len(raw) and b > a and 0x80 <= raw[b] < 0xC0:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def words_to_bytes(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes from the first to the last word of each run of words."""
    at = [m.span() for m in _WORD.finditer(raw)] if runs else []
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without what is repeated: strings of REPEAT bytes (characters cut by a run's edge stay) and WORDS words
    in a row, whatever their length and the white space between them; n_chars follows the text. A document that loses
    something and keeps nothing but white space goes.

    A null text stays null and loses nothing; a null doc_id is kept; rows repeated in full repeat each other, so all of
    theirs from REPEAT bytes or WORDS words on goes; other columns may have any names and stay as they are; an empty table
    stays empty. Very long texts are cut up in stretches that overlap by a window.
    """
    common.tune(spark)
    names, schema = docs.columns, docs.schema
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.hash(F.coalesce("text", F.lit(""))).alias("hash"))
    lost = removals(docs)
    rows = own.join(lost, own["id"].eqNullSafe(lost["doc_id"]) & (own["hash"] == lost["h"]), "left").select("row", "spans")
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, stay, counts = [], [], columns[chars].to_pylist() if chars is not None else None
            for k, (t, (runs, words)) in enumerate(zip(columns[at].to_pylist(), merged_spans(batch.column(1)), strict=True)):
                if runs or words:
                    raw = t.encode()
                    runs = whole_characters(raw, runs) + words_to_bytes(raw, words)
                if runs:
                    t = without(raw, merged([{"start": a, "end": b} for a, b in runs])).decode()
                    if counts is not None:
                        counts[k] = len(t)
                if not runs or t.strip():
                    stay.append(k)
                texts.append(t)
            columns[at] = pa.array(texts, columns[at].type)
            if counts is not None:
                columns[chars] = pa.array(counts, pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names).take(pa.array(stay, pa.int64()))

    return rows.mapInArrow(lambda rows: common.released(run(rows)), schema)
