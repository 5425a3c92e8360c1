"""Media columns: baseline JPEG with lossless DC samples, DC-only luminance thumbnails and thumbnail hashes.

Writing: every payload byte is the mean of one flat 8 x 8 block. With a quantiser of 8 the quantised DC coefficient is the
byte minus 128, so nothing is lost and any JPEG reader shows the bytes as grey squares. An image is 64 blocks wide and at
most 8191 blocks high; a longer payload becomes several images in a row. Each block row is a restart interval.

Reading: markers are parsed, stuffed zeros removed, and all restart intervals are Huffman-decoded in step, one symbol each
at a time, as numpy arrays. Only DC coefficients are kept; AC symbols are decoded and skipped. Any baseline file can be read,
with any tables, sampling factors, restart intervals and scans; progressive and arithmetic files are refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

ACROSS = 64  # blocks of a row, and so bytes of a payload row
ROWS = 8191  # block rows of an image; more would pass the 16-bit height
STEP_BYTES = 1 << 21  # payload bytes encoded or decoded at a time; bounds memory

# Fixed values of the format: markers, and the zero-run symbol of AC coding.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0, RST7 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0, 0xD7
REFUSED = {0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ZERO_RUN = 0xF0

#: Our tables as (number of codes by length 1..16, symbols): DC sizes 0 to 8, AC end of block alone.
DC_TABLE = ([0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [6, 5, 4, 3, 7, 2, 1, 8, 0])
AC_TABLE = ([1] + [0] * 15, [0])


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For every 16-bit look-ahead, 256 times the code's length plus its symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in canonical(counts, symbols).items():
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, end of block included."""
    dc, (eob, eob_length) = canonical(*DC_TABLE), canonical(*AC_TABLE)[0]
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        value = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size | value) << eob_length) | eob
        lengths[d + 255] = length + size + eob_length
    return bits, lengths


BITS, LENGTHS = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, table: tuple[list[int], list[int]]) -> bytes:
    return _segment(DHT, bytes([kind << 4, *table[0], *table[1]]))


_BEFORE = bytes([0xFF, SOI]) + _segment(DQT, bytes([0] + [8] * 64))
_AFTER = _table(0, DC_TABLE) + _table(1, AC_TABLE) + _segment(DRI, struct.pack(">H", ACROSS)) + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))


def _header(rows: int) -> bytes:
    return _BEFORE + _segment(SOF0, struct.pack(">BHHBBBB", 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0)) + _AFTER


def pad(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of 64 bytes."""
    return raw + bytes(max(ACROSS, -(-len(raw) // ACROSS) * ACROSS) - len(raw))


def _entropy(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows with stuffed zeros, two bytes free after each row for its marker; the ends of rows before those."""
    diff = np.diff(samples.astype(np.int16) - 128, axis=1, prepend=0) + 255
    bits, lengths = BITS[diff], LENGTHS[diff]
    ends = np.cumsum(lengths, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    first = np.cumsum(row_bytes) - row_bytes
    at = ((first << 3)[:, None] + ends - lengths).ravel()
    value = bits.ravel() << (24 - lengths.ravel() - (at & 7))  # 15 bits at most, shifted by 7 at most
    byte, total = at >> 3, int(row_bytes.sum())
    coded = sum(np.bincount(byte + k, (value >> (16 - 8 * k)) & 255, total + 2) for k in range(3))[:total].astype(np.int64)
    last = first + row_bytes - 1
    coded[last] += (1 << ((row_bytes << 3) - ends[:, -1])) - 1
    stuffed = coded == 255
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(len(samples)), row_bytes)
    row_ends = place[last] + 1 + stuffed[last]
    out = np.zeros(int(row_ends[-1]) + 2, np.uint8)
    out[place] = coded
    out[row_ends] = 0xFF
    return out, row_ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream per payload; each a positive multiple of 64 bytes."""
    images = [(k, p[i : i + ACROSS * ROWS]) for k, p in enumerate(payloads) for i in range(0, len(p), ACROSS * ROWS)]
    parts: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(images):
        some, size = [], 0
        while at < len(images) and (not some or size + len(images[at][1]) <= STEP_BYTES):
            some.append(images[at])
            size += len(images[at][1])
            at += 1
        rows = [len(p) // ACROSS for _, p in some]
        out, ends = _entropy(np.frombuffer(b"".join(p for _, p in some), np.uint8).reshape(-1, ACROSS))
        within = np.concatenate([np.arange(r) for r in rows])
        out[ends + 1] = RST0 + within % 8
        last = np.cumsum(rows) - 1
        out[ends[last] + 1] = EOI
        raw, start = out.tobytes(), 0
        for (k, _), r, end in zip(some, rows, (ends[last] + 2).tolist(), strict=True):
            parts[k].append(_header(r) + raw[start:end])
            start = end
    return [b"".join(p) for p in parts]


class Image:
    """What the markers of one image say, and its scans as (components, tables, restart interval, entropy-coded bytes)."""

    def __init__(self):
        self.width = self.height = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.quantisers: dict[int, int] = {}  # of DC only
        self.scans: list[tuple] = []


def parse(raw: bytes) -> list[Image]:
    """The images of a stream, one after another."""
    images, image, tables, interval, at = [], None, {}, 0, 0
    data = np.frombuffer(raw, np.uint8)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0) & (data[1:] != 0xFF)) if len(data) > 1 else np.zeros(0, int)
    kinds = data[marks + 1] if len(marks) else marks
    enders = marks[(kinds < RST0) | (kinds > RST7)] if len(marks) else marks
    while at < len(raw):
        if raw[at] != 0xFF or at + 1 >= len(raw):
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        at += 2
        if marker == SOI:
            image, tables, interval = Image(), {}, 0
            continue
        if marker == EOI:
            images.append(image)
            image = None
            continue
        if image is None:
            raise ValueError("a segment stands outside an image")
        (size,) = struct.unpack_from(">H", raw, at)
        body = raw[at + 2 : at + size]
        at += size
        if marker in REFUSED:
            raise ValueError("only baseline files can be read")
        if marker == SOF0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [(c, hv >> 4, hv & 15, q) for c, hv, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        elif marker == DQT:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                image.quantisers[k] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + (128 if wide else 64) :]
        elif marker == DHT:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0] >> 4, body[0] & 15] = (counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == DRI:
            (interval,) = struct.unpack(">H", body)
        elif marker == SOS:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            after = np.searchsorted(enders, at)
            end = int(enders[after]) if after < len(enders) else len(raw)
            image.scans.append((chosen, dict(tables), interval, raw[at:end]))
            at = end
    return images


class _Lanes:
    """Restart intervals that are decoded in step."""

    def __init__(self):
        self.data, self.start, self.blocks, self.layouts, self.layout = [], [], [], [], []
        self.size, self.known, self.tables, self.table_of = 0, {}, [], {}

    def table(self, table: tuple[list[int], list[int]]) -> int:
        key = (tuple(table[0]), tuple(table[1]))
        if key not in self.table_of:
            self.table_of[key] = len(self.tables)
            self.tables.append(lookup(*table))
        return self.table_of[key]

    def add(self, scan: bytes, slots: list[tuple[int, int, int]], units: int, interval: int) -> tuple[int, int]:
        """slots: component, DC and AC table of each block of a unit. Returns the lanes' range."""
        key = tuple(slots)
        if key not in self.known:
            self.known[key] = len(self.layouts)
            self.layouts.append(slots)
        data = np.frombuffer(scan, np.uint8)
        marked = (data[:-1] == 0xFF) & (data[1:] >= RST0) & (data[1:] <= RST7)
        cuts = np.flatnonzero(marked)
        stuffed = np.zeros(len(data), bool)
        stuffed[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
        gone = stuffed
        gone[cuts] = gone[cuts + 1] = True
        kept = data[~gone]
        starts = np.concatenate([[0], cuts + 2])
        starts = starts - np.concatenate([[0], np.cumsum(gone)])[starts]
        lanes = -(-units // interval) if interval else 1
        if lanes != len(starts):
            raise ValueError("restart markers don't fit the restart interval")
        first = len(self.start) and sum(map(len, self.start))
        self.start.append(starts + self.size)
        n = np.full(lanes, interval or units, np.int64)
        n[-1] = units - (lanes - 1) * (interval or units)
        self.blocks.append(n * len(slots))
        self.layout.append(np.full(lanes, self.known[key], np.int64))
        self.data += [kept, np.zeros(8, np.uint8)]
        self.size += len(kept) + 8
        return first, first + lanes

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """DC coefficients of all blocks, lane by lane in the order of the scan, and where each lane's begin."""
        data = np.concatenate([*self.data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        tables = np.concatenate(self.tables)
        most = max(map(len, self.layouts))
        kinds = np.zeros((len(self.layouts), most, 3), np.int64)
        units = np.array([len(x) for x in self.layouts])
        for i, slots in enumerate(self.layouts):
            kinds[i, : len(slots)] = slots
        kinds[:, :, 1:] <<= 16
        bit = np.concatenate(self.start) << 3
        blocks, layout = np.concatenate(self.blocks), np.concatenate(self.layout)
        first = np.cumsum(blocks) - blocks
        out = np.zeros(int(blocks.sum()), np.int32)
        at, end = first.copy(), first + blocks
        slot, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
        before = np.zeros((len(bit), 1 + int(kinds[:, :, 0].max())), np.int64)
        live, limit = np.arange(len(bit)), len(window) - 1
        while len(live):
            b, kk = bit[live], k[live]
            if b.max() >> 3 > limit:
                raise ValueError("the entropy-coded data ends early")
            kind = kinds[layout[live], slot[live]]
            is_dc = kk == 0
            ahead = (window[b >> 3].astype(np.int64) >> (16 - (b & 7))) & 0xFFFF
            found = tables[np.where(is_dc, kind[:, 1], kind[:, 2]) + ahead]
            if not found.all():
                raise ValueError("no Huffman code fits")
            b, symbol = b + (found >> 8), found & 255
            size = symbol & 15
            if is_dc.any():
                d = np.flatnonzero(is_dc)
                n = size[d].astype(np.int64)
                extra = (window[np.minimum(b[d] >> 3, limit)].astype(np.int64) >> (32 - (b[d] & 7) - n)) & ((1 << n) - 1)
                value = np.where(extra < (1 << n >> 1), extra - (1 << n) + 1, extra)
                lane = live[d]
                before[lane, kind[d, 0]] += value
                out[at[lane]] = before[lane, kind[d, 0]]
            b += size
            kk = np.where(is_dc, 1, np.where(symbol == 0, 64, np.where(symbol == ZERO_RUN, kk + 16, kk + (symbol >> 4) + 1)))
            bit[live] = b
            done = kk >= 64
            kk[done] = 0
            k[live] = kk
            if done.any():
                lane = live[done]
                at[lane] += 1
                slot[lane] = (slot[lane] + 1) % units[layout[lane]]
                live = live[at[live] < end[live]]
        return out, first


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Per stream and image: width, height and the luminance means of its 8 x 8 blocks (uint8)."""
    lanes, plans = _Lanes(), []
    for raw in streams:
        plans.append([])
        for image in parse(raw):
            across, down = max(c[1] for c in image.components), max(c[2] for c in image.components)
            luma = image.components[0]
            for chosen, tables, interval, scan in image.scans:
                named = [(next(c for c in image.components if c[0] == i), dc, ac) for i, dc, ac in chosen]
                if luma not in [c for c, _, _ in named]:
                    continue
                alone = len(named) == 1  # then a unit is one block, and blocks outside the image are left out
                slots, own = [], []
                for n, (c, dc, ac) in enumerate(named):
                    for j in range(1 if alone else c[1] * c[2]):
                        if c is luma:
                            own.append((len(slots), j))
                        slots.append((n, lanes.table(tables[0, dc]), lanes.table(tables[1, ac])))
                h, v = (1, 1) if alone else (luma[1], luma[2])
                size = lambda n, f, most: -(-(-(-n * f // most)) // 8)
                wide, high = size(image.width, luma[1], across), size(image.height, luma[2], down)
                if alone:
                    units = (wide, high)
                else:
                    units = (-(-image.width // (8 * across)), -(-image.height // (8 * down)))
                first, last = lanes.add(scan, slots, units[0] * units[1], interval)
                plans[-1].append((image, first, units, slots, own, (h, v), (wide, high), image.quantisers[luma[3]]))
                break
    if not any(plans):
        return [[] for _ in streams]
    dc, starts = lanes.decode()
    found = []
    for plan in plans:
        found.append([])
        for image, first, units, slots, own, (h, v), (wide, high), quantiser in plan:
            n = units[0] * units[1] * len(slots)
            blocks = dc[starts[first] : starts[first] + n].reshape(units[1], units[0], len(slots))
            plane = np.zeros((units[1] * v, units[0] * h), np.int64)
            for k, j in own:
                plane[j // h :: v, j % h :: h] = blocks[:, :, k]
            means = np.clip((plane[:high, :wide] * quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            found[-1].append((image.width, image.height, means))
    return found


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8 x 8 reduction are above their mean."""
    high, wide = thumbnail.shape
    rows, columns = np.arange(8) * high // 8, np.arange(8) * wide // 8
    sums = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), rows, axis=0), columns, axis=1)
    counts = np.outer(np.maximum(1, np.diff(np.append(rows, high))), np.maximum(1, np.diff(np.append(columns, wide))))
    cells = sums / counts
    return np.packbits(cells > cells.mean()).tobytes().hex()


def payload(images: list[tuple[int, int, np.ndarray]]) -> bytes:
    """The bytes that encode() stored."""
    return b"".join(means.tobytes() for _, _, means in images)


def _groups(values: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for v in values:
        if some and size + len(v) > STEP_BYTES:
            yield some
            some, size = [], 0
        some.append(v)
        size += len(v)
    if some:
        yield some


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a JPEG stream. Null text counts as empty (64 zero bytes are stored);
    repeated rows are stored each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = [m for some in _groups([pad(r) for r in raw]) for m in encode(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads stored media back: doc_id, n_bytes, payload and media digests, and feature, which has per image
    width x height, thumbnail width x height and the thumbnail's average hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for some in _groups(batch.column(2).to_pylist()):
                for m, images in zip(some, thumbnails(some), strict=True):
                    p = payload(images)
                    names = (f"{w}x{h},{t.shape[1]}x{t.shape[0]},{average_hash(t)}" for w, h, t in images)
                    for column, v in zip(out, (len(p), sha(p), zlib.crc32(p[-64:]), len(m), sha(m), ";".join(names)), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document as baseline JPEG, read back."""
    return features(store(common.table(spark, sf_dir, "documents")))
