import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import jpeg


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_round_trip(raws):
    padded = [jpeg.pad(r) for r in raws]
    assert [jpeg.payload(i) for i in jpeg.thumbnails(jpeg.encode(padded))] == padded


def test_extremes_and_several_images():
    big = random.Random(1).randbytes(jpeg.ACROSS * jpeg.ROWS + 128)
    for p in (bytes(64), b"\xff" * 640, bytes([0, 255]) * 320, big):
        (m,) = jpeg.encode([p])
        (images,) = jpeg.thumbnails([m])
        assert jpeg.payload(images) == p and m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"
    assert len(images) == 2


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, length):
        self.bits += format(code, f"0{length}b") if length else ""

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        raw = int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")
        self.bits = ""
        return raw.replace(b"\xff", b"\xff\x00")


def plain_jpeg(width, height, factors, interval, rng):
    """A baseline file written plainly, with AC coefficients and zero runs; its luminance DC values by block row."""
    dc = ([0, 2, 3, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(11)))
    ac_symbols = [0x00, 0x01, 0x12, 0x53, 0xF0, 0x31, 0xF1]
    ac = ([0, 2, 3, 2] + [0] * 12, ac_symbols)
    dcc, acc = jpeg.canonical(*dc), jpeg.canonical(*ac)
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    units = (-(-width // (8 * across)), -(-height // (8 * down)))
    if len(factors) == 1:
        units = (-(-width // 8), -(-height // 8))
    plane = np.zeros((units[1] * factors[0][1], units[0] * factors[0][0]), int) if len(factors) > 1 else np.zeros((units[1], units[0]), int)
    out, bits, before, n = b"", Bits(), [0] * len(factors), 0
    for y in range(units[1]):
        for x in range(units[0]):
            if interval and n and n % interval == 0:
                out += bits.flush() + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
                before = [0] * len(factors)
            n += 1
            for c, (h, v) in enumerate(factors):
                h, v = (1, 1) if len(factors) == 1 else (h, v)
                for j in range(h * v):
                    value = rng.randint(-60, 60)
                    if c == 0:
                        plane[y * v + j // h, x * h + j % h] = value
                    d, before[c] = value - before[c], value
                    size = abs(d).bit_length()
                    bits.put(*dcc[size])
                    bits.put(d if d > 0 else d + (1 << size) - 1, size)
                    k = 1
                    while k < 64 and rng.random() < 0.8:
                        s = rng.choice(ac_symbols[1:])
                        if k + (s >> 4) + 1 > 64:
                            break
                        bits.put(*acc[s])
                        bits.put(rng.randrange(1 << (s & 15)), s & 15)
                        k += (s >> 4) + 1
                    if k < 64:
                        bits.put(*acc[0])
    out += bits.flush()
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"note") + jpeg._segment(jpeg.DQT, bytes([0] + [6] * 64 + [1] + [9] * 64))
    parts = b"".join(bytes([c + 1, h << 4 | v, min(c, 1)]) for c, (h, v) in enumerate(factors))
    head += jpeg._segment(jpeg.SOF0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + parts)
    head += jpeg._segment(jpeg.DHT, bytes([0, *dc[0], *dc[1], 0x10, *ac[0], *ac[1]]))
    if interval:
        head += jpeg._segment(jpeg.DRI, interval.to_bytes(2, "big"))
    head += jpeg._segment(jpeg.SOS, bytes([len(factors)]) + b"".join(bytes([c + 1, 0]) for c in range(len(factors))) + bytes([0, 63, 0]))
    luma = factors[0]
    wide = math.ceil(math.ceil(width * luma[0] / across) / 8)
    high = math.ceil(math.ceil(height * luma[1] / down) / 8)
    return head + out + b"\xff\xd9", np.clip((plane[:high, :wide] * 6 + 4 >> 3) + 128, 0, 255)


@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_files(factors, interval):
    rng = random.Random(repr((factors, interval)))
    files = [plain_jpeg(w, h, factors, interval, rng) for w, h in ((8, 8), (37, 21), (64, 40), (100, 9))]
    for (raw, expected), images in zip(files, jpeg.thumbnails([f[0] for f in files]), strict=True):
        assert (images[0][2] == expected).all() and images[0][2].shape == expected.shape


def test_refused():
    (m,) = jpeg.encode([bytes(64)])
    with pytest.raises(ValueError):
        jpeg.thumbnails([m.replace(b"\xff\xc0", b"\xff\xc2")])
    with pytest.raises(ValueError):
        jpeg.thumbnails([b"text"])


def test_rows(spark):
    rows = [(1, "The nation é", "x"), (2, None, "x"), (3, "", "x"), (None, "y" * 5000, "x"), (1, "The nation é", "x")]
    got = jpeg.features(jpeg.store(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    for r, (i, text, _) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        p = jpeg.pad(raw)
        (m,) = jpeg.encode([p])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(raw), len(p), sha(p))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(p[-64:]), len(m), sha(m))
    assert got[0].feature == got[4].feature and got[1].feature == got[2].feature != got[0].feature
    assert jpeg.features(jpeg.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
