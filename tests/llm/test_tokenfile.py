import io
import struct
import zlib

import public_tokenizers as P
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import tokenfile

PATH = P.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=100) | st.text("aBÉĲİŉſǅ.,*'_$ ", max_size=60) | st.text("aBé×÷ñº«Çß.,!' 1", max_size=60) | st.text("aBé' \n\t ́Σ1!<|>", max_size=200))
def test_words_as_whole_text(text):
    (packed,) = tokenfile.words(PATH).encode([text])
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == THEIRS.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>", "<|endoftext|><|endoftext|>x", "x<|startoftext|>y <|endoftext|", "A<|ENDOFTEXT|>b<|endoftext|>C\n", "é<|startoftext|>\u0301", "<|endoftext|> <|endoftext|>", "<|<|endoftext|>|>", "日<|endoftext|>本 'd<|startoftext|>ll"])
def test_added_tokens_as_the_library_has_them(text):
    for found, t in zip(tokenfile.words(PATH).encode(["plain", text, "more " + text]), ["plain", text, "more " + text], strict=True):
        assert list(struct.unpack(f"<{len(found) // 4}I", found)) == THEIRS.encode(t, add_special_tokens=False).ids


class Kept(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


def shard(docs):
    out = Kept()
    w = tokenfile.ShardWriter(out)
    for d in docs:
        w.add(*d)
    w.close()
    return out.kept


def test_shard_round_trip_and_damage():
    docs = [(5, b"\x01\0\0\0" * 1000), (None, b""), (-3, b"\x02\0\0\0")]
    raw = shard(docs)
    r = tokenfile.ShardReader(io.BytesIO(raw))
    assert r.doc_ids == [5, None, -3] and [r.read(k) for k in (2, 0, 1)] == [docs[2][1], docs[0][1], b""]
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(10**6) for _ in range(1))
    assert whole == b"".join(d[1] for d in docs)
    bad = bytearray(raw)
    bad[int(r.starts[2]) + 7] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.ShardReader(io.BytesIO(bytes(bad))).read(2)
    with pytest.raises(ValueError):
        tokenfile.ShardReader(io.BytesIO(raw[:-1] + b"x"))


def test_rows(spark):
    rows = [(7, "Hello  the nation", "x"), (3, None, "x"), (None, "a", "x"), (12, "", "x"), (7, "Hello  the nation", "x")] + [(100 + i, f"word{i} and more", "x") for i in range(200)]
    got = sorted(tokenfile.token_file(spark.createDataFrame(rows, "doc_id long, text string, start string"), PATH).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text, _) in zip(got, sorted(rows, key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        ids = [*THEIRS.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_empty_table(spark):
    assert tokenfile.token_file(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
