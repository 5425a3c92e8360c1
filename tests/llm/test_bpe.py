import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Bpe(PATH, P.PATTERN)


def ids(text):
    packed = OURS.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("abé \n'sn0", max_size=300))
def test_as_the_library(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_long_pieces():
    for text in ("a" * 20_000, "abcab" * 5_000, "thenation" * 3_000, "é" * 5_000, " " * 9_999 + "x", "<|endoftext|>"):
        assert ids(text) == THEIRS.encode_ordinary(text)


def plain(piece, ranks):
    """The leftmost pair of least rank is merged again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=25), st.text("abc", max_size=40), st.randoms(use_true_random=False))
def test_any_ranks_even_out_of_order(tmp_path_factory, tokens, text, rng):
    """Also where a longer token's rank is smaller than those of its parts, so that a bucket has to wait."""
    rng.shuffle(tokens)
    ranks = {t.encode(): i * 97 for i, t in enumerate(["a", "b", "c", *tokens])}
    path = tmp_path_factory.mktemp("ranks") / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    if text:
        assert bpe.Bpe(str(path), ".+").merge(text.encode()) == plain(text.encode(), ranks)


def test_rows(spark):
    rows = [(1, "the nation", "x"), (2, None, "x"), (3, "", None), (None, "a b", "x"), (1, "the nation", "x")]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, P.PATTERN).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(got, rows, strict=True):
        e = THEIRS.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens) == (i, len(e))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
