"""The registered queries of the operators."""

from __future__ import annotations

from . import bpe, fingerprint, jpeg, mixing, neardup, quality, repeats, tokenfile, toxicity, urlfilter

QUERIES = {
    "op1_suffix_array": repeats.query,
    "op2_url_filter": urlfilter.query,
    "op3_byte_bpe": bpe.query,
    "op4_bagminhash": neardup.query,
    "op5_token_file": tokenfile.query,
    "op6_mixing": mixing.query,
    "op7_jpeg_media": jpeg.query,
    "op8_toxicity": toxicity.query,
    "op9_fingerprint": fingerprint.query,
    "op10_compression_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {}
