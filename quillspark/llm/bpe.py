"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A piece (one match of the splitting pattern) starts as single bytes in a linked list. Every adjacent pair that the rank
table knows has its position put into the bucket of its rank; a two-level bitmap tells which buckets hold something, and
find-first-set on it gives the next rank. Entries are never removed when a neighbour's merge changes a pair: on reading
a bucket, an entry whose pair no longer has that rank is skipped. The work for a piece of n bytes is O(n) queue steps,
so a pre-token of a million letters costs no more a byte than a word does.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

LEAF_BITS = 8  # a leaf of the bitmap covers 256 ranks
LEAF_MASK = (1 << LEAF_BITS) - 1
BIT = [1 << k for k in range(4096)]  # by place in a leaf and by leaf; ranks stay below 2**20
CACHED_PIECES = 1_000_000  # pieces a worker remembers; memory only, results don't depend on it
CACHED_LENGTH = 64  # characters; longer pieces are not remembered


class _Pieces(dict):
    """Packed ids of pieces already seen."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.bpe.merge(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                for k in list(islice(self, len(self) // 2)):  # those learnt first
                    del self[k]
            self[piece] = packed
        return packed


class Bpe:
    """Encoder and decoder over a rank file of base64 token and rank per line."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.leaves = [0] * ((max(self.ranks.values()) >> LEAF_BITS) + 1)
        self.pieces = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The queue is written out here: leaves has a bit per rank, root one per leaf, buckets the
        positions by rank; all are empty again at the end."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, leaves, root, buckets = len(piece), self.leaves, 0, {}
        following, before, current = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            new = get(piece[i : i + 2])
            if new is not None:
                current[i] = new
                if new in buckets:
                    buckets[new].append(i)
                else:
                    buckets[new] = [i]
                    leaf = new >> LEAF_BITS
                    leaves[leaf] |= BIT[new & LEAF_MASK]
                    root |= BIT[leaf]
        while root:
            leaf = (root & -root).bit_length() - 1
            bits = leaves[leaf]
            lowest = bits & -bits
            rank = (leaf << LEAF_BITS) + lowest.bit_length() - 1
            bits ^= lowest
            leaves[leaf] = bits
            if not bits:
                root ^= BIT[leaf]
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            for k, p in enumerate(bucket):
                if current[p] != rank:
                    continue  # stale: the pair at p has changed
                q = following[p]
                end = following[q]
                following[p], current[q], current[p], least = end, -1, -1, rank
                if end < n:
                    before[end] = p
                    new = get(piece[p : following[end]])
                    if new is not None:
                        current[p] = new
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            buckets[new] = [p]
                            leaf = new >> LEAF_BITS
                            leaves[leaf] |= BIT[new & LEAF_MASK]
                            root |= BIT[leaf]
                p = before[p]
                if p >= 0:
                    new = get(piece[p:end])
                    if new is None:
                        current[p] = -1
                    else:
                        current[p] = new
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            buckets[new] = [p]
                            leaf = new >> LEAF_BITS
                            leaves[leaf] |= BIT[new & LEAF_MASK]
                            root |= BIT[leaf]
                if least < rank and k + 1 < len(bucket):  # a smaller rank has come up: the rest of this bucket waits
                    buckets[rank] = bucket[k + 1 :]
                    leaf = rank >> LEAF_BITS
                    leaves[leaf] |= BIT[rank & LEAF_MASK]
                    root |= BIT[leaf]
                    break
        out, p = [], 0
        while p < n:
            end = following[p]
            out.append(self.ranks[piece[p:end]])
            p = end
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(rank_file: str, pattern: str) -> Bpe:
    """One encoder per worker process."""
    key = (rank_file, pattern)
    if key not in _LOADED:
        _LOADED[key] = Bpe(*key)
    return _LOADED[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (binary, little-endian u32). A null text
    counts as empty; an empty text has no ids. Every input row gives one row, repeated rows too; a null doc_id stays null.
    Columns other than doc_id and text are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_file, pattern)
        for batch in batches:
            counts, hashes, back, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document, encoded with the multilingual 50k ranks and decoded."""
    import public_tokenizers

    from . import common

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
