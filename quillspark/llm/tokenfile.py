"""Token-ID shards: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard is a plain zstandard stream (any zstd tool can decompress it) made of
  one frame per document: its ids as little-endian unsigned 32-bit integers;
  a skippable frame with the documents' ids, so that a document is found without reading frames;
  a skippable frame with the seek table of the public seekable format: per frame the compressed size, the size and the
  low 32 bits of the content's XXH64, then the number of frames, a flag byte and the magic number.
A reader fetches the tail, then only the frames it wants, and checks each against its checksum.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("known", "u1")])

LEVEL = 1
CACHED_PIECES = 400_000  # pieces a worker remembers; memory only, results don't depend on it
CACHED_LENGTH = 64
ENCODED_AT_ONCE = 1_800_000
LEARNT_AT_ONCE = 5_000  # new pieces that are encoded together
MARK = "\x01"  # a piece of its own wherever white space surrounds it
WORD_END = "</w>"
BASE = 0x9E3779B97F4A7C15  # odd; of the hash that tells pieces apart
EXOTIC = re.compile("[İɐ-\U0010ffff]").search  # beyond Latin letters, or with an unusual lower case
LETTER, SIGN, OTHER = 0, 1, 2
#: Of a byte of lower-case Latin text; the apostrophe, digits and U+0080 to U+00BF (first byte C2) are neither.
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0x100)]] = LETTER
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = SIGN


class ShardWriter:
    """Appends documents to an open binary file; close() writes the index and the seek table."""

    def __init__(self, out):
        self.out, self.frames, self.docs = out, [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack(ids)
        self.out.write(frame)
        self.frames.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is not None))

    def close(self) -> None:
        index = np.array(self.docs, DOC).tobytes()
        self.out.write(HEADER.pack(SKIPPABLE_INDEX, len(index)) + index)
        seek = np.array(self.frames, ENTRY).tobytes() + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(HEADER.pack(SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class ShardReader:
    """Reads documents of a shard by their place in it."""

    def __init__(self, file):
        self.file = file
        file.seek(0, os.SEEK_END)
        size = file.tell()
        file.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a shard: its seek table is missing")
        at = size - FOOTER.size - n * ENTRY.itemsize
        file.seek(at)
        self.entries = np.frombuffer(file.read(n * ENTRY.itemsize), ENTRY)
        file.seek(at - HEADER.size - n * DOC.itemsize)
        docs = np.frombuffer(file.read(n * DOC.itemsize), DOC)
        self.doc_ids = [int(d["doc_id"]) if d["known"] else None for d in docs]
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.entries)

    def read(self, k: int) -> bytes:
        """The ids of the k-th document; only its frame is read."""
        e = self.entries[k]
        self.file.seek(int(self.starts[k]))
        ids = self.unpack(self.file.read(int(e["packed"])), max_output_size=max(1, int(e["size"])))
        if len(ids) != e["size"] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != e["checksum"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return ids


class _Words(dict):
    """Packed ids by piece of text.

    Both normaliser and splitter of the vocabulary treat white space as a boundary, so a text's ids are those of its space-
    or newline-separated words in a row. In a text of Latin letters (put into lower case first, as the normaliser would) a
    word of letters and then ASCII punctuation is two pieces. The library encodes pieces not seen before, many at once: a
    piece that is all letters or all punctuation ends where a token with the end-of-word mark does; others stand between MARKs.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must stand for their text as it is")
        #: Texts are split at these before anything else, as the library does.
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.tokenizer.encode_special_tokens = True  # pieces don't hold added tokens, but may once they are in lower case
        (self.mark,) = self._ids(MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[bytes], pure: bool) -> list[bytes]:
        between = b" " if pure else f" {MARK} ".encode()
        ids = np.array(self._ids(between.join(new).decode()), "<u4")
        ends = np.flatnonzero(self.ends[ids])[:-1] + 1 if pure else np.flatnonzero(ids == self.mark) if len(new) > 1 else np.zeros(0, int)
        if len(ends) != len(new) - 1:
            raise ValueError("the vocabulary doesn't keep pieces apart")
        packed, cuts = ids.tobytes(), [0, *(ends * 4).tolist(), 4 * len(ids)]
        skip = 0 if pure else 4
        return [packed[a + skip * (k > 0) : b] for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def _fill(self, pieces: list[bytes], pure: list[bool]) -> list[bytes]:
        """Packed ids of each distinct piece."""
        found = list(map(self.get, pieces))
        if None in found:
            missing = [k for k, v in enumerate(found) if v is None]
            for kind in (True, False):
                some = [k for k in missing if pure[k] == kind]
                odd = [] if kind else [k for k in some if MARK.encode() in pieces[k]]
                for k in odd:
                    found[k] = np.array(self._ids(pieces[k].decode()), "<u4").tobytes()
                some = [k for k in some if found[k] is None]
                for i in range(0, len(some), LEARNT_AT_ONCE):
                    part = some[i : i + LEARNT_AT_ONCE]
                    for k, ids in zip(part, self._learn([pieces[k] for k in part], kind), strict=True):
                        found[k] = ids
            self.update((pieces[k], found[k]) for k in missing if len(pieces[k]) <= CACHED_LENGTH)
            if len(self) > CACHED_PIECES:
                for k in list(islice(self, len(self) // 2)):  # those learnt first
                    del self[k]
        return found

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode() on ENCODED_AT_ONCE characters or one text at a time."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > ENCODED_AT_ONCE:
                yield from self.encode(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        if some:
            yield from self.encode(some)

    def _plainly(self, text: str) -> bytes:
        words = text.encode().replace(b"\n", b" ").split(b" ")
        own = list(dict.fromkeys(words))
        ids = dict(zip(own, self._fill(own, [False] * len(own)), strict=True))
        return b"".join(map(ids.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Pieces are told apart by a 64-bit hash, so that each distinct one is looked up once; all are then compared with
        the ones found for them, so a clash of hashes can't go unnoticed."""
        if self.split and any(map(self.split.search, texts)):
            cut = [[p for p in self.split.split(t) if p] for t in texts]
            plain = iter(self.encode([p for c in cut for p in c if p not in self.added]))
            return [b"".join(self.added[p] if p in self.added else next(plain) for p in c) for c in cut]
        exotic = [bool(EXOTIC(t)) for t in texts]
        if any(exotic):
            latin = iter(self.encode([t for t, e in zip(texts, exotic, strict=True) if not e]))
            return [self._plainly(t) if e else next(latin) for t, e in zip(texts, exotic, strict=True)]
        if not texts:
            return []
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        kind = KINDS[data]
        kind[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = OTHER  # the signs of multiplication and division
        stops = np.flatnonzero(kind != LETTER)
        stop = stops[np.searchsorted(stops, starts)]  # after a word's letters
        signs = np.concatenate([[0], np.cumsum(kind == SIGN)])
        pure = signs[ends] - signs[stop] == ends - stop  # letters, then nothing but punctuation
        two = pure & (stop > starts) & (stop < ends)
        order = np.arange(len(starts)) + np.cumsum(two) - two
        starts2, ends2, pure2 = (np.zeros(len(starts) + int(two.sum()), x) for x in (np.int64, np.int64, bool))
        starts2[order], ends2[order], pure2[order] = starts, np.where(two, stop, ends), pure & (ends > starts)
        starts2[order[two] + 1], ends2[order[two] + 1], pure2[order[two] + 1] = stop[two], ends[two], True
        lengths = ends2 - starts2
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)))])
        hashes = (sums[ends2] - sums[starts2]) * _powers(pow(BASE, -1, 1 << 64), len(data))[starts2]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        here = (starts2 - (np.cumsum(lengths) - lengths)).repeat(lengths) + np.arange(lengths.sum())
        there = here + (starts2[first][which] - starts2).repeat(lengths)
        if not ((lengths[first][which] == lengths).all() and (data[here] == data[there]).all()):
            return [self._plainly(t) for t in texts]
        everything = data.tobytes()
        found = self._fill([everything[a:b] for a, b in zip(starts2[first].tolist(), ends2[first].tolist(), strict=True)], pure2[first].tolist())
        ids, n = np.frombuffer(b"".join(found), "<u4"), np.array(list(map(len, found)), np.int64) >> 2
        each = n[which]
        upto = np.cumsum(each)
        out = ids[((np.cumsum(n) - n)[which] - (upto - each)).repeat(each) + np.arange(upto[-1])]
        last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in raw]) - 1)
        cuts = [0, *(upto[order[last] + two[last]] * 4).tolist()]
        packed = out.astype("<u4", copy=False).tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        size = max(1 << 21, n)
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept)
        if n <= 1 << 21:
            _POWERS[base] = kept
    return kept[:n]


_LOADED: dict[str, _Words] = {}


def words(path: str) -> _Words:
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[dict]:
    """Writes every whole text's ids and end_id into shards under folder, in ascending doc_id order (nulls first; equal ids
    by text). Returns a row per shard: shard, path, n_docs, n_tokens. There is a shard per partition of the sort.

    A shard is written under a name of its attempt and then renamed, so a task that is run again or twice leaves one file.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, context = words(tokenizer), TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        shard = context.partitionId()
        path, own = f"{base}/shard-{shard:06d}.zst", f"{base}/.shard-{shard:06d}-{context.taskAttemptId()}"
        writer, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), vocabulary.encode_all(texts), strict=True):
                writer = writer or ShardWriter(fs.open_output_stream(own, compression=None))
                writer.add(doc_id, ids + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer:
            writer.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long").collect()  # a row per file
    return sorted((s.asDict() for s in shards), key=lambda s: s["shard"])


def read_shards(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Rows from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, frame."""
    start, rows = 0, []
    for s in shards:
        rows.append((s["shard"], s["path"], start))
        start += s["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    reader, at, out = ShardReader(file), start, []
                    for k, doc_id in enumerate(reader.doc_ids):
                        ids = reader.read(k)
                        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), shard, k))
                        at += len(ids) // 4
                        if len(out) == 10_000 or k + 1 == len(reader):
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "frame"])
                            out = []

    files = spark.createDataFrame(rows, "shard long, path string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(run, schema)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs as shards in the shared folder and returns what the shards, read again, hold.

    Null text counts as empty and gives the end id alone; repeated rows give a frame each; a null doc_id is kept as null
    and comes first; an empty table gives no shard and no row. Columns other than doc_id and text are not read.
    """
    folder = common.shared_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, folder, write_shards(docs, tokenizer, end_id, folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with the 49k word vocabulary, end id 2."""
    import public_tokenizers

    return token_file(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
