"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banding, exact verification.

A shingle with multiplicity w stands for the interval (0, w] of weights, which are discretised to whole numbers. The weight
axis is split into (0, 1], (1, 2], (2, 4], (4, 8] ...; each of these, per shingle, is the root of a hierarchy of Poisson
processes in time, of rate equal to their length. A process is split in halves at its first point: the point falls into
either half by a coin, and the other half's first point comes an exponential time later. Halves that begin at w or above
are dropped, the others are split again; the process of a unit of weight gives its points to signature components. A
component's value is the time of its first point. All is drawn from hashes, so that two multisets share exactly the points
of the weights that they share, and a component is equal with probability sum of minima over sum of maxima. A process is
dropped, whatever its length, once its time passes the largest component, which after a few shingles is almost at once.

Texts that are equal are one node. Nodes that agree on a whole band of components are candidates, and those are decided by
the exact overlap of their multisets. In a bucket the node that is most popular (sum of the sizes of all its buckets) leads
and the others are compared with it; PROBES times more, what is still apart in a bucket is compared with another node of the
bucket's largest component. Each of these rounds costs a comparison per node, and where copies are near each other little
is left. The nodes that are left outside of the largest component of a bucket are then a query set: in blocks, they are
compared with every node that they are connected with through such buckets, by an inverted index of the block's shingles. So
every pair of candidates has been compared or is connected, and no group meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components, extended

SHINGLE = 5  # words
ALIKE = 0.8  # weighted Jaccard similarity from which texts are near-duplicates
BANDS, ROWS = 24, 4  # at a similarity of 0.8 all bands differ with probability 3e-6
PROBES = 1
BLOCK = 256  # nodes of the query set in an index
COMPARED_AT_ONCE = 64
STREAM = 2_000  # about so many nodes are compared with a block in one task
TEXT_AT_ONCE = 2_000_000  # bytes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(1 << 21, n), base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept)
        if n <= 1 << 21:
            _POWERS[base] = kept
    return kept[:n]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and multiplicity of each distinct shingle of each text. Words stand between ASCII white space; a
    text of fewer than SHINGLE words, but at least one, is a single shingle."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    gaps = np.flatnonzero(_SPACE[data])
    starts = np.concatenate([[0], gaps[:-1] + 1])
    real = gaps > starts
    starts, ends = starts[real], gaps[real]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
    words = _mix((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    n = np.diff(bounds)
    short = (n > 0) & (n < SHINGLE)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, short)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    value = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        w = padded[at + k]
        if short.any():
            w = np.where(k < n[text], w, np.uint64(k))
        value = value * _ODD + w
    value = _mix(value)
    _, first, times = np.unique(_mix(value + text.astype(np.uint64) * _ODD), return_index=True, return_counts=True)
    order = np.argsort(first)
    first, times = first[order], times[order]
    return text[first], value[first], times


def signatures(n: int, text: np.ndarray, value: np.ndarray, weight: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """A row of component times for each of n texts; infinite where a text has no shingle."""
    top = int(weight.max()) if len(weight) else 0
    roots = []
    low, high, k = 0, 1, 0
    while low < top:
        chosen = np.flatnonzero(weight > low)
        roots.append((text[chosen], _mix(value[chosen] + np.uint64(k * int(_ODD) % (1 << 64))), weight[chosen], np.full(len(chosen), low), np.full(len(chosen), high - low)))
        low, high, k = high, 2 * high, k + 1
    h = np.full((n, size), np.inf)
    if not roots:
        return h
    doc, seed, w, low, length = (np.concatenate(x) for x in zip(*roots, strict=True))
    time = _waits(seed) / length
    largest = np.full(n, np.inf)
    flat = h.ravel()
    while len(doc):
        unit = length == 1
        wide = None
        if not unit.all():
            wide = [x[~unit] for x in (doc, seed, w, low, length, time)]
            doc, seed, w, low, length, time = (x[unit] for x in (doc, seed, w, low, length, time))
        component = ((_mix(seed + _ODD) >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(flat, doc * size + component, time)
        largest = h.max(axis=1)
        seed = _mix(seed + _NEXT)
        time = time + _waits(seed)
        if wide:
            doc, seed, w, low, length, time = (np.concatenate(x) for x in zip((doc, seed, w, low, length, time), *_split(*wide), strict=True))
        live = (time < largest[doc]) & (low < w)
        doc, seed, w, low, length, time = (x[live] for x in (doc, seed, w, low, length, time))
    return h


_NEXT, _LEFT, _RIGHT, _COIN = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _waits(seed: np.ndarray) -> np.ndarray:
    """Times of rate 1 from hashes."""
    return -np.log(((_mix(seed ^ _COIN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _split(doc, seed, w, low, length, time) -> Iterator[tuple]:
    """Processes of the halves of intervals: the first point at time is in one of them."""
    half = length // 2
    in_left = (_mix(seed + _COIN) >> np.uint64(63)) == 0
    for mark, start, first in ((_LEFT, low, in_left), (_RIGHT, low + half, ~in_left)):
        own = _mix(seed + mark)
        yield doc, own, w, start, half, np.where(first, time, time + _waits(own) / half)


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    bits = h.view(np.uint64).reshape(len(h), BANDS, ROWS)
    key = np.broadcast_to(_mix(np.arange(BANDS, dtype=np.uint64) + _ODD), (len(h), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key * _ODD + bits[:, :, k])
    return key.view(np.int64)


def node(text: Column) -> Column:
    """What stands for all texts equal to this one: 16 bytes of their SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node and keys (of bands; null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            keys, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT_AT_ONCE):
                    size += len(texts[end])
                    end += 1
                h = signatures(end - at, *shingles(texts[at:end]))
                keys += [None if gone else k.tolist() for gone, k in zip(np.isinf(h[:, 0]), bands(h), strict=True)]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node(F.coalesce("text", F.lit(""))).alias("node"), "text")
    return rows.mapInArrow(lambda rows: common.released(run(rows)), "doc_id long, node binary, keys array<long>")


def multiset(text: str) -> Counter:
    """The shingles of a text, exactly."""
    w = text.encode().split()
    return Counter(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else Counter([tuple(w)] * bool(w))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    get = many.get
    both = sum(min(n, get(s, 0)) for s, n in few.items())
    return both / (a.total() + b.total() - both) if both else 0.0


def verified(pairs: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough. A pair's rows with equal b stand together, so that b's
    multiset is counted once for many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, Counter()
        for batch in batches:
            good = []
            for k, (b, x, y) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if b != last:
                    last, other = b, multiset(y)
                own = multiset(x)
                if similarity(own, other) >= alike:
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    many = pairs.groupBy("b").agg(F.count("*").alias("times"))  # a leader's pairs are dealt over tasks
    both = common.join_hot(pairs.join(one, "a"), two.join(many, "b"), ["b"], pairs.count())
    return both.select("a", "b", "x", "y").mapInArrow(lambda rows: common.released(run(rows)), "a binary, b binary")


def _elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every element of the texts' multisets: a shingle and how many of it came before."""
    text, value, times = shingles([t.encode() for t in texts])
    before = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    text, value = np.repeat(text, times), np.repeat(value, times)
    return text, np.where(before == 0, value, _mix(value + before.astype(np.uint64) * _ODD))


class _Block:
    """An inverted index of the elements of some texts."""

    def __init__(self, nodes: list[bytes], labels: list[bytes], texts: list[str]):
        self.nodes, self.labels = nodes, np.array(labels, object)
        text, element = _elements(texts)
        order = np.argsort(element, kind="stable")
        self.held = text[order]
        self.elements, self.first, self.many = np.unique(element[order], return_index=True, return_counts=True)
        self.sizes = np.bincount(text, minlength=len(texts))

    def near(self, nodes: list[bytes], labels: list[bytes], texts: list[str], alike: float) -> Iterator[tuple[bytes, bytes]]:
        """For two different labels a pair of a text of the block and one of these that share enough elements."""
        told: set[tuple[bytes, bytes]] = set()
        for at in range(0, len(texts), COMPARED_AT_ONCE):
            some = texts[at : at + COMPARED_AT_ONCE]
            text, element = _elements(some)
            place = np.minimum(np.searchsorted(self.elements, element), len(self.elements) - 1)
            known = self.elements[place] == element
            place, owner = place[known], text[known]
            many = self.many[place]
            steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pair = np.repeat(owner, many) * len(self.nodes) + self.held[np.repeat(self.first[place], many) + steps]
            both = np.bincount(pair, minlength=len(some) * len(self.nodes)).reshape(len(some), -1)
            sizes = np.bincount(text, minlength=len(some))
            own = np.array(labels[at : at + COMPARED_AT_ONCE], object)
            good = (both >= alike * (sizes[:, None] + self.sizes[None, :] - both)) & (both > 0) & (own[:, None] != self.labels[None, :])
            for k, j in zip(*np.nonzero(good), strict=True):
                tie = (own[k], self.labels[j])
                if tie not in told:
                    told.add(tie)
                    yield self.nodes[j], nodes[at + k]


def in_blocks(rows: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    """Pairs (a, b) of the nodes in rows (group, node, label, asks) that ask, with any node of their group of another label,
    that are alike by hashes of their shingles; within a batch and block one pair ties two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, block = None, ([], [], []), None
        for batch in batches:
            keys, asks, *values = (c.to_pylist() for c in batch.columns)
            out: list[tuple[bytes, bytes]] = []
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and asks[end] == asks[at]:
                    end += 1
                if keys[at] != key:
                    key, asking, block = keys[at], ([], [], []), None
                part = [v[at:end] for v in values]
                if asks[at]:
                    for kept, v in zip(asking, part, strict=True):
                        kept += v
                elif asking[0]:
                    block = block or _Block(*asking)
                    out += block.near(*part, alike)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    size = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_ask"))
    rows = rows.join(size, "group").withColumns({"blocks": F.ceil(F.col("n_ask") / BLOCK).cast("int"), "streams": F.ceil(F.col("n") / STREAM).cast("int")})
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    asking = rows.where("asks").select("group", "node", "label", F.lit(True).alias("asks"), (own % F.col("blocks")).cast("int").alias("block"), F.explode(F.expr("sequence(0, streams - 1)")).alias("stream"))
    asked = rows.select("group", "node", "label", F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("streams")).cast("int").alias("stream"))
    both = asking.unionByName(asked).join(texts, "node").select(F.struct("group", "block", "stream").alias("key"), F.expr("not asks").alias("order"), "asks", "node", "label", "text")
    dealt = both.repartition("key").sortWithinPartitions("key", "order")
    return dealt.select(F.xxhash64("key").alias("key"), "asks", "node", "label", "text").mapInArrow(lambda rows: common.released(run(rows)), "a binary, b binary")


def linked(buckets: DataFrame, texts: DataFrame, alike: float) -> DataFrame | None:
    """node and label of the nodes that have a near-duplicate, from buckets (key, node); None if there is no bucket."""
    total = buckets.count()  # rows per key only become fewer
    if not total:
        return None
    size = common.written(buckets.groupBy("key").agg(F.count("*").alias("times")), "sizes", total)
    popular = common.join_hot(buckets, size.withColumn("n", F.col("times")), ["key"], total, few=common.FEW_NARROW).groupBy("node").agg(F.sum("n").alias("fame"))
    rows = common.written(buckets.join(popular, "node"), "buckets", total)
    leaders = rows.groupBy("key").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"), F.count("*").alias("times"))
    asked, labels, tested = rows.withColumn("label", F.col("node")), None, None
    for probe in range(PROBES + 1):
        pairs = common.join_hot(asked.select("key", "node"), leaders, ["key"], total, few=common.FEW_NARROW).where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.written(pairs, "pairs", total)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = common.written(verified(pairs, texts, alike), "links")
        labels = components(new) if labels is None else extended(labels, new)
        # a leader has been compared with all of its bucket that it isn't connected with
        rows = rows.join(leaders.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti")
        marked = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        marked = common.written(marked, "marked", total)
        apart = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times")).where("low != high").select("key", "times")
        marked = common.written(common.join_hot(marked, apart, ["key"], total, "left_semi", common.FEW_NARROW), "open", total)
        if marked.isEmpty():
            return labels
        rows = marked.drop("label")
        weight = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.max_by("node", F.struct(F.xxhash64("node", F.lit(probe)), "node")).alias("one"))
        main = common.written(weight.groupBy("key").agg(F.max_by(F.struct("label", "one"), F.struct("n", "label")).alias("main"), F.sum("n").alias("times")).select("key", F.col("main.label").alias("main"), F.col("main.one").alias("leader"), "times"), "main", total)
        leaders = main.select("key", "leader", "times")
        asked = common.join_hot(marked, main.select("key", "main", "times"), ["key"], total, few=common.FEW_NARROW).where("label != main").drop("main")
    # groups: the labels that buckets still tie together
    hubs = marked.groupBy("key").agg(F.min("label").alias("hub"), F.count("*").alias("times"))
    ties = common.join_hot(marked, hubs, ["key"], total, few=common.FEW_NARROW).where("label != hub").select(F.col("label").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(ties).withColumnRenamed("node", "tied")
    asking = asked.select("node", F.lit(True).alias("asks")).distinct()
    query_set = marked.select("node", "label").distinct().join(asking, "node", "left").join(groups.select("tied", F.col("label").alias("group")), F.col("label") == F.col("tied")).drop("tied")
    query_set = common.written(query_set.withColumn("asks", F.coalesce("asks", F.lit(False))), "query", total)
    found = common.written(in_blocks(query_set, texts, alike).distinct(), "pairs")
    return extended(labels, common.written(verified(found, texts, alike), "links"))


def classes(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """doc_id, node, class_id and label of every row: class_id is the smallest doc_id of those connected by near-duplicate
    links, label their smallest node.

    Rows with equal texts are of one class. Texts without words (null and empty ones too) are alike to nothing: each row's
    class is its own doc_id. A row without a doc_id takes the class of its text, which is null if no connected row has an id.
    Repeated rows stay rows. Other columns are not read; an empty table gives no row.
    """
    rows = common.written(signed(docs), "signed")
    reps = rows.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    keyed = common.written(reps.select("node", F.explode("keys").alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    total = keyed.count()
    buckets = common.written(common.join_hot(keyed, shared, ["key"], total, "left_semi", common.FEW_NARROW), "candidates", total)
    # one text per candidate; rows repeated in full would only repeat comparisons
    wanted = reps.select("node", F.col("first").alias("doc_id")).join(buckets.select("node").distinct(), "node", "left_semi")
    own = docs.select(node(F.coalesce("text", F.lit(""))).alias("node"), F.col("doc_id").cast("long").alias("own"), "text")
    texts = own.join(wanted, (own["node"] == wanted["node"]) & own["own"].eqNullSafe(wanted["doc_id"])).select(own["node"], "text")
    labels = linked(buckets, common.written(texts, "texts"), alike)
    ids = rows.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))
    ids = ids.withColumn("label", F.col("node"))
    if labels is not None:
        ids = common.written(ids.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "joined")
        least = ids.groupBy("label").agg(F.min("first").alias("class_id"), F.count("*").alias("times"))
        ids = common.join_hot(ids.withColumnRenamed("times", "copies"), least, ["label"], ids.count(), few=common.FEW_NARROW).select("node", F.col("class_id").alias("first"), "label", F.col("copies").alias("times"))
    with_class = common.join_hot(rows.where("keys is not null").select("doc_id", "node"), ids, ["node"], rows.count(), few=common.FEW_NARROW).select("doc_id", "node", F.col("first").alias("class_id"), "label")
    return with_class.unionByName(rows.where("keys is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("label")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's class of near-duplicates."""
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (a null one only where no other has any; of equal ids
    the smallest node). All texts without words, null and empty ones too, stay, repeated rows of them as well; of rows with
    the same id and text one stays. Columns may have any names and stay as they are; an empty table stays empty; very long
    texts are read whole."""
    common.tune(spark)
    found = common.written(classes(docs), "classes")
    kept = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"), F.count("*").alias("n"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept_node"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), node(text).alias("node"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    one = rows.where("words").join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node")))
    repeated = found.where("label is not null").groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # rows repeated in full: one stays
        one = one.dropDuplicates(["id", "node"])
    return one.select("row.*").unionByName(rows.where("not words").select("row.*"))
