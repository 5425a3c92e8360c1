"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sources get weights, and targets that share all words by weight but stop at CAP times the source's size.
2. Each source's documents, shuffled by hash, are laid end to end and cut into equal blocks of words.
3. Slot t of the schedule is the golden-ratio point t * g modulo 1. Points are mapped through the cumulative numbers of
   blocks that targets ask for, which gives each slot a source; so any stretch of the schedule has the sources in proportion.
4. The slots of a source are ranked; slot number r takes block r modulo the number of blocks, in at most CAP passes.
5. A document's taken words are those of its parts of blocks, as often as slots take them.

All of it is DataFrame operations. Prefix sums and ranks are made in two levels (hash bucket or stretch of slots first), so
that no source, however large, meets in one task; points find their source by an equi-join on cells of the unit interval.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAP = 3  # passes over a source at most
WEIGHTS = (1.0, 2.0, 3.0)  # of sources by code point, nulls last, repeating
BLOCKS = 1 << 17  # about so many in all
LEAST_BLOCKS = 256  # of a source, so that its share comes out near its target
GOLDEN, ONE = 2654435769, 1 << 32  # golden ratio's fraction in 32 bits
CELLS = 1 << 12
STRETCH = 4096  # slots ranked together
ROWS_A_BUCKET = 4096
#: A word of the size: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of the text, by which equal ids are told apart."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, target (words), idx, and blocks, over sources: a row each, sorted in one task.

    A target above CAP times the source's size stops there and the excess is shared again by weight, until none is above:
    by the ratio of cap to weight, that holds for a first few sources, which a running sum tells."""
    total = Window.partitionBy()
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("idx", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumns({"cap": F.col("source_size") * float(CAP), "all_words": F.sum("source_size").over(total), "all_weight": F.sum("weight").over(total)})
    left = lambda of, used, w: F.col(of) - F.coalesce(F.sum(used).over(w), F.lit(0.0))
    rows = rows.withColumns({"words_left": left("all_words", "cap", before), "weight_left": left("all_weight", "weight", before)})
    rows = rows.withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    full = lambda c: F.when(F.col("full"), F.col(c)).otherwise(0.0)
    share = left("all_words", full("cap"), total) / F.nullif(left("all_weight", full("weight"), total), F.lit(0.0))
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.coalesce(share, F.lit(0.0))))
    block = F.greatest(F.lit(1), F.ceil(F.col("all_words") / BLOCKS))
    blocks = F.greatest(F.least(F.lit(LEAST_BLOCKS), "source_size"), F.ceil(F.col("source_size") / block))
    return rows.select("source", "source_size", "weight", "target", F.col("idx").cast("long").alias("idx"), blocks.cast("long").alias("blocks"))


def schedule(goals: DataFrame) -> DataFrame:
    """slot, idx (the source), rank (the slot's place among the source's, from 0) and block of that source."""
    spark = goals.sparkSession
    need = F.col("target") * F.col("blocks") / F.greatest(F.lit(1), "source_size")
    up_to = F.sum(need).over(Window.orderBy("idx"))
    spans = goals.select("idx", "blocks", need.alias("need"), up_to.alias("end")).where("need > 0")
    slots = int(round(spans.agg(F.max("end")).first()[0] or 0))
    spans = spans.withColumns({"a": (F.col("end") - F.col("need")) / F.lit(float(max(1, slots))), "b": F.col("end") / F.lit(float(max(1, slots)))})
    spans = spans.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("a") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("b") * CELLS), F.lit(CELLS - 1)))))
    # the last span takes whatever rounding leaves at the end of the unit interval
    spans = spans.withColumn("b", F.when(F.col("idx") == F.max("idx").over(Window.partitionBy("cell")), F.when(F.col("cell") == CELLS - 1, F.lit(2.0)).otherwise(F.col("b"))).otherwise(F.col("b")))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % ONE / ONE).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    placed = points.join(spans, "cell").where("u >= a and u < b").select("slot", "idx", "blocks", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = placed.groupBy("idx", "stretch").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("idx", "stretch", earlier.alias("first"))
    within = F.row_number().over(Window.partitionBy("idx", "stretch").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(firsts, ["idx", "stretch"]).withColumn("rank", F.col("first") + F.col("within"))
    return ranked.where(F.col("rank") < CAP * F.col("blocks")).select("slot", "idx", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def laid_out(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized with its source's figures and position, the words before it in the source's shuffled row of documents."""
    rows = sized.count()
    bits = max(0, min(20, math.ceil(math.log2(max(1, rows / ROWS_A_BUCKET)))))
    h = F.xxhash64("doc_id", "text_hash")
    placed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    placed = placed.withColumns({"h": h, "bucket": F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")})
    earlier = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    firsts = sums.select("idx", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(firsts, ["idx", "bucket"])
    return placed.withColumn("position", F.col("first") + F.col("upto") - F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and taken: the words that the mix takes of each row of docs.

    Null text has size 0, null source is a source, the last one; a row without words has nothing taken. Rows that are alike
    in id and text are documents of their own, in any order. An empty table gives no row. Other columns are not read.
    """
    sized = common.written(sizes(docs), "sizes")
    goals = common.written(targets(sized), "targets")
    uses = schedule(goals).groupBy("idx", "block").agg(F.count("*").alias("uses"))
    rows = laid_out(sized, goals)
    edge = lambda b: F.expr(f"({b}) * source_size div blocks")  # noqa: E731  where a block begins
    spread = rows.where("size > 0").withColumn("block", F.explode(F.expr("sequence(((position + 1) * blocks - 1) div source_size, ((position + size) * blocks - 1) div source_size)")))
    words = F.least(F.col("position") + F.col("size"), edge("block + 1")) - F.greatest(F.col("position"), edge("block"))
    keep = ["doc_id", "source", "text_hash", "size", "source_size", "target", "idx", "position"]
    taken = spread.withColumn("words", words).join(uses, ["idx", "block"], "left").groupBy(*keep).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    out = [*keep[:6], "taken"]
    none = sized.where("size = 0").join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"]).withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(none.select(*out))


def cut(text: str, words: int) -> str:
    """text up to the end of its words-th word."""
    end = 0
    for k, m in enumerate(re.finditer(WORD, text), 1):
        end = m.end()
        if k == words:
            break
    return text[:end]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: a row for each whole time that a document is taken, and one with its first words for what is
    taken of it besides. Rows of one id and text share evenly, rounded down, what is taken of them together.

    Texts without words, null and empty ones too, are never taken; null ids and sources are kept; other columns may have any
    names and stay as they are but for n_chars, which follows the text; an empty table stays empty. Very long texts are read
    whole.
    """
    common.tune(spark)
    names = docs.columns
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    shares = mix(docs).groupBy("doc_id", "text_hash").agg(F.expr("sum(taken) div count(*)").alias("taken"), F.max("size").alias("size")).where("taken > 0")
    rows = own.join(shares, own["id"].eqNullSafe(shares["doc_id"]) & (own["hash"] == shares["text_hash"])).select("row", "taken", "size")
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names)
            taken, size = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield rows.take(pa.array([k for k, (t, s) in enumerate(zip(taken, size, strict=True)) for _ in range(t // s)], pa.int64()))
            some = [k for k, (t, s) in enumerate(zip(taken, size, strict=True)) if t % s]
            if some:
                part = rows.take(pa.array(some, pa.int64()))
                texts = [cut(t, taken[k] % size[k]) for k, t in zip(some, part.column(at).to_pylist(), strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[chars] = pa.array(list(map(len, texts)), pa.int64()).cast(columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of every document."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
