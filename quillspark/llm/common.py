"""What the operators share: reading tables, the folder that all machines see, and batch sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python; bound a worker's memory when documents are long.
BATCH_ROWS = 250
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that long documents don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(rows: Iterator) -> Iterator:
    """The same rows; after the last, memory that the worker's allocators keep goes back to the system. Idle workers stay
    beside the next tasks."""
    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; read by Spark, as the input may lie in a store that only Spark reads."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


LEAST_FILES, ROWS_A_FILE = 8, 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again: what follows survives lost executors.

    rows: for narrow rows that cost little to work out, a number that the table does not exceed. The table then has a file
    for ROWS_A_FILE of them, LEAST_FILES at least, or as many as there are partitions where these are fewer.
    """
    path = shared_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHARES, SALTS = 1_000, 64
FEW_ROWS = 2_000  # of a key, that one task may always have
FEW_NARROW = 100_000  # the same of rows of a few numbers


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], n_rows: int, how: str = "inner", few: int = FEW_ROWS) -> DataFrame:
    """rows joined with keys, a row per key with times, the number of rows that have it, where one key may have any part of
    the rows. Keys that have more than few rows and 1 / SHARES of all n_rows, so fewer than SHARES of them, are broadcast to
    deal their rows over SALTS tasks; a joined row doesn't carry times."""
    if n_rows <= few:
        return rows.join(keys.drop("times"), on, how)
    least = max(few, n_rows // SHARES)
    hot = F.broadcast(keys.where(F.col("times") > least).select(*on, F.lit(True).alias("is_hot")))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(hot, on, "left").withColumn("salt", salt).drop("is_hot")
    copies = F.when(F.col("times") > least, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(keys.withColumn("salt", F.explode(copies)).drop("times"), [*on, "salt"], how).drop("salt")


SAMPLE_BYTES = 32 << 20  # of the texts of a class at most that a model is fitted on


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int, float]]:
    """text, label and weight of a bounded sample: for each value of the label, 0 and 1, the per_class ids that hash lowest,
    and of their texts, in the same order, those that together have most_bytes at most (longer ones are left out). The
    weight is the number of ids with the label for each one taken, so that weighted classes are to each other as in the
    whole table; it is 1 where all are taken.

    Rows without a doc_id or label are left out; of an id's several texts or labels the smallest text and largest label
    count. Only ids, at most 2 * per_class, are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)")
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    ids = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taken = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    so_far = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))  # per_class rows at most
    rows = taken.withColumn("size", size).where(F.col("size") <= most_bytes).withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("text", "label").collect()
    found = Counter(r.label for r in rows)
    return [(r.text, r.label, max(1.0, n[r.label] / found[r.label])) for r in rows]
