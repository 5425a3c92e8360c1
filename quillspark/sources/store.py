"""Tables of the engine's own: what is kept between stages, and the store of samples with upserts, deletes and bundles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: computed once, with a short plan, and safe from lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of, or beside, its own; where new has a null the old value stays."""
    n = new.alias("n")
    o = old.alias("o")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    columns = list(dict.fromkeys([*old.columns, *new.columns]))

    def pick(c: str):
        sides = [F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return o.join(n, same, "full_outer").select(*map(pick, columns))


def without_writer(tables: dict[str, DataFrame], writer_id: str) -> dict[str, DataFrame]:
    """Tables without a writer, their samples and what hangs on those; assignments stay."""
    out = dict(tables)
    gone = tables["samples"].where(F.col("writer_id") == writer_id).select("sample_id")
    out["writers"] = tables["writers"].where(F.col("writer_id") != writer_id)
    out["samples"] = tables["samples"].where(F.col("writer_id") != writer_id)
    for k in ("annotations", "notes", "process_events", "process_reports"):
        if k in tables:
            out[k] = tables[k].join(gone, "sample_id", "left_anti")
    return out


def next_writer_id(writers: DataFrame) -> DataFrame:
    """One row: the next free number as S-0000, after the largest; 1001 in an empty table."""
    number = F.try_to_number(F.regexp_replace("writer_id", "[^0-9]", ""), F.lit("9999999999"))
    return writers.agg((F.coalesce(F.max(number), F.lit(1000)) + 1).cast("long").alias("n")).select(F.concat(F.lit("S-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("writer_id"))


def matched_writer(names: DataFrame, writers: DataFrame) -> DataFrame:
    """names (name) with the writer whose id or displayed name it is, case aside; of several the first by id."""
    ids = writers.select("writer_id", F.explode(F.array_distinct(F.array(F.lower("writer_id"), F.lower(F.coalesce("display_name", F.lit("")))))).alias("key")).where("key != ''")
    first = ids.groupBy("key").agg(F.min("writer_id").alias("writer_id"))
    return names.withColumn("key", F.lower(F.trim("name"))).join(first, "key", "left").drop("key")


def bundled(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables as JSON, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def unbundled(spark: SparkSession, path: str, schemas: dict[str, str], into: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables of a bundle upserted into others."""
    read = {k: spark.read.schema(s).json(f"{path}/{k}") for k, s in schemas.items()}
    return {k: upserted(into[k], df, *keys[k]) if k in into else df for k, df in read.items()}


def sealed(df: DataFrame, column: str, key: str) -> DataFrame:
    """A text column encrypted with AES in GCM mode; key is an expression of 16, 24 or 32 bytes, made outside of Spark."""
    return df.withColumn(column, F.base64(F.aes_encrypt(F.col(column), F.expr(key), F.lit("GCM"))))


def opened(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.unbase64(column), F.expr(key), F.lit("GCM")).cast("string"))
