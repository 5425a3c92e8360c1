"""Sums of a replayed log, whether it rebuilds the submitted text, and unions of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(events: DataFrame) -> DataFrame:
    """A row per sample, from replayed events: characters inserted, deleted, typed (not pasted), pasted_surviving (without
    moves within the text), and revision_ratio, deleted for each inserted one (0 where none was)."""
    kept = F.when((F.col("type") == "paste") & ~F.col("internal_move"), F.col("surviving")).otherwise(0)
    typed = F.when(F.col("type") != "paste", F.col("inserted")).otherwise(0)
    sums = events.groupBy("sample_id").agg(F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"), F.sum(typed).alias("typed"), F.sum(kept).alias("pasted_surviving"))
    return sums.withColumn("revision_ratio", F.coalesce(F.try_divide("deleted", "inserted"), F.lit(0.0)))


def even(text: Column) -> Column:
    """A text with line feeds only, and without blanks at the ends of its lines and white space at its own."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\s+\z", ""), r"[ \t]+\n", "\n")


def matches_submission(events: DataFrame, submitted: DataFrame) -> DataFrame:
    """sample_id and matches of replayed events: whether their final text is the submitted one (sample_id, text) but for
    white space at the ends of lines; true where none was submitted."""
    final = events.where("final_text is not null").select(F.col("sample_id").alias("sample_id"), "final_text")
    rows = final.join(submitted.select("sample_id", "text"), "sample_id", "left")
    return rows.select("sample_id", F.coalesce(even(F.col("final_text")) == even(F.col("text")), F.lit(True)).alias("matches"))


def merged_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """keys, start and end of the unions of ranges (keys, start, end); ranges that overlap, touch or lie one apart are one.
    Those without a start are one row of their keys, whose start is null."""
    before = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start").isNotNull(), F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    rows = ranges.withColumn("new", new).withColumn("island", F.when(F.col("start").isNotNull(), F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
