"""Samples of a class: assignments and their pieces, pieces that become baseline, series over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import long_form

#: Features shown over time.
TREND_FEATURES = ["meanSentenceLength", "clauseDensity", "academicRate", "rareWordRate", "abstractionIndex", "movesPerParagraph", "mechanicsRate", "revisionDensity"]
INHERITED = ["genre", "assignment_type", "subject", "timed"]


def most_similar(pairs: DataFrame) -> DataFrame:
    """piece_id, sample_id and weight of each piece's most similar earlier sample (profile.baseline_pairs); of equal ones the
    latest."""
    best = F.max_by(F.struct("sample_id", "weight"), F.struct("weight", F.col("ts").isNotNull(), "ts", "sample_id"))
    return pairs.groupBy("piece_id").agg(best.alias("b")).select("piece_id", "b.*")


def of_assignment(samples: DataFrame, assignment_id: str | None) -> DataFrame:
    """The pieces of an assignment, or of all if None."""
    pieces = samples.where("role = 'current'")
    return pieces if assignment_id is None else pieces.where(F.col("assignment_id") == assignment_id)


def pieces_per_assignment(assignments: DataFrame, samples: DataFrame) -> DataFrame:
    """assignment_id and n, its pieces; 0 where there is none."""
    n = of_assignment(samples, None).groupBy("assignment_id").agg(F.count("*").alias("n"))
    return assignments.select("assignment_id").join(n, "assignment_id", "left").select("assignment_id", F.coalesce("n", F.lit(0)).alias("n"))


def into_baseline(samples: DataFrame, accepted: DataFrame) -> DataFrame:
    """samples, of which the accepted pieces (sample_id) are included, authentic baseline from now on."""
    rows = samples.join(accepted.select("sample_id", F.lit(True).alias("_accepted")).distinct(), "sample_id", "left")
    new = F.coalesce("_accepted", F.lit(False)) & (F.col("role") == "current")
    changed = {"role": F.when(new, "baseline").otherwise(F.col("role"))} | {k: F.when(new, True).otherwise(F.col(k)) for k in ("include", "authentic")}
    return rows.withColumns(changed).drop("_accepted").select(*samples.columns)


def with_assignments(samples: DataFrame, edited: DataFrame) -> DataFrame:
    """samples, whose pieces have genre, type, subject and conditions of their edited assignments (assignment_id and
    INHERITED, nulls too)."""
    own = edited.select(F.col("assignment_id").alias("_edited"), *[F.col(k).alias(f"_{k}") for k in INHERITED])
    rows = samples.join(own, (F.col("assignment_id") == F.col("_edited")) & (F.col("role") == "current"), "left")
    return rows.select(*[F.when(F.col("_edited").isNotNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) if k in INHERITED else k for k in samples.columns])


def series(samples: DataFrame, features: list[str] | None = None) -> DataFrame:
    """writer_id, feature_id, place (from 1, by time), sample_id, role and value of each writer's samples that count, for
    the features of TREND_FEATURES that samples have."""
    features = features or [f for f in TREND_FEATURES if f in samples.columns]
    counts = (F.col("role") == "current") | (F.coalesce("include", F.lit(True)) & F.coalesce("authentic", F.lit(True)))
    rows = long_form(samples.where(counts), ["writer_id", "sample_id", "role", "ts"], features)
    order = Window.partitionBy("writer_id", "feature_id").orderBy(F.col("ts").asc_nulls_first(), "sample_id")
    return rows.select("writer_id", "feature_id", F.row_number().over(order).cast("long").alias("place"), "sample_id", "role", "value")
