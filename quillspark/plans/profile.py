"""The writer's longitudinal profile: which earlier samples count and how much, and each feature's weighted statistics.

Samples are joined to pieces on the writer, with the time as residual condition, while still one row wide; features are
unpivoted after the join. Tables

samples: sample_id, writer_id, assignment_id, role, include, authentic, ts (string), genre, subject, assignment_type, timed,
         word_count, has_process, and a column per feature
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import ALL
from .config import Config


def similarity_weight(base, current, cfg: Config) -> Column:
    """How much an earlier sample counts for a piece; base and current give columns by name."""
    g = cfg.genres
    same = lambda k: F.coalesce((base(k) != "") & (F.lower(base(k)) == F.lower(current(k))), F.lit(False))
    exact = F.coalesce((base("genre") != "") & (base("genre") == current("genre")), F.lit(False))
    w = F.greatest(F.lit(g.different), F.when(same("subject"), g.same_subject).otherwise(0.0), F.when(exact, g.same_genre).otherwise(0.0), F.when(same("assignment_type"), g.same_type).otherwise(0.0))
    timed = lambda c: F.coalesce(c("timed"), F.lit(False))
    w = F.when(timed(base) != timed(current), F.least(w, F.lit(g.timed_mismatch))).otherwise(w)
    w = F.when(F.coalesce(base("word_count"), F.lit(0)) < cfg.baseline.min_words, w * 0.5).otherwise(w)
    return F.floor(w * 100 + 0.5) / 100


def sufficiency(n: Column, genres: Column, cfg: Config) -> Column:
    b = cfg.baseline
    return F.when(n < b.minimum, "insufficient").when((n >= b.strong) & (genres >= 2), "strong").when(n >= b.preferred, "preferred").otherwise("minimum")


def baseline_pairs(samples: DataFrame, pieces: DataFrame, cfg: Config, carry: list[str]) -> DataFrame:
    """A row per piece and earlier sample that counts: piece_id, sample_id, weight, ts, genre, has_process and the carried
    columns. A sample counts if it is of the same writer, another one, a baseline, included, authentic and not later; where
    either time is missing it isn't held against it."""
    b, c = samples.alias("b"), pieces.alias("c")
    base, cur = (lambda k: F.col(f"b.{k}")), (lambda k: F.col(f"c.{k}"))
    counts = (base("role") == "baseline") & F.coalesce(base("include"), F.lit(True)) & F.coalesce(base("authentic"), F.lit(True))
    timely = cur("ts").isNull() | base("ts").isNull() | (base("ts") <= cur("ts"))
    joined = c.join(b.where(counts), (base("writer_id") == cur("writer_id")) & (base("sample_id") != cur("sample_id")) & timely)
    weight = similarity_weight(base, cur, cfg)
    return joined.select(cur("sample_id").alias("piece_id"), base("sample_id").alias("sample_id"), weight.alias("weight"), base("ts").alias("ts"), base("genre").alias("genre"), base("has_process").alias("has_process"), *[base(k).alias(k) for k in carry]).where("weight > 0")


def summary(pairs: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """A row per piece: n, n_eff, genres, process_samples and sufficiency of its baseline (n = 0 without any)."""
    genre = F.coalesce(F.nullif(F.col("genre"), F.lit("")), F.lit("unspecified"))
    found = pairs.groupBy("piece_id").agg(F.count("*").alias("n"), F.try_divide(F.pow(F.sum("weight"), F.lit(2)), F.sum(F.col("weight") * F.col("weight"))).alias("n_eff"), F.count_distinct(genre).alias("genres"), F.count_if(F.coalesce("has_process", F.lit(False))).alias("process_samples"))
    rows = pieces.select(F.col("sample_id").alias("piece_id")).join(found, "piece_id", "left")
    rows = rows.select("piece_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n", "genres", "process_samples")], F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"))
    return rows.withColumn("sufficiency", sufficiency(F.col("n"), F.col("genres"), cfg))


def long_form(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature_id and value; missing values left out."""
    return rows.unpivot([*keys], features, "feature_id", "value").where("value is not null and not isnan(value)")


def statistics(pairs: DataFrame, cfg: Config, features: list[str] | None = None) -> DataFrame:
    """A row per piece and feature: weighted mean and sd (corrected by the number of points), min, max, n, points (sorted
    values), and the least-squares trend over the samples in their order: slope, r2 and the value expected next."""
    features = features or [f.id for f in ALL if f.id in pairs.columns]
    points = long_form(pairs.select("piece_id", "sample_id", "weight", "ts", *features), ["piece_id", "sample_id", "weight", "ts"], features)
    order = Window.partitionBy("piece_id", "feature_id").orderBy(F.col("ts").asc_nulls_last(), "sample_id")
    whole = Window.partitionBy("piece_id", "feature_id")
    centre = F.sum(F.col("weight") * F.col("value")).over(whole) / F.sum("weight").over(whole)
    points = points.withColumns({"x": (F.row_number().over(order) - 1).cast("double"), "centre": centre})
    off = F.col("value") - F.col("centre")
    n = F.count("*")
    varied = F.sum(F.col("weight") * off * off) / F.sum("weight")
    trend = n >= cfg.trend.min_samples
    fit = F.when(F.var_pop("value") == 0, 0.0).otherwise(F.regr_r2("value", "x"))
    return points.groupBy("piece_id", "feature_id").agg(
        F.first("centre").alias("mean"), F.when(n < 2, 0.0).otherwise(F.sqrt(varied * n / F.greatest(n - 1, F.lit(1)))).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), n.alias("n"),
        F.array_sort(F.collect_list("value")).alias("points"), F.when(trend, F.regr_slope("value", "x")).alias("slope"), F.when(trend, fit).alias("r2"), F.when(trend, F.regr_intercept("value", "x") + F.regr_slope("value", "x") * n).alias("next"),
    )
