"""Comparison of a piece with its writer's profile, feature by feature; category levels and the priority of a look.

Nothing here is a probability, and nothing says why a piece differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import ALL, CATEGORIES, LEVELS, SEGMENTS
from .config import Config
from .wording import ALTERNATIVES

QUALITY = ["Low", "Moderate", "High"]
# Flags of the task (a) or writer (w), the groups they touch, factors, and the only features, if not all.
ADJUSTMENTS = [
    ("a", "sentence_frames", ["voice", "surface", "architecture", "sentence"], 0.6, None), ("a", "model_essay", ["architecture", "reasoning", "voice", "surface", "syntax"], 0.6, None),
    ("a", "research_allowed", ["evidence", "lexical", "abstraction"], 0.75, None), ("a", "notes_allowed", ["external"], 0.7, None),
    ("a", "collaboration_allowed", ["process", "external", "architecture"], 0.75, None), ("a", "taught_terms", ["lexical", "abstraction"], 0.85, None),
    ("w", "dictation", ["process"], 0.5, ["typingRate", "longestContinuous", "continuousShare", "revisionDensity", "surfaceEditRate"]), ("w", "drafts_elsewhere", ["process", "external"], 0.5, None),
    ("w", "ell", ["lexical", "surface", "mechanics", "voice"], 0.7, None), ("w", "assistive_tools", ["mechanics", "lexical", "process"], 0.7, None),
]
COMPOSITES = [
    ("sentenceComplexity", ["clauseDensity", "meanSentenceLength"]), ("vocabulary", ["academicRate", "rareWordRate", "advancedVerbShare"]), ("abstraction", ["abstractionIndex"]),
    ("architecture", ["movesPerParagraph", "chainLength"]), ("revision", ["revisionDensity"]), ("continuous", ["longestContinuous"]), ("inserted", ["pastedShare"]),
]
FLAGS = [f for _, f, *_ in ADJUSTMENTS]


def catalogue(spark: SparkSession, cfg: Config) -> DataFrame:
    """The features as a table, with reference values and alternatives; small, fixed in size."""
    rows = [(f.id, k, f.category, f.group, f.label, f.unit, f.digits, float(f.min_spread), float(f.weight), f.weak, f.direction, *(map(float, cfg.reference[f.id]) if f.id in cfg.reference else (None, None)), ALTERNATIVES.get(f.group, [])) for k, f in enumerate(ALL)]
    return spark.createDataFrame(rows, "feature_id string, place int, category string, group string, label string, unit string, digits int, min_spread double, weight double, weak boolean, direction string, ref_mean double, ref_spread double, alternatives array<string>")


def strength(z: Column, cfg: Config) -> Column:
    s, a = cfg.strength, F.abs(z)
    return F.when(a >= s.very_high, "Very high").when(a >= s.high, "High").when(a >= s.moderate, "Moderate").otherwise("Typical")


def context_factor() -> Column:
    """The product of the factors of the flags that hold for a feature's group."""
    out = F.lit(1.0)
    for _, flag, groups, factor, only in ADJUSTMENTS:
        held = F.coalesce(F.col(flag), F.lit(False)) & F.col("group").isin(*groups)
        out = out * F.when(held & F.col("feature_id").isin(*only) if only else held, factor).otherwise(1.0)
    return out


def comparisons(values: DataFrame, stats: DataFrame, profiles: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """A row per piece and feature that it has a value of.

    values: piece_id, feature_id, value. profiles: plans.profile.summary. pieces: piece_id, word_count, sentences,
    process_source (log, report or null), a boolean column per flag of ADJUSTMENTS, and dismissed (array of feature ids).
    Process features with fewer than two earlier points are held against reference values, or left out where there is none;
    text features without a sufficient baseline give a row that isn't compared.
    """
    spark = values.sparkSession
    rows = values.join(F.broadcast(catalogue(spark, cfg)), "feature_id").join(profiles.withColumnRenamed("n", "samples"), "piece_id").join(pieces, "piece_id").join(stats, ["piece_id", "feature_id"], "left")
    c, sign = F.col, F.signum
    process = c("category").isin("process", "external")
    thin = process & (F.coalesce(c("n"), F.lit(0)) < 2)
    rows = rows.where(~thin | c("ref_mean").isNotNull())
    rows = rows.withColumns({"_process": process, "basis": F.when(thin, "reference").otherwise("student"), "compared": process | (c("mean").isNotNull() & (c("sufficiency") != "insufficient"))})
    reference = c("basis") == "reference"
    rows = rows.withColumns({"mean": F.when(reference, c("ref_mean")).otherwise(c("mean")), "sd": F.when(reference, c("ref_spread")).otherwise(c("sd")), "n": F.when(reference, 0).otherwise(F.coalesce("n", F.lit(0))), "points": F.when(reference, F.array().cast("array<double>")).otherwise(c("points")), **{k: F.when(~reference, c(k)) for k in ("slope", "r2", "next", "min", "max")}})
    spread = F.greatest("sd", cfg.baseline.relative_spread * F.abs("mean"), "min_spread")
    rows = rows.withColumn("spread", spread).withColumn("raw_z", (c("value") - c("mean")) / c("spread"))
    way = lambda z: F.when(c("direction") == "up", F.greatest(F.lit(0.0), z)).when(c("direction") == "down", F.least(F.lit(0.0), z)).otherwise(z)
    steady = F.coalesce((c("r2") >= cfg.trend.min_fit) & (sign("slope") == sign("raw_z")) & (F.abs("slope") * c("n") >= c("spread") * 0.5), F.lit(False))
    rows = rows.withColumns({"_z": way(c("raw_z")), "_zt": way((c("value") - c("next")) / c("spread")), "_steady": steady})
    grown = c("_steady") & (F.abs("_zt") < F.abs("_z"))
    sudden = ~c("_steady") & ~reference & (c("n") >= 3) & (F.abs("_z") >= cfg.strength.high) & F.coalesce(c("r2") < cfg.trend.min_fit, F.lit(True))
    rows = rows.withColumns({"trend": F.when(grown, "development").when(sudden, "sudden"), "_z": F.when(grown, c("_zt")).otherwise(c("_z"))})
    seen = F.when(c("unit").contains("per 1,000 words"), c("value") * c("word_count") / 1000).when(c("unit").contains("per 100 words"), c("value") * c("word_count") / 100).when(c("unit").contains("% of sentences"), c("value") * c("sentences") / 100)
    rare = F.coalesce((c("raw_z") > 0) & (seen < 3), F.lit(False))
    z = F.when(rare, c("_z") * F.greatest(F.lit(0.0), seen) / 3).otherwise(c("_z")) * context_factor()
    rows = rows.withColumns({"occurrences": seen, "factor": context_factor(), "z": F.when(c("compared"), z).otherwise(0.0)})
    q = F.when(reference, 0).when(c("_process"), F.when(c("n") >= 3, 2).otherwise(1)).when(c("sufficiency").isin("strong", "preferred"), 2).when(c("sufficiency") == "minimum", 1).otherwise(0)
    lower = lambda q, test: F.when(test, F.greatest(F.lit(0), q - 1)).otherwise(q)
    q = lower(q, c("_process") & F.coalesce(c("process_source") == "report", F.lit(False)))
    q = F.when((c("category") == "discourse") & (q == 2), 1).otherwise(q)
    q = lower(q, ~c("_process") & (c("word_count") < 250))
    q = lower(q, ~c("_process") & (c("n_eff") < 2.5))
    q = F.when(c("weak"), 0).otherwise(q)
    above = c("raw_z") > 0
    outside = F.when(F.size("points") > 0, F.size(F.filter("points", lambda p: F.when(above, c("value") > p).otherwise(c("value") < p))))
    pct = F.when(F.abs("mean") >= c("min_spread"), (c("value") - c("mean")) / F.abs("mean") * 100)
    only = lambda x: F.when(c("compared"), x)
    rows = rows.withColumns({"strength": F.when(c("compared"), strength(c("z"), cfg)).when(c("sufficiency") == "insufficient", "Not compared (insufficient baseline)").otherwise("No earlier data"), "quality": only(F.get(F.array(*map(F.lit, QUALITY)), q)), "outside": only(outside), "pct_change": only(pct), "deviation": only(F.floor(c("z") * 100 + 0.5) / 100), "dismissed": F.coalesce(F.array_contains("dismissed", c("feature_id")), F.lit(False))})
    keep = "piece_id feature_id place category group label unit digits value mean sd spread min max n basis compared raw_z z deviation pct_change outside strength quality weight weak trend slope next occurrences factor dismissed alternatives sufficiency process_source".split()
    return rows.select(*keep)


def levels(score: Column, cfg: Config) -> Column:
    k = cfg.categories
    return F.when(score >= k.very_high, 4).when(score >= k.high, 3).when(score >= k.moderate_high, 2).when(score >= k.moderate, 1).otherwise(0)


def category_levels(rows: DataFrame, profiles: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """Four rows per piece: whether the category could be assessed, its score, level (index, name, segments of ten), quality
    of evidence, the notable features and any caps."""
    spark, c = rows.sparkSession, F.col
    used = rows.where("compared and not dismissed")
    part = F.abs("z") * c("weight") * F.when((c("quality") == "Low") & ~c("weak"), 0.8).otherwise(1.0)
    w = Window.partitionBy("piece_id", "category").orderBy(F.desc("part"), "place")
    top = used.withColumn("part", part).withColumn("r", F.row_number().over(w)).where(c("r") <= cfg.categories.top)
    scores = top.groupBy("piece_id", "category").agg(F.greatest(F.sqrt(F.sum(c("part") * c("part")) / cfg.categories.top), 0.8 * F.max("part")).alias("score"))
    noted = used.withColumn("pull", F.abs("z") * c("weight"))
    item = F.struct((-c("pull")).alias("o"), "place", "feature_id", "label", "weak", "raw_z", "quality")
    found = noted.groupBy("piece_id", "category").agg(F.count("*").alias("rows"), F.every(c("basis") == "reference").alias("all_reference"), F.array_sort(F.collect_list(F.when(c("strength") != "Typical", item))).alias("notable"))
    names = spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(CATEGORIES)], "category string, category_label string, category_place int")
    grid = pieces.select("piece_id", "process_source").join(profiles.select("piece_id", "sufficiency"), "piece_id").join(F.broadcast(names))
    all_ = grid.join(scores, ["piece_id", "category"], "left").join(found, ["piece_id", "category"], "left")
    textual = c("category").isin("style", "discourse")
    note = F.when(textual & (c("sufficiency") == "insufficient"), "The baseline is insufficient for a reliable comparison.").when(~textual & c("process_source").isNull(), "There is no process data for this piece.").when(c("rows").isNull(), "There is not enough information to compare.")
    raw = levels(c("score"), cfg)
    caps = F.array_compact(F.array(
        F.when(textual & (c("sufficiency") == "minimum") & (raw > 3), "minimum baseline: at most HIGH"), F.when((c("category") == "process") & c("all_reference") & (raw > 2), "general reference values only: at most MODERATE-HIGH"),
        F.when(~textual & (c("process_source") == "report") & (raw > 3), "imported report: at most HIGH"),
    ))
    all_ = all_.withColumns({"note": note, "assessed": note.isNull(), "caps": F.when(note.isNull(), caps).otherwise(F.array().cast("array<string>"))})
    index = F.when(c("category") == "process", F.when(c("all_reference"), F.least(raw, F.lit(2))).otherwise(raw)).otherwise(raw)
    index = F.when(textual & (c("sufficiency") == "minimum"), F.least(index, F.lit(3))).otherwise(index)
    index = F.when(~textual & (c("process_source") == "report"), F.least(index, F.lit(3))).otherwise(index)
    index = F.when(c("assessed"), index).otherwise(-1)
    best = F.transform(F.slice(F.coalesce("notable", F.array()), 1, 3), lambda x: x["quality"])
    quality = F.when(F.array_contains(best, "High"), "High").when(F.array_contains(best, "Moderate"), "Moderate").when(F.size(best) > 0, "Low")
    all_ = all_.withColumn("index", index.cast("int"))
    level = F.when(c("assessed"), F.get(F.array(*map(F.lit, LEVELS)), c("index"))).otherwise("NOT ASSESSED")
    return all_.select("piece_id", "category", "category_label", "category_place", "assessed", "note", F.when(c("assessed"), c("score")).alias("score"), "index", level.alias("level"), F.when(c("assessed"), F.get(F.array(*map(F.lit, SEGMENTS)), c("index"))).alias("segments"), F.when(c("assessed"), quality).alias("quality"), F.coalesce("notable", F.array()).alias("notable"), "caps")


def priorities(categories: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row per piece: how urgently a teacher may want to look, by how many categories agree."""
    c = F.col
    least = lambda k: F.count_if(c("assessed") & (c("index") >= k))
    votes = categories.groupBy("piece_id").agg(F.count_if("assessed").alias("assessed"), least(3).alias("strong"), least(2).alias("converging"), least(1).alias("raised")).join(profiles.select("piece_id", "sufficiency"), "piece_id")
    level = F.when((c("strong") >= 2) | (c("converging") >= 3), "HIGH").when((c("strong") >= 1) | (c("converging") >= 2) | (c("raised") >= 3), "MODERATE").otherwise("LOW")
    level = F.when((c("sufficiency") == "insufficient") & (level == "HIGH"), "MODERATE").otherwise(level)
    return votes.select("piece_id", F.when(c("assessed") == 0, "INCONCLUSIVE").otherwise(level).alias("priority"), "strong", "converging", "raised", "sufficiency")


def strongest(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest deviations per piece that are neither weak nor dismissed, with their rank."""
    found = rows.where("compared and strength != 'Typical' and not weak and not dismissed")
    w = Window.partitionBy("piece_id").orderBy((F.abs("z") * F.col("weight")).desc(), "place")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def composites(rows: DataFrame) -> DataFrame:
    """Headline comparisons: per piece and composite the mean change in percent and how to say it. Dismissal doesn't matter."""
    spark, c = rows.sparkSession, F.col
    members = spark.createDataFrame([(k, p, f) for p, (k, fs) in enumerate(COMPOSITES) for f in fs], "composite string, composite_place int, feature_id string")
    found = rows.where("compared").join(F.broadcast(members), "feature_id").groupBy("piece_id", "composite", "composite_place").agg(F.avg("pct_change").alias("pct"), F.max_by(F.struct("strength", "raw_z"), F.struct(F.abs("z").alias("a"), (-c("place")).alias("b"))).alias("top"), F.every(c("basis") == "reference").alias("reference_only"))
    sign = F.when(c("pct") >= 0, "+").otherwise("−")
    text = F.when(c("pct").isNotNull(), F.concat(sign, F.abs(F.floor(c("pct") + 0.5)).cast("string"), F.lit("%"))).when(c("top.strength") == "Typical", "similar").when(c("top.raw_z") > 0, "new / well above usual").otherwise("well below usual")
    return found.select("piece_id", "composite", "composite_place", "pct", text.alias("text"), "reference_only")
