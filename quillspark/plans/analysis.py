"""The whole analysis: samples and process data in, tables of findings out. Every table is a DataFrame over all pieces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STRUCTURE, documented, unmarked
from ..operators import batch, discourse, style
from ..operators.features import ALL, PROCESS
from ..sources.store import stored
from . import compare, profile, wording
from .config import Config

_META = ["sample_id", "writer_id", "assignment_id", "role", "include", "authentic", "ts", "genre", "subject", "assignment_type", "timed"]
_META_TYPES = dict(zip(_META, ["string"] * 4 + ["boolean"] * 2 + ["string"] * 4 + ["boolean"], strict=True))
_FLAGS = {f: "boolean" for f in compare.FLAGS}


def with_defaults(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with missing columns as nulls."""
    return df.withColumns({k: F.lit(None).cast(t) for k, t in types.items() if k not in df.columns})


def _spread(samples: DataFrame) -> DataFrame:
    """Samples with all of _META, over many tasks: a file of one row group would be one."""
    samples = with_defaults(samples, _META_TYPES | {"taught_terms": "array<string>"}).select(*_META, "taught_terms", "text")
    spark = samples.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return samples.repartition(parts, "sample_id", "text")


def featured(samples: DataFrame, process: DataFrame | None = None, cfg: Config = Config(), extras: tuple[str, ...] = batch.EXTRAS) -> DataFrame:
    """Samples (text, and of _META what there is; taught_terms) with a column per feature, word_count, sentences, has_process,
    process_source, and the extras: _stems, which new_vocabulary() takes, and _verbs, which verb_repertoire() does. process:
    sample_id, process_source and process features."""
    docs = batch.all_features(_spread(samples), "text", "taught_terms", cfg.lexicon, extras)
    if process is None:
        docs = docs.withColumns({f.id: F.lit(None).cast("double") for f in PROCESS} | {"process_source": F.lit(None).cast("string")})
    else:
        docs = docs.join(process, "sample_id", "left")
    docs = docs.withColumn("has_process", F.col("process_source").isNotNull())
    return docs.select(*_META, "taught_terms", "text", "word_count", "sentences", "has_process", "process_source", *[f.id for f in ALL], *extras)


def worded(samples: DataFrame, extras: tuple[str, ...]) -> DataFrame:
    """Samples without features and process data: what new_vocabulary() and verb_repertoire() read, which takes no sentences."""
    docs = batch.words_only(_spread(samples), "text", extras).withColumn("has_process", F.lit(False))
    return docs.select(*_META, "taught_terms", "text", "word_count", "has_process", *extras)


def detailed(pieces: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows of featured() with what is told of pieces only: _rare (vocabulary_details), _moves, _flow and _chains (moves)."""
    rows = documented(pieces.drop("_stems", "_verbs"), "text", "taught_terms", only=STRUCTURE)
    rows = style.vocabulary_details(discourse.moves(rows), cfg.lexicon)
    return rows.select(*pieces.columns, "_rare", "_moves", "_flow", "_chains")


@dataclass
class Result:
    """Tables of an analysis; each has piece_id."""

    pieces: DataFrame
    profiles: DataFrame
    statistics: DataFrame
    rows: DataFrame
    categories: DataFrame
    priorities: DataFrame
    strongest: DataFrame
    composites: DataFrame
    new_vocabulary: DataFrame | None  # where the table has _stems
    verbs: DataFrame | None  # where it has _verbs


def analyze(table: DataFrame, writers: DataFrame | None = None, assignments: DataFrame | None = None, dismissed: DataFrame | None = None, cfg: Config = Config(), only: list[str] | None = None) -> Result:
    """table: featured() samples, stored as a table (sources.store.stored), as it is read several times. writers: writer_id and their flags. assignments: assignment_id and theirs, taught_terms as
    an array. dismissed: sample_id and feature_id of findings that a teacher has set aside. Pieces are samples of role current. only: the features that are compared, if not
    all; the other tables are of these, then. The comparisons are stored, as most tables are made of them."""
    ids = only or [f.id for f in ALL]
    current = table.where("role = 'current'")
    pairs = profile.baseline_pairs(table, current, cfg, ids)
    profiles, stats = profile.summary(pairs, current, cfg), profile.statistics(pairs, cfg, ids)
    pieces = current.select(F.col("sample_id").alias("piece_id"), "writer_id", "assignment_id", "word_count", "sentences", "process_source")
    if writers is not None:
        pieces = pieces.join(writers.select("writer_id", *[k for k in _FLAGS if k in writers.columns]), "writer_id", "left")
    if assignments is not None:
        kept = [k for k in _FLAGS if k in assignments.columns and k != "taught_terms"]
        terms = [(F.size(F.coalesce("taught_terms", F.array())) > 0).alias("taught_terms")] if "taught_terms" in assignments.columns else []
        pieces = pieces.join(assignments.select("assignment_id", *kept, *terms), "assignment_id", "left")
    if dismissed is not None:
        pieces = pieces.join(dismissed.groupBy(F.col("sample_id").alias("piece_id")).agg(F.collect_set("feature_id").alias("dismissed")), "piece_id", "left")
    pieces = with_defaults(pieces, _FLAGS | {"dismissed": "array<string>"})
    values = profile.long_form(current.select(F.col("sample_id").alias("piece_id"), *ids), ["piece_id"], ids)
    rows = stored(compare.comparisons(values, stats, profiles, pieces, cfg), "comparisons")
    categories = compare.category_levels(rows, profiles, pieces, cfg)
    return Result(detailed(current, cfg).withColumnRenamed("sample_id", "piece_id"), profiles, stats, rows, categories, compare.priorities(categories, profiles), compare.strongest(rows), compare.composites(rows), new_vocabulary(table, current, cfg) if "_stems" in table.columns else None, verb_repertoire(table, current, cfg) if "_verbs" in table.columns else None)


def new_vocabulary(table: DataFrame, current: DataFrame, cfg: Config = Config()) -> DataFrame:
    """piece_id, stem and word: sophisticated words of a piece of which no baseline sample has the stem; none without a
    baseline. An anti join on piece and stem."""
    pairs = profile.baseline_pairs(table, current, cfg, ["_stems"])
    known = pairs.select("piece_id", F.explode("_stems").alias("stem")).distinct()
    words = detailed(current, cfg).select(F.col("sample_id").alias("piece_id"), F.explode("_rare").alias("stem", "word"))
    return words.join(pairs.select("piece_id").distinct(), "piece_id", "left_semi").join(known, ["piece_id", "stem"], "left_anti")


def verb_repertoire(table: DataFrame, current: DataFrame, cfg: Config = Config(), top: int = 10) -> DataFrame:
    """piece_id, side (baseline or current), verb, n and rank of the most used analytical verbs."""
    pairs = profile.baseline_pairs(table, current, cfg, ["_verbs"])
    both = pairs.select("piece_id", F.lit("baseline").alias("side"), F.explode("_verbs").alias("verb", "n")).unionByName(current.select(F.col("sample_id").alias("piece_id"), F.lit("current").alias("side"), F.explode("_verbs").alias("verb", "n")))
    counts = both.groupBy("piece_id", "side", "verb").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("piece_id", "side").orderBy(F.desc("n"), "verb"))).where(F.col("rank") <= top)


def number(v: Column, digits: Column) -> Column:
    """A number with so many digits, without trailing zeros."""
    out = F.format_string("%.3f", v)
    for d in (2, 1, 0):
        out = F.when(digits == d, F.format_string(f"%.{d}f", v)).otherwise(out)
    return F.when(v.isNull(), "—").otherwise(F.regexp_replace(F.regexp_replace(out, r"\.0+\z", ""), r"(\.[0-9]*[1-9])0+\z", "$1"))


def explained(rows: DataFrame) -> DataFrame:
    """Comparison rows with explanation, in sentences."""
    c = F.col
    unit = F.when(c("unit") == "", "").when(c("unit").startswith("%"), c("unit")).otherwise(F.concat(F.lit(" "), "unit"))
    say = lambda v: F.concat(number(v, c("digits")), unit)
    own = F.concat(F.lit("Usual for this writer: "), say(c("mean")), F.lit(" (from "), number(c("min"), c("digits")), F.lit(" to "), number(c("max"), c("digits")), F.lit(" in "), c("n").cast("string"), F.lit(" earlier samples)."))
    place = F.when((c("outside").isNotNull()) & (F.abs("raw_z") >= 1), F.concat(F.lit("That is "), F.when(c("raw_z") > 0, "higher").otherwise("lower"), F.lit(" than in "), c("outside").cast("string"), F.lit(" of them.")))
    general = F.concat(F.lit("No earlier process data, so held against a general value of "), say(c("mean")), F.lit("."))
    grown = F.when(c("trend") == "development", F.concat(F.lit("Earlier samples show a steady "), F.when(c("slope") > 0, "rise").otherwise("fall"), F.lit(" that leads to about "), say(c("next")), F.lit(", so this continues a development."))).when(c("trend") == "sudden", "Earlier samples were fairly stable, so this is an abrupt change.")
    few = F.when((c("raw_z") > 0) & (c("occurrences") < 3), F.concat(F.lit("It rests on "), F.floor(c("occurrences") + 0.5).cast("string"), F.lit(" occurrences, so it counts for less.")))
    text = F.concat_ws(" ", F.concat("label", F.lit(": "), say(c("value")), F.lit(" in this piece.")), F.when(c("basis") == "student", own).otherwise(general), place, grown, few)
    return rows.withColumn("explanation", F.when(c("compared"), text).otherwise(F.concat_ws(" ", "label", "strength")))


def anomalies(rows: DataFrame) -> DataFrame:
    """The unusual features: id, category, feature, deviation, strength, evidence_quality, explanation, alternatives."""
    found = explained(rows).where("compared and strength != 'Typical' and not dismissed")
    return found.select("piece_id", F.concat(F.lit("a-"), "feature_id").alias("id"), "category", F.col("label").alias("feature"), "deviation", "strength", F.col("quality").alias("evidence_quality"), "explanation", F.col("alternatives").alias("alternative_explanations"))


def summaries(result: Result) -> DataFrame:
    """piece_id, priority and lines (array) of a summary in words."""
    c = F.col
    told = F.transform(F.slice(F.filter("notable", lambda x: ~x["weak"]), 1, 2), lambda x: F.concat(F.lower(x["label"]), F.when(x["raw_z"] > 0, " above").otherwise(" below"), F.lit(" the usual range")))
    line = F.concat(c("category_label"), F.lit(": "), F.lower("level"), F.lit(" deviation"), F.when(F.size(told) > 0, F.concat(F.lit(" ("), F.array_join(told, "; "), F.lit(")"))).otherwise(""), F.lit("."))
    lines = result.categories.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.when(c("assessed") & (c("index") >= 1), F.struct("category_place", line.alias("line"))))).alias("found"))
    lead = F.create_map(*[F.lit(x) for kv in wording.LEADS.items() for x in kv])
    rows = result.priorities.join(lines, "piece_id")
    shown = c("priority") != "INCONCLUSIVE"
    parts = F.concat(
        F.array(lead[c("priority")]), F.when(shown & (c("converging") >= 2), F.array(F.lit(wording.SEVERAL))).otherwise(F.array().cast("array<string>")),
        F.when(shown, F.transform("found", lambda x: x["line"])).otherwise(F.array().cast("array<string>")), F.when(shown & (c("priority") != "LOW"), F.array(F.lit(wording.NOT_WHY))).otherwise(F.array().cast("array<string>")),
        F.when(shown & (c("sufficiency") == "insufficient"), F.array(F.lit(wording.THIN))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("piece_id", "priority", parts.alias("lines"))


def _excerpt(text: Column, most: int) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(t)


def complex_sentence(moves: Column) -> Column:
    """The most complex sentence of at least twelve parts that doesn't open with a quotation, or null."""
    parts = lambda s: F.size(F.split(s["t"], r"\s+"))
    score = lambda s: s["level"] * 2 + F.regexp_count(s["t"], F.lit(",")) + parts(s) / 12
    fit = F.filter(moves, lambda s: (parts(s) >= 12) & ~s["t"].rlike("^[\u0004\u0005\u0006\u0007\"“]"))
    ranked = F.array_sort(F.transform(fit, lambda s, k: F.struct((-score(s)).alias("o"), k.alias("k"), s["t"].alias("t"))))
    return unmarked(F.get(ranked, 0)["t"])


def follow_ups(result: Result) -> DataFrame:
    """piece_id, place, question and detail: neutral questions that point at passages of the piece."""
    first = lambda test: unmarked(F.get(F.filter("_moves", test), 0)["t"])
    quote = lambda t, most: F.when(t.isNotNull(), F.concat(F.lit('"'), _excerpt(t, most), F.lit('"')))
    body = F.coalesce(F.get(F.filter("_flow", lambda p: (p["role"] == "body") & (F.size(p["sequence"]) >= 4)), 0), F.get(F.filter("_flow", lambda p: p["role"] == "body"), 0))
    shape = F.when(body.isNotNull(), F.concat(F.lit("Paragraph "), (body["index"] + 1).cast("string"), F.lit(": "), discourse.pattern(body["sequence"])))
    words = result.new_vocabulary.groupBy("piece_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("word")), 1, 6), ", ").alias("new_words"))
    built = result.categories.where("category = 'discourse' and size(notable) > 0").select("piece_id", F.lower(F.get("notable", 0)["label"]).alias("built"))
    rows = result.pieces.join(words, "piece_id", "left").join(built, "piece_id", "left")
    hard = complex_sentence(F.col("_moves"))
    asked = [
        (F.lit(True), "Can the writer put the main argument into their own words?", quote(first(lambda s: s["move"] == "thesis"), 200)),
        (F.lit(True), "Can the writer say why this evidence was chosen?", quote(first(lambda s: (s["move"] == "evidence") & s["quote"]), 180)),
        (hard.isNotNull(), "Can the writer explain this sentence?", quote(hard, 240)),
        (F.lit(True), "Can the writer build part of the reasoning again, in class?", shape),
        (F.lit(True), "Are there drafts, notes or plans?", F.when(F.col("largestInsertion") >= 40, F.concat(F.lit("In particular for a block of "), F.col("largestInsertion").cast("int").cast("string"), F.lit(" words.")))),
        (F.lit(True), "Does the piece draw on recent lessons?", F.when(F.col("new_words").isNotNull(), F.concat(F.lit("Where do these words come from: "), F.col("new_words"), F.lit("?")))),
        (F.col("built").isNotNull(), "Can the writer talk through how the argument was built?", F.concat(F.lit("Unlike earlier work in "), F.col("built"), F.lit("."))),
    ]
    items = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("place"), F.lit(q).alias("question"), d.alias("detail"))) for k, (test, q, d) in enumerate(asked)]))
    return rows.select("piece_id", F.explode(items).alias("i")).select("piece_id", "i.*")


def report_text(result: Result) -> DataFrame:
    """piece_id and report: the findings as plain text."""
    c = F.col
    level = F.concat(F.rpad(c("category_label"), 20, " "), c("level"), F.when(c("note").isNotNull(), F.concat(F.lit("  "), "note")).otherwise(""))
    levels = result.categories.groupBy("piece_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category_place", level.alias("l")))), lambda x: x["l"]), "\n").alias("levels"))
    item = F.concat(F.lit("- "), c("explanation"))
    found = explained(result.strongest).groupBy("piece_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("l")))), lambda x: x["l"]), "\n").alias("found"))
    rows = summaries(result).join(levels, "piece_id").join(found, "piece_id", "left")
    return rows.select("piece_id", F.concat_ws("\n\n", F.concat(F.lit("Priority: "), "priority"), F.array_join("lines", "\n"), "levels", "found", F.lit(wording.DISCLAIMER)).alias("report"))


def dashboard(result: Result) -> DataFrame:
    """A row per piece for a class: writer, words, priority, the four levels, size of the baseline; the most urgent first."""
    levels = result.categories.groupBy("piece_id").pivot("category", ["style", "discourse", "process", "external"]).agg(F.first("level"))
    rank = F.array_position(F.array(*map(F.lit, ["LOW", "INCONCLUSIVE", "MODERATE", "HIGH"])), F.col("priority"))
    rows = result.pieces.select("piece_id", "writer_id", "word_count").join(result.priorities.select("piece_id", "priority", "converging"), "piece_id").join(levels, "piece_id").join(result.profiles.select("piece_id", "n"), "piece_id")
    return rows.withColumn("urgency", rank).orderBy(F.desc("urgency"), F.desc("converging"), "piece_id")


