"""The named queries of the engine over the provided tables, and their SQL where SQL can express them.

Documents stand for writing samples: source is the writer, doc_id the order in time, lang the genre, and each source's last
document the piece; an English passage is appended to each text (essays); texts that need an edit log get a derived one
(operators.replay.log_of). Rates are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .essays import with_passage
from .functions import text as tx
from .functions.lexicon import ADVANCED_VERBS, BASIC_VERBS
from .operators import discourse, process, replay, style
from .operators import totals as tot
from .operators.features import DISCOURSE, PROCESS, STYLE
from .plans import analysis, compare, profile, roster
from .plans.config import Config
from .sources.store import stored
from .streaming import live

CFG = Config()
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each with an English passage after its text."""
    return plain_docs(spark, sf_dir).withColumn("text", with_passage(F.col("text"), F.col("doc_id")))


def _value(name: str) -> list:
    return ["doc_id", F.round(name, 6).alias("value")]


def _style(name: str) -> Query:
    return lambda spark, d: style.of_texts(docs(spark, d), only=[name]).select(*_value(name))


def _discourse(name: str) -> Query:
    return lambda spark, d: discourse.of_texts(docs(spark, d), only=[name]).select(*_value(name))


def _documented(columns: Callable[[], list]) -> Query:
    def run(spark, d):
        made = columns()
        return tx.documented(docs(spark, d), only=tx.names_in(made)).select("doc_id", *made)

    return run


def _distinct_words(column: str, make) -> Query:
    def run(spark, d):
        words = tx.documented(docs(spark, d), only=["_words"]).select(F.explode("_words").alias("word")).distinct()
        return words.select("word", make(F.col("word")).alias(column))

    return run


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = tx.documented(docs(spark, d), only=["_sents"]).withColumn("l", F.transform("_sents", lambda s: F.size(s["w"]))).where(F.size("l") > 0)
    return rows.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.array_max("l").cast("long").alias("longest"))


def _p90(spark: SparkSession, d: str) -> DataFrame:
    rows = tx.documented(docs(spark, d), only=["_sents"]).withColumn("l", F.array_sort(F.transform("_sents", lambda s: F.size(s["w"]))))
    n = F.size("l")
    return rows.where(n >= 10).select("doc_id", F.get("l", F.least(n - 1, F.floor(n * 0.9).cast("int"))).cast("long").alias("p90"))


def _moves(spark: SparkSession, d: str) -> DataFrame:
    rows = discourse.moved(docs(spark, d), ["_moves"]).select("doc_id", F.explode("_moves").alias("s"))
    return rows.groupBy("doc_id", F.col("s.p").cast("long").alias("paragraph"), F.col("s.move").alias("move"), F.col("s.level").alias("level")).agg(F.count("*").alias("n"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    rows = discourse.moved(docs(spark, d), ["_flow", "_chains"])
    rows = rows.withColumns({"typical_chain": discourse.typical_chain(F.col("_chains")), "ends": discourse.conclusion_strategy(F.col("_flow"))})
    return rows.select("doc_id", F.explode("_flow").alias("p"), "typical_chain", "ends").select("doc_id", "p.index", "p.role", discourse.pattern(F.col("p.sequence")).alias("pattern"), "p.distinct", "typical_chain", "ends")


def with_last(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """rows with last, the greatest doc_id of the source: an aggregate joined back, so that no writer's texts meet in a task."""
    last = table(spark, d, "documents").groupBy(F.col("source").alias("_writer")).agg(F.max("doc_id").alias("last"))
    return rows.join(last, F.col("source").eqNullSafe(F.col("_writer"))).drop("_writer")


def _writers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as samples of writers, with their mean sentence length."""
    rows = with_last(style.of_texts(docs(spark, d), only=["meanSentenceLength"]), spark, d)
    last = F.col("last")
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("writer_id"), F.when(F.col("doc_id") == last, "current").otherwise("baseline").alias("role"), none("boolean").alias("include"), none("boolean").alias("authentic"),
        F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("ts"), F.col("lang").alias("genre"), none("string").alias("subject"), none("string").alias("assignment_type"), none("boolean").alias("timed"),
        F.col("_n").alias("word_count"), none("boolean").alias("has_process"), "meanSentenceLength",
    )


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    samples = stored(_writers(spark, d), "writers")
    current = samples.where("role = 'current'")
    return profile.baseline_pairs(samples, current, CFG, ["meanSentenceLength"]), current


def _profiled(make) -> Query:
    return lambda spark, d: make(*_pairs(spark, d))


def _statistics(pairs: DataFrame, _: DataFrame) -> DataFrame:
    return profile.statistics(pairs, CFG, ["meanSentenceLength"])


def _deviation(pairs: DataFrame, current: DataFrame) -> DataFrame:
    rows = _statistics(pairs, current).join(current.select(F.col("sample_id").alias("piece_id"), "meanSentenceLength"), "piece_id")
    spread = F.greatest("sd", CFG.baseline.relative_spread * F.abs("mean"), F.lit(2.5))
    return rows.where("meanSentenceLength is not null").select("piece_id", F.round((F.col("meanSentenceLength") - F.col("mean")) / spread, 6).alias("raw_z"))


def _verb_counts(spark: SparkSession, d: str) -> DataFrame:
    words = tx.documented(docs(spark, d), only=["_words"]).select("source", F.explode("_words").alias("verb"))
    return words.where(F.col("verb").isin(*BASIC_VERBS, *ADVANCED_VERBS)).groupBy("source", "verb").agg(F.count("*").alias("n"))


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Long words of a writer's last document that no earlier one has: an anti join on writer and word."""
    rows = with_last(tx.documented(docs(spark, d), only=["_words"]), spark, d).select("source", "doc_id", "last", F.explode(F.array_distinct("_words")).alias("word"))
    new, old = rows.where("doc_id = last and length(word) >= 8").select("source", "word").distinct(), rows.where("doc_id < last").select("source", "word").distinct()
    return new.join(old, ["source", "word"], "left_anti").groupBy("source").agg(F.count("*").alias("n_new"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents as samples with their texts."""
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return with_last(docs(spark, d), spark, d).select(key.alias("sample_id"), F.col("source").alias("writer_id"), F.when(F.col("doc_id") == F.col("last"), "current").otherwise("baseline").alias("role"), key.alias("ts"), F.col("lang").alias("genre"), "text")


def _of_pieces(rows: DataFrame) -> DataFrame:
    """rows as a table, with the texts of pieces only, as no other is read again."""
    return stored(rows.withColumn("text", F.when(F.col("role") == "current", F.col("text"))), "features")


def analysed(spark: SparkSession, d: str, extras: tuple[str, ...] = (), only: list[str] | None = None) -> analysis.Result:
    """The whole analysis of the documents, without process data; extras and only as in plans.analysis."""
    return analysis.analyze(_of_pieces(analysis.featured(_pieces(spark, d), extras=extras)), only=only)


def _worded(make, extra: str) -> Query:
    """What is made of words only takes no features."""

    def run(spark, d):
        table = _of_pieces(analysis.worded(_pieces(spark, d), (extra,)))
        return make(table, table.where("role = 'current'"), CFG)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to the priority of each writer's latest document."""
    return analysed(spark, sf_dir).priorities


def _analysed(make, extras: tuple[str, ...] = (), only: list[str] | None = None) -> Query:
    return lambda spark, d: make(analysed(spark, d, extras, only))


# Events: a user is a sample, value its inserted words; pauses are hours, as the table's events lie far apart.
HOURS12 = 12 * 3_600_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "ts")


def _by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("t")


def _ev_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _ev_active(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("gap", F.col("u") - F.lag("u").over(Window.partitionBy("user_id").orderBy("u")))
    return rows.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("gap") <= HOURS12 * 1000, F.col("gap"))), F.lit(0)).alias("active_us"))


def _ev_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("s", F.sum("value").over(_by_user().rangeBetween(0, 86_400_000)))
    return rows.groupBy("user_id").agg(F.round(F.max("s"), 4).alias("largest"))


def _ev_islands(spark: SparkSession, d: str) -> DataFrame:
    w = _by_user()
    before = F.lag("event_type").over(w)
    new = (F.col("event_type") == "error") | before.isNull() | (before == "error") | (F.col("t") - F.lag("t").over(w) > HOURS12)
    rows = _events(spark, d).withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _ev_growth(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, d).withColumn("u", us).withColumns({"s": F.min("u").over(w), "e": F.max("u").over(w)})
    half = F.sum(F.when(F.col("u") - F.col("s") <= F.expr("(e - s) div 2"), F.col("value")))
    return rows.groupBy("user_id").agg(F.sum("value").alias("all"), half.alias("half")).where("`all` > 0").select("user_id", F.round(F.col("half") * 100.0 / F.col("all"), 4).alias("at_half"))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    return replay.replayed(replay.normalized(replay.log_of(plain_docs(spark, d)))[0])


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).where("final_text is not null").select("sample_id", F.md5("final_text").alias("text_md5"), F.length("final_text").cast("long").alias("chars"))


def _process(name: str) -> Query:
    return lambda spark, d: process.log_features(_replayed(spark, d)).select("sample_id", F.round(name, 6).alias("value"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return tot.totals(_replayed(spark, d)).withColumn("revision_ratio", F.round("revision_ratio", 6))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Every third text is submitted with blanks after it, every third with a letter more, every third with other line ends."""
    kind = F.pmod("doc_id", F.lit(3))
    text = F.when(kind == 0, F.concat("text", F.lit(" \t\n"))).when(kind == 1, F.concat("text", F.lit("x"))).otherwise(F.regexp_replace("text", "\n", " \r\n"))
    return tot.matches_submission(_replayed(spark, d), plain_docs(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), text.alias("text")))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """The hours from each event on, of each user; whole hours and milliseconds towards 1970, as the SQL has them."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000 div 3600000")
    rows = table(spark, d, "events").select("user_id", start.alias("start"), (start + 6).alias("end"))
    return tot.merged_ranges(rows, "user_id").select("user_id", "start", F.col("end").alias("stop"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Documents as samples whose assignment is their language, without texts."""
    rows = with_last(table(spark, d, "documents").select("doc_id", "source", "lang"), spark, d)
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("writer_id"), F.col("lang").alias("assignment_id"), F.when(F.col("doc_id") == F.col("last"), "current").otherwise("baseline").alias("role"),
        none("boolean").alias("include"), none("boolean").alias("authentic"), F.col("lang").alias("genre"), none("string").alias("assignment_type"), none("string").alias("subject"), none("boolean").alias("timed"),
    )


def _per_assignment(spark: SparkSession, d: str) -> DataFrame:
    return roster.pieces_per_assignment(table(spark, d, "documents").select(F.col("lang").alias("assignment_id")).where("lang is not null").distinct(), _samples(spark, d))


def _into_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of even number are accepted."""
    rows = roster.into_baseline(_samples(spark, d), table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("sample_id")))
    return rows.groupBy("role", "include", "authentic").agg(F.count("*").alias("n"))


def _assignment_edit(spark: SparkSession, d: str) -> DataFrame:
    """The assignment en becomes a timed essay."""
    edited = spark.range(1).select(F.lit("en").alias("assignment_id"), F.lit("essay").alias("genre"), F.lit("analysis").alias("assignment_type"), F.lit(None).cast("string").alias("subject"), F.lit(True).alias("timed"))
    return roster.with_assignments(_samples(spark, d), edited).groupBy("role", "genre", "assignment_type", "timed").agg(F.count("*").alias("n"))


SERIES = ["meanSentenceLength", "academicRate", "rareWordRate", "mechanicsRate"]


def _series(spark: SparkSession, d: str) -> DataFrame:
    rows = with_last(style.of_texts(docs(spark, d), only=SERIES), spark, d).withColumns({"writer_id": F.col("source"), "sample_id": F.col("doc_id"), "ts": F.col("doc_id"), "include": F.lit(True), "authentic": F.lit(True)})
    rows = rows.withColumn("role", F.when(F.col("doc_id") == F.col("last"), "current").otherwise("baseline"))
    return roster.series(rows, SERIES).withColumn("value", F.round("value", 6))


QUERIES: dict[str, Query] = {
    "words": _documented(lambda: [F.col("_n").cast("long").alias("n_words"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct")]),
    "sentences": _sentences,
    "paragraphs": _documented(lambda: [F.size("_paras").cast("long").alias("n_paragraphs")]),
    "quotes": _documented(lambda: [F.size("_quotes").cast("long").alias("n_quotes")]),
    "syllables": _distinct_words("n", tx.syllables),
    "stems": _distinct_words("stem", tx.stem),
    "p90_sentence": _p90,
    "discourse_moves": _moves,
    "paragraph_patterns": _flow,
    **{f"style_{f.id}": _style(f.id) for f in STYLE},
    **{f"discourse_{f.id}": _discourse(f.id) for f in DISCOURSE},
    "similarity_weight": _profiled(lambda p, c: p.select("piece_id", F.col("sample_id").alias("doc_id"), "weight")),
    "n_eff": _profiled(lambda p, c: profile.summary(p, c, CFG).where("n > 0").select("piece_id", "n", F.round("n_eff", 6).alias("n_eff"), "genres")),
    "sufficiency": _profiled(lambda p, c: profile.summary(p, c, CFG).where("n > 0").select("piece_id", "sufficiency")),
    "weighted_profile": _profiled(lambda p, c: _statistics(p, c).select("piece_id", *[F.round(k, 6).alias(a) for k, a in (("mean", "mean"), ("sd", "sd"), ("min", "lo"), ("max", "hi"))], "n")),
    "trend": _profiled(lambda p, c: _statistics(p, c).where("n >= 4").select("piece_id", *[F.round(k, 6).alias(k) for k in ("slope", "r2", "next")])),
    "deviation": _profiled(_deviation),
    "verb_counts": _verb_counts,
    "most_similar": _profiled(lambda p, c: roster.most_similar(p)),
    "trend_series": _series,
    "pieces_per_assignment": _per_assignment,
    "into_baseline": _into_baseline,
    "assignment_edit": _assignment_edit,
    "edit_totals": _totals,
    "matches_submission": _matches,
    "merged_ranges": _ranges,
    "genre_counts": lambda spark, d: table(spark, d, "documents").groupBy(F.lower("lang").alias("genre")).agg(F.count("*").alias("n")),
    "first_seen_words": _first_seen,
    "compare": _analysed(lambda r: r.rows.select("piece_id", "feature_id", "value", "z", "deviation", "strength", "quality", "trend", "outside", "pct_change")),
    "explanations": _analysed(lambda r: analysis.anomalies(r.rows)),
    "category": _analysed(lambda r: r.categories.drop("notable")),
    "priority": flagship,
    "strongest": _analysed(lambda r: r.strongest.select("piece_id", "rank", "feature_id", "z", "weight")),
    "composites": _analysed(lambda r: r.composites, only=list(dict.fromkeys(f for _, fs in compare.COMPOSITES for f in fs))),
    "new_vocabulary": _worded(analysis.new_vocabulary, "_stems"),
    "verb_repertoire": _worded(analysis.verb_repertoire, "_verbs"),
    "summaries": _analysed(analysis.summaries),
    "followups": _analysed(analysis.follow_ups, ("_stems",)),
    "report_text": _analysed(analysis.report_text),
    "class_dashboard": _analysed(analysis.dashboard),
    "ev_sessions": _ev_sessions,
    "ev_active": _ev_active,
    "ev_window": _ev_window,
    "ev_islands": _ev_islands,
    "ev_growth": _ev_growth,
    "replay_roundtrip": _roundtrip,
    **{f"process_{f.id}": _process(f.id) for f in PROCESS},
    "activity_segments": lambda spark, d: process.activity_segments(_replayed(spark, d)),
    "draft_growth": lambda spark, d: process.growth(_replayed(spark, d)),
    "log_sessions": lambda spark, d: live.sessions(replay.log_of(plain_docs(spark, d)).withColumn("source", F.col("source").cast("int"))),
    "merged_keystrokes": lambda spark, d: live.merged_keystrokes(replay.log_of(plain_docs(spark, d))),
}

ORACLE_SQL: dict[str, str] = {
    **oracle.PRIMITIVES,
    "discourse_moves": oracle.moves(),
    **{f"style_{f.id}": q for f in STYLE if (q := oracle.style(f.id))},
    **{f"discourse_{f.id}": oracle.discourse(f.id) for f in DISCOURSE},
    **oracle.PROFILE,
    **oracle.EVENTS,
    **oracle.LOG,
    **oracle.ROSTER,
    "trend_series": oracle.series(SERIES),
}
