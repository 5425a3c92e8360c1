"""The 13 features of how a text came about, from replayed edit logs or from process reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import has, trimmed
from ..functions.text import count_words
from .replay import TEXT_EVENTS

TYPED = ["insert", "replace"]
_TWO_PARAGRAPHS = r"\n\s*\S[\s\S]*\n\s*\S"


@dataclass(frozen=True)
class ProcessSettings:
    session_gap_min: float = 30
    idle_gap_sec: float = 120
    continuous_gap_sec: float = 60
    continuous_min_words: int = 120
    continuous_max_revision: float = 0.05
    bulk_insert_words: int = 40
    min_paste_words: int = 15
    window_ms: int = 60_000
    quick_ms: int = 15_000


def is_surface_change(removed: Column, inserted: Column) -> Column:
    """Whether an edit changes punctuation, case or the spelling of a word only."""
    a, b = trimmed(removed), trimmed(inserted)
    marks = lambda x: has(x, r"^[\W_]*$")
    shorter = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (k <= shorter) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)), k).otherwise(n))
    word = ~has(a, r"\s") & ~has(b, r"\s") & (F.abs(F.length(a) - F.length(b)) <= 2) & (F.length(a) <= 14)
    return F.when((a == "") & (b == ""), True).when(marks(a) & marks(b), True).when(F.lower(a) == F.lower(b), True).when(word, (F.length(a) - same <= 3) | (F.length(b) - same <= 3)).otherwise(False)


def _by_time() -> Window:
    return Window.partitionBy("sample_id").orderBy("id")


def classified(events: DataFrame, s: ProcessSettings = ProcessSettings()) -> DataFrame:
    """Replayed events with edit: surface, substantive or null."""
    w = _by_time()
    put = F.col("type").isin("insert", "paste")
    before = F.coalesce(F.lag("chars_after").over(w), F.lit(0))
    last = F.last(F.when(put, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumns({"_before": before, "_last": last})
    inserted = F.when(F.col("type") == "replace", F.coalesce("text", F.lit(""))).otherwise("")
    removed = F.coalesce("deleted_text", F.lit(""))
    frontier = F.coalesce(F.col("pos") + F.coalesce("length", F.lit(0)) >= F.col("_before") - 1, F.lit(False))
    quick = F.coalesce(F.col("t") - F.col("_last") < s.quick_ms, F.lit(False))
    typo = frontier & quick & (count_words(removed) <= 1) & (inserted == "")
    inside = F.col("mid") & (F.col("inserted_words") >= 3)
    edit = (
        F.when(put, F.when(inside & (F.col("type") == "insert"), "substantive"))
        .when(F.col("type").isin("delete", "replace", "snapshot") & (F.col("deleted") > 0), F.when(is_surface_change(removed, inserted) | typo, "surface").when((count_words(removed) >= 1) | (count_words(inserted) >= 1), "substantive").otherwise("surface"))
        .when((F.col("type") == "snapshot") & (F.col("inserted") > 0) & inside, "substantive")
    )
    return rows.withColumn("edit", edit).drop("_before", "_last")


def _islands(events: DataFrame, gap_ms: float) -> DataFrame:
    """Events with island: a number that grows at each gap or, around events that aren't typing, at each change."""
    w = _by_time()
    typed = F.col("type").isin("insert", "replace", "delete")
    rows = events.where(F.col("type").isin(*TEXT_EVENTS)).withColumn("_typed", typed)
    new = ~F.col("_typed") | ~F.coalesce(F.lag("_typed").over(w), F.lit(False)) | (F.col("t") - F.lag("t").over(w) > gap_ms)
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(w)).where("_typed").drop("_typed", "_new")


def periods(events: DataFrame, s: ProcessSettings = ProcessSettings()) -> DataFrame:
    """Stretches of typing without a long pause: sample_id, start, end, words, inserted, deleted, surviving, calm, long."""
    rows = _islands(events, s.continuous_gap_sec * 1000)
    found = rows.groupBy("sample_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.sum("inserted_words").alias("words"), F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"), F.sum("surviving").alias("surviving"))
    calm = F.col("deleted") / F.greatest(F.lit(1), "inserted") <= s.continuous_max_revision
    return found.withColumn("calm", calm).withColumn("long", F.col("calm") & (F.col("words") >= s.continuous_min_words))


def is_bulk(s: ProcessSettings = ProcessSettings()) -> Column:
    """Whether an event brought in much text at once from elsewhere."""
    saved = (F.col("type") == "snapshot") & (F.col("inserted_words") >= s.bulk_insert_words)
    return (((F.col("type") == "paste") & ~F.col("internal_move")) | saved) & (F.col("inserted_words") >= s.min_paste_words)


def log_features(events: DataFrame, s: ProcessSettings = ProcessSettings()) -> DataFrame:
    """A row per sample with the 13 features, from replayed events."""
    w = _by_time()
    textual = F.col("type").isin(*TEXT_EVENTS)
    final = Window.partitionBy("sample_id")
    rows = classified(events, s).withColumns({"final_words": F.greatest(F.lit(1), F.last("words_after").over(final.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    text_t = F.last(F.when(textual, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = Window.partitionBy("sample_id").orderBy("t").rangeBetween(0, s.window_ms)
    typed_words = F.when(F.col("type").isin(*TYPED), F.col("inserted_words")).otherwise(0)
    rows = rows.withColumns(
        {
            "gap": F.when(textual, F.col("t") - text_t),
            "bulk": is_bulk(s),
            "typed_words": typed_words,
            "minute_words": F.sum(typed_words).over(near),
            "half_t": F.min(F.when(F.col("words_after") >= F.col("final_words") * 0.5, F.col("id"))).over(final),
        }
    )
    rows = rows.withColumn("half_t", F.min(F.when(F.col("id") == F.col("half_t"), F.col("t"))).over(final))
    total = lambda c, test=None: F.sum(F.when(test, F.col(c)).otherwise(0) if test is not None else F.col(c))
    several = has(F.col("text"), _TWO_PARAGRAPHS) | (F.size(F.filter(F.split("text", r"\n\s*\n"), lambda x: trimmed(x) != "")) >= 2)
    found = rows.groupBy("sample_id").agg(
        F.count_if(textual).alias("n"), F.max("final_words").alias("final_words"), F.greatest(F.lit(1), total("surviving")).alias("chars"), total("inserted").alias("inserted"),
        F.coalesce(total("gap", F.col("gap") <= s.idle_gap_sec * 1000), F.lit(0)).alias("active"), F.count_if(F.col("gap") > s.session_gap_min * 60_000).alias("breaks"), total("typed_words").alias("typed"),
        F.count_if(F.col("edit") == "substantive").alias("substantive"), F.count_if(F.col("edit") == "surface").alias("surface"), total("surviving", F.col("t") <= F.col("half_t")).alias("early"),
        total("surviving", F.col("bulk")).alias("pasted"), F.max("minute_words").alias("minute"), F.max(F.when(F.col("bulk"), F.col("inserted_words")).otherwise(0)).alias("largest"),
        F.count_if(F.col("bulk") & (F.col("type") == "paste")).alias("pastes"), F.count_if(F.col("bulk") & F.coalesce(several, F.lit(False))).alias("several"),
    )
    long = periods(events, s).groupBy("sample_id").agg(F.max(F.when(F.col("calm"), F.col("words")).otherwise(0)).alias("longest"), F.sum(F.when(F.col("long"), F.col("surviving")).otherwise(0)).alias("in_long"))
    found = found.join(long, "sample_id", "left")
    c, share = F.col, lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    minutes = c("active") / 60_000
    return found.select(
        "sample_id", minutes.alias("activeMinutes"), F.when(c("n") > 0, c("breaks") + 1).otherwise(0).cast("double").alias("sessions"), F.when(c("active") > 30_000, c("typed") / minutes).alias("typingRate"),
        share("substantive", "final_words").alias("revisionDensity"), share("surface", "final_words").alias("surfaceEditRate"), share("early", "chars").alias("firstDraftShare"),
        F.when(c("inserted") > 0, share("chars", "inserted")).alias("retention"), F.coalesce("longest", F.lit(0)).cast("double").alias("longestContinuous"), F.try_divide(F.coalesce("in_long", F.lit(0)) * 100.0, c("chars")).alias("continuousShare"),
        share("pasted", "chars").alias("pastedShare"), F.greatest("minute", "largest").cast("double").alias("largestInsertion"), c("pastes").cast("double").alias("pasteEvents"), c("several").cast("double").alias("multiParagraphPastes"),
    )


def growth(events: DataFrame) -> DataFrame:
    """Share of the final text that was there at a quarter, a half, three quarters and all of the time: sample_id, at, share."""
    w = Window.partitionBy("sample_id")
    rows = events.withColumns({"start": F.min("t").over(w), "end": F.max("t").over(w)}).withColumn("span", F.greatest(F.lit(1), F.col("end") - F.col("start")))
    aggs = [F.sum(F.when(F.col("t") <= F.col("start") + F.col("span") * at, F.col("surviving")).otherwise(0)).alias(f"s{k}") for k, at in enumerate((0.25, 0.5, 0.75, 1.0))]
    found = rows.groupBy("sample_id").agg(F.greatest(F.lit(1), F.sum("surviving")).alias("chars"), *aggs)
    steps = F.array(*[F.struct(F.lit(at).alias("at"), (F.col(f"s{k}") * 100.0 / F.col("chars")).alias("share")) for k, at in enumerate((0.25, 0.5, 0.75, 1.0))])
    return found.select("sample_id", F.explode(steps).alias("g")).select("sample_id", "g.*")


def activity_segments(events: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Segments of activity: sample_id, segment, kind (paste, writing, revisions, minor edits, submitted), start, end, added,
    deleted and words_after. A pause, a paste and a submission each end one."""
    w = _by_time()
    rows = events.where(F.col("type").isin(*TEXT_EVENTS, "submit"))
    rows = rows.withColumn("_alone", (F.col("type") == "submit") | ((F.col("type") == "paste") & ~F.col("internal_move")))
    new = F.col("_alone") | F.coalesce(F.lag("_alone").over(w), F.lit(True)) | F.coalesce(F.col("t") - F.lag("t").over(w) > gap_ms, F.lit(True))
    rows = rows.withColumn("segment", F.sum(new.cast("int")).over(w))
    found = rows.groupBy("sample_id", "segment").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.sum("inserted").alias("added"), F.sum("deleted").alias("deleted"), F.max_by("words_after", "id").alias("words_after"), F.max("type").alias("last"), F.max("_alone").alias("alone"))
    ratio = F.when(F.col("added") > 0, F.col("deleted") / F.col("added")).otherwise(1.0)
    kind = F.when(F.col("alone"), F.when(F.col("last") == "submit", "submitted").otherwise("paste")).when(F.col("added") < 40, "minor edits").when(ratio > 0.35, "revisions").otherwise("writing")
    return found.withColumn("kind", kind).drop("last", "alone")


def report_features(reports: DataFrame) -> DataFrame:
    """The features that a process report allows, others null, from sample_id, text, metrics (map of names to numbers) and
    pastes (array of struct with chars, words, excerpt, include, found_words: words of the place found in the text, or null)."""
    m = lambda k: F.col("metrics")[k]
    words = lambda p: F.coalesce(p["words"].cast("double"), F.round(p["chars"] / 6), count_words(F.coalesce(p["excerpt"], F.lit(""))).cast("double"))
    kept = F.filter(F.transform(F.filter(F.coalesce("pastes", F.array()), lambda p: F.coalesce(p["include"], F.lit(True))), lambda p: F.struct(words(p).alias("w"), p["found_words"].alias("f"), p["excerpt"].alias("e"))), lambda p: p["w"] >= 15)
    rows = reports.withColumns({"_kept": kept, "_final": F.greatest(F.lit(1), count_words(F.coalesce("text", F.lit(""))))})
    told = F.aggregate("_kept", F.lit(0.0), lambda n, p: n + F.coalesce(p["f"].cast("double"), p["w"]))
    pasted = F.coalesce(F.nullif(told, F.lit(0.0)), F.nullif(m("pastedWords"), F.lit(0.0)), F.round(F.nullif(m("pastedChars"), F.lit(0.0)) / 6), F.lit(0.0))
    rows = rows.withColumn("_pasted", pasted)
    none = F.lit(None).cast("double")
    return rows.select(
        "sample_id", m("writingMinutes").alias("activeMinutes"), m("sessions").alias("sessions"),
        F.when(m("writingMinutes") > 0, F.greatest(F.lit(0.0), F.col("_final") - F.col("_pasted")) / m("writingMinutes")).alias("typingRate"),
        *[none.alias(k) for k in ("revisionDensity", "surfaceEditRate", "firstDraftShare", "retention", "longestContinuous", "continuousShare")],
        F.least(F.lit(100.0), F.col("_pasted") * 100.0 / F.col("_final")).alias("pastedShare"), F.greatest(F.lit(0.0), F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("_kept", lambda p: p["w"])))).alias("largestInsertion"),
        F.when(F.size("_kept") > 0, F.size("_kept").cast("double")).otherwise(F.coalesce(m("pasteCount"), F.lit(0.0))).alias("pasteEvents"),
        F.size(F.filter("_kept", lambda p: F.length(F.coalesce(p["e"], F.lit(""))) > 600)).cast("double").alias("multiParagraphPastes"),
    )
