"""Live edit events: sessions by event time, insertions per minute, and replay with state.

Events are rows sample_id, source, t (ms), type, pos, length, text. A batch job over the complete log stays authoritative: it
sorts all events, while a stream can only wait as long as its watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import count_words, settled
from ..operators.replay import TEXT_EVENTS, Document, Event

EVENT = "sample_id string, source int, t long, type string, pos int, length int, text string"
# Keystrokes within two seconds are one event of up to sixty characters.
MERGE_MS, MERGE_LENGTH = 2000, 60


def timed(events: DataFrame) -> DataFrame:
    """Events with event time."""
    return events.withColumn("at", F.timestamp_millis("t"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sittings of a sample, batch or stream: sample_id, start, end, events and typed words. A pause of exactly the gap still
    belongs to a sitting; on a stream, events later than the watermark are left to the batch job."""
    rows = timed(events).where(F.col("type").isin(*TEXT_EVENTS))
    typed = F.when(F.col("type").isin("insert", "replace"), count_words(F.coalesce("text", F.lit("")))).otherwise(0)
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    found = rows.withColumn("typed", typed).groupBy("sample_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("typed").alias("typed_words"))
    return found.select("sample_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "typed_words")


def minute_insertions(events: DataFrame, late: str = "1 hour", slide: str = "10 seconds") -> DataFrame:
    """Words put in per sliding minute; the exact largest minute, of any start, is a batch figure."""
    rows = timed(events).where(F.col("type").isin("insert", "replace"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    found = rows.groupBy("sample_id", F.window("at", "60 seconds", slide).alias("w")).agg(F.sum(count_words(F.coalesce("text", F.lit("")))).alias("words"))
    return found.select("sample_id", F.col("w.start").alias("start"), "words")


def late_events(events: DataFrame, seen_until: DataFrame) -> DataFrame:
    """Events older than what a sample was replayed up to (sample_id, t_max), for the table of late ones."""
    return events.join(seen_until, "sample_id").where("t < t_max").select(events.columns)


STATE = "document binary, ids long, t_max long"
REPLAYED = "sample_id string, t_max long, events long, chars int, words int, warnings int, late long, final_text string"


def live_replay(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The text of each sample as far as its events have come: a row per sample and trigger that brought some. Events of a
    trigger are put in order; those older than what was replayed before are counted as late and left out. A sample's state
    goes after an idle time of processing."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            raw, n, seen = state.get
            doc = pickle.loads(raw)
        else:
            doc, n, seen = Document(), 0, -1
        rows = pd.concat(list(batches)).sort_values(["t", "source"], kind="stable")
        late = int((rows["t"] < seen).sum())
        whole = lambda v: None if pd.isna(v) else int(v)
        for r in rows[rows["t"] >= seen].itertuples(index=False):
            doc.apply(Event(n, int(r.t), r.type, whole(r.pos), whole(r.length), r.text))
            n, seen = n + 1, int(r.t)
        state.update((pickle.dumps(doc), n, seen))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], seen, n, len(doc.text), doc.words, doc.warnings, late, doc.text)], columns=[c.split()[0] for c in REPLAYED.split(", ")])

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return events.groupBy("sample_id").applyInPandasWithState(fold, REPLAYED, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def merged_keystrokes(events: DataFrame) -> DataFrame:
    """Captured events with keystrokes that follow each other merged: insertions that continue each other, and deletions that
    go on at the same place or just before, each within two seconds; an insertion takes more while it is shorter than sixty
    characters. Runs that could merge are islands; a fold over an island's lengths starts a new event where one is full."""
    w = Window.partitionBy("sample_id").orderBy("t", "source")
    lag = lambda c: F.lag(c).over(w)
    near = F.col("t") - lag("t") < MERGE_MS
    typed = (F.col("type") == "insert") & (lag("type") == "insert") & (F.col("pos") == lag("pos") + F.length(lag("text")))
    erased = (F.col("type") == "delete") & (lag("type") == "delete") & ((F.col("pos") + F.col("length") == lag("pos")) | (F.col("pos") == lag("pos")))
    rows = events.withColumn("_new", (~F.coalesce(near & (typed | erased), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    events = F.array_sort(F.collect_list(F.struct("t", "source", "type", "pos", "length", "text")))
    runs = settled(rows.groupBy("sample_id", "_run").agg(events.alias("_ev")), {"_ev": F.col("_ev")})
    added = lambda e: F.when(e["type"] == "insert", F.coalesce(F.length(e["text"]), F.lit(0))).otherwise(0)
    begin = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(MERGE_LENGTH).alias("long"), F.lit(0).alias("k"))

    def step(acc, e):
        full = (acc["long"] >= MERGE_LENGTH) & ((acc["k"] == 0) | (e["type"] == "insert"))
        cuts = F.when(full, F.concat(acc["cuts"], F.array(acc["k"]))).otherwise(acc["cuts"])
        return F.struct(cuts.alias("cuts"), (F.when(full, 0).otherwise(acc["long"]) + added(e)).alias("long"), (acc["k"] + 1).alias("k"))

    cut = settled(runs, {"_cuts": F.aggregate("_ev", begin, step)["cuts"]})
    each = cut.select("sample_id", "_ev", "_cuts", F.posexplode("_cuts").alias("_j", "_from"))
    upto = F.coalesce(F.get("_cuts", F.col("_j") + 1), F.size("_ev"))
    each = settled(each.select("sample_id", F.slice("_ev", F.col("_from") + 1, upto - F.col("_from")).alias("_e")), {"_e": F.col("_e")})
    one, texts = F.get("_e", 0), F.filter(F.transform("_e", lambda e: e["text"]), lambda x: x.isNotNull())
    low, total = F.array_min(F.transform("_e", lambda e: e["pos"])), F.aggregate("_e", F.lit(0), lambda a, e: a + F.coalesce(e["length"], F.lit(0)))
    return each.select(
        "sample_id", one["source"].alias("source"), F.array_max(F.transform("_e", lambda e: e["t"])).alias("t"), one["type"].alias("type"), F.when(one["type"] == "delete", low).otherwise(one["pos"]).alias("pos"),
        F.when(F.exists("_e", lambda e: e["length"].isNotNull()), total).cast("int").alias("length"), F.when(F.size(texts) > 0, F.array_join(texts, "")).alias("text"),
    )
