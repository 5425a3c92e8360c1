"""Samples of a class, sums of logs, unions of ranges."""

import duckdb

from quillspark import catalog
from quillspark.operators import replay, totals
from quillspark.plans import roster

SAMPLE = "sample_id string, writer_id string, assignment_id string, role string, include boolean, authentic boolean, ts string, genre string, assignment_type string, subject string, timed boolean, mechanicsRate double"
ROWS = [
    ("a", "w", "x", "baseline", None, None, "1", "essay", None, "art", None, 1.0),
    ("b", "w", "x", "baseline", False, None, "2", "essay", None, "art", None, 2.0),
    ("c", "w", "x", "current", None, None, "3", "essay", None, "art", None, None),
    ("d", "v", "y", "current", None, None, None, "story", None, None, True, 4.0),
    ("e", "v", None, "current", None, None, "4", None, None, None, None, 5.0),
]


def test_assignments(spark):
    samples = spark.createDataFrame(ROWS, SAMPLE)
    assignments = spark.createDataFrame([("x",), ("y",), ("z",)], "assignment_id string")
    assert dict(roster.pieces_per_assignment(assignments, samples).collect()) == {"x": 1, "y": 1, "z": 0}
    assert [r.sample_id for r in roster.of_assignment(samples, "x").collect()] == ["c"] and roster.of_assignment(samples, None).count() == 3
    edited = spark.createDataFrame([("x", "report", "lab", None, True)], "assignment_id string, genre string, assignment_type string, subject string, timed boolean")
    got = {r.sample_id: (r.genre, r.assignment_type, r.subject, r.timed) for r in roster.with_assignments(samples, edited).collect()}
    assert got == {"a": ("essay", None, "art", None), "b": ("essay", None, "art", None), "c": ("report", "lab", None, True), "d": ("story", None, None, True), "e": (None,) * 4}


def test_into_baseline(spark):
    samples = spark.createDataFrame(ROWS, SAMPLE)
    accepted = spark.createDataFrame([("c",), ("c",), ("b",), ("none",)], "sample_id string")
    new = roster.into_baseline(samples, accepted)
    assert new.columns == samples.columns
    got = {r.sample_id: (r.role, r.include, r.authentic) for r in new.collect()}
    assert got == {"a": ("baseline", None, None), "b": ("baseline", False, None), "c": ("baseline", True, True), "d": ("current", None, None), "e": ("current", None, None)}


def test_series(spark):
    rows = roster.series(spark.createDataFrame(ROWS, SAMPLE)).collect()
    assert sorted((r.writer_id, r.place, r.sample_id, r.value) for r in rows) == [("v", 1, "d", 4.0), ("v", 2, "e", 5.0), ("w", 1, "a", 1.0)]


def test_most_similar(spark):
    pairs = [("p", "a", 0.5, "1"), ("p", "b", 0.9, "2"), ("p", "c", 0.9, "3"), ("p", "d", 0.9, None), ("q", "e", 0.1, None)]
    got = roster.most_similar(spark.createDataFrame(pairs, "piece_id string, sample_id string, weight double, ts string")).collect()
    assert {(r.piece_id, r.sample_id, r.weight) for r in got} == {("p", "c", 0.9), ("q", "e", 0.1)}


def test_merged_ranges(spark):
    rows = [(1, 5, 9), (1, 0, 3), (1, 4, 4), (1, 11, 12), (1, 0, 1), (2, 0, 20), (2, 3, 4), (2, 22, 23), (None, 1, 2)]
    got = totals.merged_ranges(spark.createDataFrame(rows, "k int, start int, end int"), "k").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, 9), (1, 11, 12), (2, 0, 20), (2, 22, 23), (None, 1, 2)]))


def test_totals_and_submission(spark):
    log = [("s", 1, 0, "insert", 0, None, "plain words \nhere"), ("s", 2, 1, "paste", 5, None, " pasted part of some length"), ("s", 3, 2, "delete", 0, 5, None), ("t", 1, 0, "submit", None, None, None)]
    events = replay.replayed(replay.normalized(spark.createDataFrame(log, "sample_id string, source int, t long, type string, pos int, length int, text string"))[0])
    got = {r.sample_id: r for r in totals.totals(events).collect()}
    assert (got["s"].inserted, got["s"].deleted, got["s"].typed, got["s"].pasted_surviving) == (44, 5, 17, 27) and abs(got["s"].revision_ratio - 5 / 44) < 1e-9
    assert got["t"].revision_ratio == 0
    final = " pasted part of some length words\r\nhere \n"
    sent = lambda text: spark.createDataFrame([("s", text)], "sample_id string, text string")
    for text, matches in ((final, True), (final + "x", False)):
        assert {r.sample_id: r.matches for r in totals.matches_submission(events, sent(text)).collect()}["s"] is matches


def test_merged_ranges_of_odd_events_as_sql(spark, tmp_path):
    """Events without a time or user, and before 1970."""
    times = ["null", "null", "'1969-12-31 22:30:00'", "'1969-12-31 23:59:59.9995'", "'1970-01-01 00:30:00'", "'1969-12-01 10:15:00'", "'1969-12-01 18:10:00'", "'2024-01-01 05:00:00'"]
    con = duckdb.connect()
    con.sql("create table events as select u::bigint as user_id, t::timestamp as ts from (values " + ", ".join(f"({u}, {t})" for u in (1, 2, "null") for t in times) + ") v(u, t)")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalog.QUERIES["merged_ranges"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(f"select user_id, start, stop from ({catalog.ORACLE_SQL['merged_ranges']})").fetchall(), key=str)
    assert len([r for r in got if r.start is None]) == 3
