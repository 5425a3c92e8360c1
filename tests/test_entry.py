"""The driver contract, and queries against their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark import catalog

D = "/root/testdata/sf0.001"
SAMPLE = [
    "words", "sentences", "paragraphs", "stems", "p90_sentence", "discourse_moves", "style_mattr", "style_rareWordRate", "style_transitionRate", "style_introClauseRate", "style_repeatedPhraseRate",
    "discourse_chainLength", "discourse_claimRepetition", "discourse_reasoningDepth", "weighted_profile", "trend", "ev_sessions", "ev_active", "ev_islands", "replay_roundtrip", "process_retention",
    "most_similar", "trend_series", "pieces_per_assignment", "into_baseline", "assignment_edit", "edit_totals", "matches_submission", "merged_ranges",
]


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(catalog.QUERIES) <= set(names) and len(catalog.ORACLE_SQL) > 90


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, D)
    ours = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    sql = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(sql.columns) == sorted(df.columns)
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert ours == sorted((tuple(_plain(r[i]) for i in at) for r in sql.fetchall()), key=str)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and {r.priority for r in rows} <= {"LOW", "MODERATE", "HIGH", "INCONCLUSIVE"}
