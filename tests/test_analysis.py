import random

import pytest

from quillspark.operators.features import ALL
from quillspark.plans import analysis, compare, profile, wording
from quillspark.plans.config import Config
from quillspark.sources.store import stored
from pyspark.sql import functions as F

CFG = Config()


def plain(rng, n):
    w = "the a dog cat house tree river walks sees likes small red old near under with and he she they".split()
    return " ".join(" ".join(rng.choices(w, k=rng.randrange(6, 11))).capitalize() + "." for _ in range(n))


def ornate(rng, n):
    w = "ideology interrogates juxtaposition although which perhaps therefore liminality epistemological paradoxical foregrounds society discourse".split()
    return "\n".join("Furthermore, " + ", ".join(" ".join(rng.choices(w, k=9)) for _ in range(4)) + "; moreover." for _ in range(n))


@pytest.fixture(scope="module")
def result(spark):
    rng, rows = random.Random(1), []
    for writer, k, last in (("abrupt", 6, ornate(rng, 12)), ("steady", 5, plain(rng, 40)), ("thin", 1, plain(rng, 40))):
        rows += [(f"{writer}{i}", writer, "baseline", f"2024-0{i + 1}-01", "Essay", plain(rng, 40)) for i in range(k)]
        rows.append((f"{writer}-now", writer, "current", "2024-12-01", "Essay", last))
    rows.append(("abrupt-later", "abrupt", "baseline", "2025-01-01", "Essay", ornate(rng, 3)))
    samples = spark.createDataFrame(rows, "sample_id string, writer_id string, role string, ts string, genre string, text string")
    return analysis.analyze(stored(analysis.featured(samples), "features"))


def test_classes(result):
    got = {r.piece_id: (r.priority, r.sufficiency) for r in result.priorities.collect()}
    assert got == {"abrupt-now": ("HIGH", "preferred"), "steady-now": ("LOW", "preferred"), "thin-now": ("INCONCLUSIVE", "insufficient")}
    assert {r.piece_id: r.n for r in result.profiles.collect()} == {"abrupt-now": 6, "steady-now": 5, "thin-now": 1}


def test_rows_and_tables(result):
    rows = result.rows.collect()
    assert all(r.strength.startswith("Not compared") for r in rows if r.piece_id == "thin-now")
    assert {r.feature_id for r in rows} <= {f.id for f in ALL} and all(r.quality == "Low" for r in rows if r.weak and r.compared)
    top = result.strongest.where("piece_id = 'abrupt-now'").orderBy("rank").collect()
    assert len(top) == 5 and not any(r.weak for r in top)
    assert result.composites.where("piece_id = 'abrupt-now' and composite = 'sentenceComplexity'").first().pct > 100
    assert {"epistemological", "liminality"} <= {r.word for r in result.new_vocabulary.where("piece_id = 'abrupt-now'").collect()}
    assert "interrogates" in {r.verb for r in result.verbs.where("piece_id = 'abrupt-now' and side = 'current'").collect()}


def test_texts_say_nothing_about_conduct(result):
    texts = [r.report for r in analysis.report_text(result).collect()] + [r.explanation for r in analysis.explained(result.rows).collect()]
    texts += [f"{r.question} {r.detail}" for r in analysis.follow_ups(result).collect()] + [x for a in wording.ALTERNATIVES.values() for x in a]
    assert len(texts) > 150 and not [t for t in texts for b in wording.BARRED if b in t.lower()]
    for a in analysis.anomalies(result.rows).collect():
        assert a.explanation and a.alternative_explanations and a.strength in ("Moderate", "High", "Very high")
    assert analysis.dashboard(result).first().piece_id == "abrupt-now"


def test_context_and_dismissal(spark, result):
    samples = result.pieces.select(F.col("piece_id").alias("sample_id"), *[c for c in result.pieces.columns if c != "piece_id"])
    table = samples.unionByName(samples.withColumns({"sample_id": F.concat("sample_id", F.lit("x")), "role": F.lit("baseline"), "ts": F.lit("2023-01-01")}).crossJoin(spark.range(5)).drop("id").withColumn("sample_id", F.concat("sample_id", F.monotonically_increasing_id().cast("string"))))
    table = table.withColumn("hedgingRate", F.when(F.col("role") == "current", 90.0).otherwise(F.col("hedgingRate")))
    table = stored(table, "changed")
    one = analysis.analyze(table)
    two = analysis.analyze(table, writers=spark.createDataFrame([("steady", True)], "writer_id string, ell boolean"), dismissed=spark.createDataFrame([("steady-now", "hedgingRate")], "sample_id string, feature_id string"))
    z = lambda r: r.rows.where("piece_id = 'steady-now' and feature_id = 'hedgingRate'").first()
    assert abs(z(two).z - 0.7 * z(one).z) < 1e-9 and z(two).dismissed and not z(one).dismissed
    assert one.strongest.where("feature_id = 'hedgingRate' and piece_id = 'steady-now'").count() == 1 and two.strongest.where("feature_id = 'hedgingRate' and piece_id = 'steady-now'").count() == 0


def test_similarity_and_sufficiency(spark):
    row = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in ({"genre": "E", "subject": "", "assignment_type": "x", "timed": False, "word_count": 200} | k).items()])
    w = lambda b, c: spark.range(1).select(b.alias("b"), c.alias("c")).select(profile.similarity_weight(lambda k: F.col(f"b.{k}"), lambda k: F.col(f"c.{k}"), CFG)).first()[0]
    assert [w(row(), row()), w(row(assignment_type="y"), row()), w(row(assignment_type="y", genre="Z"), row()), w(row(timed=True), row()), w(row(word_count=50), row())] == [1, 0.9, 0.4, 0.3, 0.5]
    s = lambda n, g: spark.range(1).select(profile.sufficiency(F.lit(n), F.lit(g), CFG)).first()[0]
    assert [s(2, 1), s(3, 1), s(6, 2), s(12, 3), s(12, 1)] == ["insufficient", "minimum", "preferred", "strong", "preferred"]


def test_trend_and_statistics(spark):
    rows = [("p", f"s{i}", w, f"2024-{i:02d}", float(v), float(u)) for i, (v, u, w) in enumerate(zip((10, 12, 14, 16, 18), (10, 10.5, 9.8, 10.2, 10), (1.0, 0.4, 1.0, 0.9, 0.5), strict=True))]
    pairs = spark.createDataFrame(rows, "piece_id string, sample_id string, weight double, ts string, mattr double, ttr300 double")
    got = {r.feature_id: r for r in profile.statistics(pairs, CFG, ["mattr", "ttr300"]).collect()}
    a, b = got["mattr"], got["ttr300"]
    assert abs(a.next - 20) < 1e-9 and a.r2 > 0.99 and b.r2 < 0.5 and a.n == 5 and a.points == [10, 12, 14, 16, 18]
    ws, vs = [r[2] for r in rows], [r[4] for r in rows]
    m = sum(w * v for w, v in zip(ws, vs, strict=True)) / sum(ws)
    assert abs(a.mean - m) < 1e-9 and abs(a.sd - (sum(w * (v - m) ** 2 for w, v in zip(ws, vs, strict=True)) / sum(ws) * 5 / 4) ** 0.5) < 1e-9


@pytest.mark.parametrize("index, level", [([4, 0, 0, 0], "MODERATE"), ([3, 3, 0, 0], "HIGH"), ([1, 1, 0, 0], "LOW"), ([2, 2, 2, 0], "HIGH"), ([1, 1, 1, 0], "MODERATE"), ([-1, -1, -1, -1], "INCONCLUSIVE")])
def test_priority(spark, index, level):
    cats = spark.createDataFrame([("p", i >= 0, i) for i in index], "piece_id string, assessed boolean, index int")
    prof = spark.createDataFrame([("p", "strong")], "piece_id string, sufficiency string")
    assert compare.priorities(cats, prof).first().priority == level


def test_config_merges_known_keys():
    c = CFG.merged({"baseline": {"minimum": 2, "other": 1}, "nothing": {"x": 1}, "reference": {"retention": (1, 2), "new": (0, 0)}})
    assert c.baseline.minimum == 2 and c.reference["retention"] == (1, 2) and "new" not in c.reference and CFG.baseline.minimum == 3
