import random

from quillspark.operators import process as pr
from quillspark.operators import replay as rp
from pyspark.sql import functions as F


def frame(spark, logs):
    rows = [(s, k, e.get("t"), e.get("type"), e.get("pos"), e.get("length"), e.get("text")) for s, log in logs.items() for k, e in enumerate(log)]
    return spark.createDataFrame(rows, "sample_id string, source int, t long, type string, pos int, length int, text string")


def random_log(rng, n=60):
    text, log = "", []
    for k in range(n):
        kind = rng.choice(["insert"] * 4 + ["delete", "replace", "paste", "snapshot", "focus"])
        new = "".join(rng.choices("ab é'\n", k=rng.randrange(1, 9)))
        pos, length = rng.randrange(len(text) + 3), rng.randrange(6)
        log.append({"t": k * 700, "type": kind, "pos": pos, "length": length, "text": new})
        at = min(pos, len(text))
        if kind in ("insert", "paste"):
            text = text[:at] + new + text[at:]
        elif kind == "delete":
            text = text[:pos] + text[pos + length :]
        elif kind == "replace":
            text = text[:pos] + text[pos + length :]
            text = text[: min(pos, len(text))] + new + text[min(pos, len(text)) :]
        elif kind == "snapshot":
            text = new
    return log, text


def test_replay_against_plain_edits(spark):
    rng = random.Random(3)
    logs, finals = {}, {}
    for k in range(25):
        logs[f"s{k}"], finals[f"s{k}"] = random_log(rng)
    good, bad = rp.normalized(frame(spark, logs))
    assert bad.count() == 0
    rows = rp.replayed(good).collect()
    for s, text in finals.items():
        own = sorted((r for r in rows if r.sample_id == s), key=lambda r: r.id)
        assert own[-1].final_text == text and own[-1].words_after == rp.count_words(text) and own[-1].chars_after == len(text)
        spans = sorted((x.start, x.end) for r in own for x in r.ranges)
        assert [a for a, _ in spans] == [0] * bool(text) + [b for _, b in spans[:-1]] and sum(r.surviving for r in own) == len(text)


def test_rejects(spark):
    log = [{"t": None, "type": "insert", "pos": 0, "text": "a"}, {"t": 1, "type": "type", "text": "x"}, {"t": 2, "type": "insert", "pos": 0}, {"t": 3, "type": "paste", "pos": -1, "text": "x"}, {"t": 4, "type": "DELETE", "pos": 0}, {"t": 9, "type": "Submit"}, {"t": 5, "type": "insert", "pos": 0, "text": "ok"}]
    good, bad = rp.normalized(frame(spark, {"s": log}))
    assert [r.problem for r in bad.orderBy("source").collect()] == ["missing or invalid time", "unknown type", "text is missing", "invalid position", "invalid length"]
    assert [(r.id, r.type) for r in good.orderBy("id").collect()] == [(0, "insert"), (1, "submit")]


def words(n, start=0):
    return " ".join(f"w{'abcdefghij'[k % 10]}" for k in range(start, start + n)) + " "


def test_features_of_a_log(spark):
    first, block = words(130), "\n".join([words(20).strip(), words(20).strip()])
    log = [{"t": 0, "type": "insert", "pos": 0, "text": first}]
    at = len(first)
    log.append({"t": 50_000, "type": "insert", "pos": at, "text": "the end teh "})
    log.append({"t": 52_000, "type": "replace", "pos": at + 8, "length": 3, "text": "the"})
    log.append({"t": 60_000, "type": "delete", "pos": 0, "length": len(words(2))})
    at = at + 12 - len(words(2))
    log.append({"t": 3_000_000, "type": "paste", "pos": at, "text": "\n" + block + "\nmore here"})
    log.append({"t": 3_100_000, "type": "submit"})
    e = rp.replayed(rp.normalized(frame(spark, {"s": log}))[0])
    edits = {r.id: r.edit for r in pr.classified(e).collect()}
    assert edits == {0: None, 1: None, 2: "surface", 3: "substantive", 4: None, 5: None}
    r = pr.log_features(e).first()
    assert r.activeMinutes == 1 and r.sessions == 2 and r.pasteEvents == 1 and r.multiParagraphPastes == 1
    assert r.longestContinuous == 134 and r.largestInsertion == 134 and r.typingRate == 134 and 0 < r.pastedShare < 50
    assert abs(r.continuousShare + r.pastedShare - 100) < 1e-9 and r.firstDraftShare < 80
    kinds = [x.kind for x in pr.activity_segments(e).orderBy("segment").collect()]
    assert kinds == ["writing", "paste", "submitted"]
    assert [x.share for x in pr.growth(e).orderBy("at").collect()][-1] == 100


def test_internal_move(spark):
    text = "this sentence was written first and moved. "
    log = [{"t": 0, "type": "insert", "pos": 0, "text": text + "end"}, {"t": 1, "type": "delete", "pos": 0, "length": len(text)}, {"t": 2, "type": "paste", "pos": 3, "text": text}]
    rows = rp.replayed(rp.normalized(frame(spark, {"s": log}))[0]).orderBy("id").collect()
    assert [r.internal_move for r in rows] == [False, False, True]


def test_surface_changes(spark):
    pairs = [("", "", True), ("teh", "the", True), ("cat", "Cat", True), (",", ";", True), ("house", "garden", False), ("a b", "a c", False), ("recieve", "receive", False), ("recive", "receive", False), ("word", "words", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(pr.is_surface_change(F.col("a"), F.col("b"))).collect()]
    assert got[:6] == [p[2] for p in pairs[:6]] and got[8]


def test_report(spark):
    schema = "sample_id string, text string, metrics map<string,double>, pastes array<struct<chars:int,words:int,excerpt:string,include:boolean,found_words:int>>"
    df = spark.createDataFrame([("a", words(100), {"writingMinutes": 20.0, "sessions": 2.0}, [(None, 30, "x", True, 25), (60, None, "y", True, None), (None, 99, "z", False, None), (120, None, "q" * 700, None, None)]), ("b", "", {"pastedChars": 90.0, "pasteCount": 3.0}, None)], schema)
    a, b = pr.report_features(df).orderBy("sample_id").collect()
    assert (a.pastedShare, a.largestInsertion, a.pasteEvents, a.multiParagraphPastes, a.typingRate) == (45, 30, 2, 1, 55 / 20)
    assert (b.pastedShare, b.pasteEvents, b.retention) == (100, 3, None)


def test_log_of_texts_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    e = rp.replayed(rp.normalized(rp.log_of(docs))[0]).where("final_text is not null").selectExpr("cast(sample_id as long) doc_id", "final_text")
    assert e.join(docs, "doc_id").where("final_text = text").count() == docs.where("text != ''").count()
