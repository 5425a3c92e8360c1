import random

from quillspark.operators import replay as rp
from quillspark.streaming import live

from .test_process import random_log


def rows_of(logs):
    return [(s, k, e["t"], e["type"], e["pos"], e["length"], e["text"]) for s, log in logs.items() for k, e in enumerate(log)]


def stream(spark, tmp_path, rows, files=3):
    folder = str(tmp_path / "in")
    rows = sorted(rows, key=lambda r: r[2])
    size = len(rows) // files + 1
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], live.EVENT).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(live.EVENT).option("maxFilesPerTrigger", 1).json(folder)


def test_stream_replay_as_batch(spark, tmp_path):
    rng = random.Random(2)
    logs = {f"s{k}": random_log(rng, 40)[0] for k in range(6)}
    events = stream(spark, tmp_path, rows_of(logs))
    q = live.live_replay(events).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.sample_id: r.final_text for r in spark.sql("select sample_id, max_by(final_text, events) final_text from live group by 1").collect()}
    batch = spark.createDataFrame(rows_of(logs), live.EVENT)
    expected = {r.sample_id: r.final_text for r in rp.replayed(rp.normalized(batch)[0]).where("final_text is not null").collect()}
    assert got == expected and spark.sql("select sum(late) from live").first()[0] == 0


def test_sessions_in_batch_and_stream(spark, tmp_path):
    minute = 60_000
    rows = [("a", k, t * minute, "insert", 0, None, "two words") for k, t in enumerate((0, 10, 40, 71, 72))] + [("b", 0, 5 * minute, "focus", None, None, None), ("b", 1, 6 * minute, "insert", 0, None, "x")]
    batch = live.sessions(spark.createDataFrame(rows, live.EVENT)).orderBy("sample_id", "start").collect()
    assert [(r.sample_id, r.events, r.typed_words) for r in batch] == [("a", 3, 6), ("a", 2, 4), ("b", 1, 1)]  # 30 minutes exactly stay together
    far = [("z", 0, 10**9, "insert", 0, None, "x")]
    events = stream(spark, tmp_path, rows + far, files=2)
    q = live.sessions(events).writeStream.outputMode("append").format("memory").queryName("sittings").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.sample_id, r.events) for r in spark.sql("select * from sittings where sample_id != 'z'").collect()} == {("a", 3), ("a", 2), ("b", 1)}


def test_minutes_and_late(spark):
    df = spark.createDataFrame([("a", 0, 0, "insert", 0, None, "one two"), ("a", 1, 30_000, "insert", 0, None, "three")], live.EVENT)
    assert max(r.words for r in live.minute_insertions(df).collect()) == 3
    assert [r.source for r in live.late_events(df, spark.createDataFrame([("a", 20_000)], "sample_id string, t_max long")).collect()] == [0]


def test_keystrokes_merge(spark):
    log = [("a", k, k * 100, "insert", k, None, c) for k, c in enumerate("hello")]
    log += [("a", 5, 600, "delete", 4, 1, None), ("a", 6, 700, "delete", 3, 1, None), ("a", 7, 9000, "insert", 3, None, "p"), ("a", 8, 9100, "paste", 4, None, "!!")]
    out = live.merged_keystrokes(spark.createDataFrame(log, live.EVENT)).orderBy("t", "source").collect()
    assert [(r.type, r.pos, r.length, r.text) for r in out] == [("insert", 0, None, "hello"), ("delete", 3, 2, None), ("insert", 3, None, "p"), ("paste", 4, None, "!!")]
    long = [("b", k, k * 10, "insert", k, None, "x") for k in range(130)]
    parts = live.merged_keystrokes(spark.createDataFrame(long, live.EVENT)).orderBy("pos").collect()
    assert [len(r.text) for r in parts] == [60, 60, 10] and [r.pos for r in parts] == [0, 60, 120]
    chunks = [("c", k, k * 10, "insert", 40 * k, None, "y" * 40) for k in range(5)] + [("c", 9, 60, "delete", 199, 1, None)]
    parts = live.merged_keystrokes(spark.createDataFrame(chunks, live.EVENT)).orderBy("t", "source").collect()
    assert [(r.type, r.pos, len(r.text or ""), r.length) for r in parts] == [("insert", 0, 80, None), ("insert", 80, 80, None), ("insert", 160, 40, None), ("delete", 199, 0, 1)]
