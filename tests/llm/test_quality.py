import zlib

from quillspark.llm import quality

GOOD = ["The river turned slowly past the old mill %d and the people watched it go by in the evening light." % i for i in range(300)]
BAD = ["BUY!! NOW!! %d CHEAP!! PILLS!! ### $$$ CLICK!! HERE!! %%%%%% WIN!! WIN!! WIN!!" % i for i in range(300)]


def test_separates_and_is_calibrated():
    m = quality.fit(GOOD[:200] + BAD[:200] + [None, ""], [1] * 200 + [0] * 200 + [1, 1])
    s = [m.score(t.encode()) for t in GOOD[200:] + BAD[200:]]
    assert min(s[:100]) > 0.9 and max(s[100:]) < 0.1
    assert 0 <= m.score(b"") <= 1


def test_one_class_and_none():
    assert quality.fit(["a"], [1]).score(b"x") > 0.5 and quality.fit([], []).score(b"x") == 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 1000
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    good, bad = ([r.score for r in got if r.quality == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.98


def test_rows(spark):
    texts = [GOOD[0], None, "", BAD[0], GOOD[0], "x" * 300_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (None, 1), (0, 1), (5, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 6 and got[0].score == got[4].score and got[1].score == got[2].score
    for i, r in enumerate(got):
        assert r.held_out == (i != 3 and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_capped_sample_keeps_class_ratio(spark):
    # one text of either class in eight is like the other's: the odds of a text are by the classes' shares
    rows = [(i, BAD[i % 300] + f" {i}" if i % 8 == 0 else GOOD[i % 300] + f" {i}", 1) for i in range(1600)]
    rows += [(i, GOOD[i % 300] + f" {i}" if i % 8 == 0 else BAD[i % 300] + f" {i}", 0) for i in range(1600, 1800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    taken = quality.common.labelled(docs, labels, "quality", 100)
    assert sum(w for _, y, w in taken if y == 1) == 1600 and sum(w for _, y, w in taken if y == 0) == 200
    assert {w for _, _, w in quality.common.labelled(docs, labels, "quality", 1600)} == {1.0}
    few = quality.common.labelled(docs, labels, "quality", 1600, most_bytes=5_000)
    for k, n in ((1, 1600), (0, 200)):
        assert 0 < sum(len(t) for t, y, _ in few if y == k) <= 5_000 and abs(sum(w for _, y, w in few if y == k) - n) < 1e-6
    mean = [sum(r.score for r in quality.score_quality(docs, labels, n).collect()) / 1800 for n in (140, 2000)]
    assert abs(mean[1] - 1600 / 1800) < 0.02 and abs(mean[0] - mean[1]) < 0.04


def test_bound_of_dictionary():
    texts = [t.encode() for t in GOOD]
    assert quality.TRAIN_PIECES == 12_800 and quality.dictionary(texts) == quality.dictionary(texts, len(texts)) != quality.dictionary(texts, 20)
