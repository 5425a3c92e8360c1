from collections import Counter

import numpy as np

from quillspark.llm import toxicity


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(3000):
        r = Counter({i: int(rng.integers(1, 6)) for i in range(5) if rng.random() < 0.5})
        s = 2 * np.log1p(r.get(0, 0)) + 1 * np.log1p(r.get(1, 0)) - 1.5 * np.log1p(r.get(2, 0)) + rng.logistic()
        rows.append(r)
        grades.append(int(np.searchsorted([0.5, 2.0, 3.5], s)))
    w, cuts = toxicity.fit_ordinal(rows, grades, 5, 4, ridge=1e-5)
    assert np.allclose(w[:3], [2, 1, -1.5], atol=0.35) and np.allclose(w[3:], 0, atol=0.3)
    assert np.allclose(cuts, [0.5, 2.0, 3.5], atol=0.45) and (np.diff(cuts) > 0).all()


def test_stems_and_severity():
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(plain, 60), *(f"zork{rng.choice(plain)[:3]}," for _ in range(bad))])
    texts = [text(0) for _ in range(400)] + [text(1 + k % 12) for k in range(400)]
    m = toxicity.fit(texts, [0] * 400 + [1] * 400)
    assert max(m.above(text(0))[0] for _ in range(50)) < 0.5 < min(m.above(text(1))[0] for _ in range(50))
    assert m.above(text(12)).sum() > m.above(text(5)).sum() > m.above(text(1)).sum() > m.above("").sum()


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.grade_toxicity(docs, labels.where("doc_id % 2 = 0")).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("doc_id % 2 = 1").select("toxic", "label").collect()
    caught = [r.toxic for r in got if r.label == 1]
    wrong = [r.toxic for r in got if r.label == 0]
    assert len(caught) > 100 and sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.005


def test_rows(spark):
    texts = ["a b", None, "", "awful " * 50_000, "a b"]
    docs = spark.createDataFrame([(i if i else None, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(3, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.grade_toxicity(docs, labels).collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4] and got[0].p_toxic == got[4].p_toxic and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.grade_toxicity(docs.limit(0), labels).count() == 0
    assert all(r.toxic == 0 for r in toxicity.grade_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_capped_sample_keeps_class_ratio():
    # "zork" is in all toxic and in one clean text of eight: with 20 clean to a toxic one, most texts with it are clean
    rng = np.random.default_rng(6)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(6))
    clean, bad = [text() + " zork" * (k % 8 == 0) for k in range(2000)], [text() + " zork" for _ in range(100)]
    p = lambda n, w: toxicity.fit(clean[:n] + bad, [0] * n + [1] * 100, [0] * n + [1] * 100, w).above("zork")[0]
    whole, sample, capped = p(2000, None), p(104, None), p(104, [2000 / 104] * 104 + [1.0] * 100)
    assert whole < 0.5 and abs(capped - whole) < 0.06 and sample > 0.7
