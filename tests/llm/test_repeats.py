import hashlib
import random
from collections import Counter

import pytest

from quillspark.llm import repeats as rp


def brute(texts):
    """By counting all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = len([p for p in bytes(gone).split(b"\0") if p])
        yield len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def make(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choices("abcdé ghij\n", k=n))
    shared = [line(n) for n in (399, 400, 401, 700, 1500, 390)]
    texts = [line(rng.randrange(900)) for _ in range(30)]
    for _ in range(60):
        texts.append("".join(rng.choice([line(rng.randrange(300)), rng.choice(shared)]) for _ in range(rng.randrange(1, 7))))
    base = line(4000)
    for _ in range(40):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice(["", "X", line(30)]) + base[at + rng.randrange(3) :])
    texts += [base] * 3 + ["", None, "x" * 399, "x" * 400, "y" * 900, "ab" * 700, "", "short", "short", "z" * 300 + line(200) + "z" * 300]
    return texts


@pytest.mark.parametrize("most", [2_000, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(rp, "MOST_PIECES", most)
    removals = rp.removals
    monkeypatch.setattr(rp, "removals", lambda docs: removals(docs, most))
    texts = make(most)
    ids = [k if k % 17 else None for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_bytes int")
    got = Counter(r[:5] for r in rp.remove_repeats(docs).collect())
    assert got == Counter((i, *r) for i, r in zip(ids, brute(texts), strict=True))


def test_long_text_is_cut_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(rp, "CUT_AT_ONCE", 1000)
    texts = make(9)[30:120]
    got = [[] for _ in texts]
    for numbers, offsets, some in rp._stretches(rp.symbols([(t or "").encode() for t in texts], rp.UNITS[0])):
        t, x, n, *_ = rp.cut_up(some)
        for k, a, w in zip(t, x, n, strict=True):
            got[numbers[k]] += range(offsets[k] + a, offsets[k] + a + w)
    assert all(sorted(g) == list(range(max(0, len((t or "").encode()) - 399))) for g, t in zip(got, texts, strict=True))


def test_one_document_and_rows_in_full(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choices("abcdefgh", k=450)) for _ in range(2))
    rows = [(1, a + b + a[:420]), (2, b[:399]), (3, "w" * 10), (3, "w" * 10), (4, a[100:350] * 2), (5, b + "é")] + [(6, a[::-1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r[:5] for r in rp.remove_repeats(docs).collect()) == Counter((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows]), strict=True))
    assert rp.remove_repeats(docs.limit(0)).count() == 0


def test_stage(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("éabß ", k=300))
    rows = [(1, f"start {passage} end", "en", 9), (2, f"é{passage}é", "en", 9), (3, passage, "fr", 9), (4, None, "de", 0), (5, "clean text", "en", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = rp.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == "start  end" or got[1].text.replace(" ", "") == "startend"
    assert got[1].n_chars == len(got[1].text) and got[5].text == "clean text" and got[4].text is None


def test_whole_characters():
    raw = "aéb€c".encode()
    assert rp.whole_characters(raw, [(0, 2), (2, 3), (4, 6), (5, 8)]) == [(0, 1), (7, 8)]


def test_stage_removes_short_passages_of_over_50_words(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    line = lambda k, n=3: " ".join(word(n) for _ in range(k))
    over, under, wide, twice = line(51), line(50), line(60, 2), line(51, 1)
    texts = {1: f"{line(9)} {over} {line(9)}", 2: f"{line(5)}\n{over.replace(' ', chr(10))} {line(70)}", 3: f"{line(9)} {under} {line(9)}", 4: f"{line(9)} {under} {line(9)}", 5: f"é {wide} ß", 6: f"{line(3)} {wide}", 7: twice, 8: f"{line(2)} {twice} {line(2)}", 9: None}
    assert max(len(p) for p in (over, under, wide, twice)) < 400
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in rp.stage(spark, docs, "").collect()}
    words = {i: (t or "").split() for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + 51]) for w in words.values() for k in range(len(w) - 50))
    assert 7 not in got and set(got) == set(texts) - {7} and got[3] == texts[3] and got[4] == texts[4]
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        assert (got.get(i) or "").split() == [x for k, x in enumerate(w) if k not in gone]
    assert sum(len(t.split()) for t in got.values() if t) < sum(map(len, words.values())) - 300


@pytest.mark.parametrize("most", [2_000, 3])
def test_words_against_brute_force(spark, most):
    rng = random.Random(8)
    line = lambda k: [rng.choice("abcdefgh") for _ in range(k)]
    base, shared = line(300), [line(k) for k in (50, 51, 52, 120)]
    texts = [sum((rng.choice([line(rng.randrange(40)), rng.choice(shared)]) for _ in range(rng.randrange(6))), []) for _ in range(40)]
    texts += [base[: (at := rng.randrange(300))] + line(rng.randrange(3)) + base[at:] for _ in range(20)] + [["z"] * 60, base]
    seen = Counter(tuple(w[k : k + 51]) for w in texts for k in range(len(w) - 50))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    lost = {r.doc_id: rp.merged([s.asDict() for s in r.spans if s.words]) for r in rp.removals(docs, most, rp.UNITS[1:]).collect()}
    counted = {r.doc_id: r.n_repeated_words for r in rp.remove_repeats(docs).collect()}
    for i, w in enumerate(texts):
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        assert {k for a, b in lost.get(i, ()) for k in range(a, b)} == gone and counted[i] == len(gone)
