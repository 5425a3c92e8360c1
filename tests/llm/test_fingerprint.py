import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import fingerprint as fp


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc .", min_size=1, max_size=30), max_size=12), st.randoms())
def test_order_insertion_and_deletion(lines, rng):
    text = "\n".join(lines)
    found = fp.paragraphs(text)
    mixed = found[:]
    rng.shuffle(mixed)
    (a,) = fp.fingerprints([text])
    b = np.zeros(1, fp.STATE)[0]
    for p in mixed:
        b = fp.inserted(b, p)
    assert a.tobytes() == b.tobytes()
    assert fp.inserted(fp.inserted(b, "more"), "more", -1).tobytes() == b.tobytes()
    assert fp.inserted(fp.inserted(b, "more"), "more").tobytes() == fp.inserted(b, "more", 2).tobytes() != b.tobytes()


def test_paragraphs_are_told_apart():
    a, b, c = fp.fingerprints(["A. B", "A.\nB", "B\n\nA."])
    assert a["wide"].tobytes() != b["wide"].tobytes() and b.tobytes() == c.tobytes()
    assert fp.likeness(np.array([a]), np.array([b]))[0] < 1 == fp.likeness(np.array([b]), np.array([c]))[0]


def test_likeness_estimates_shared_parts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    for share in (0, 0.25, 0.5, 0.9, 1):
        near = []
        for _ in range(20):
            a = [f"{word()} {word()}." for _ in range(40)]
            b = a[: int(40 * share)] + [f"{word()} {word()}." for _ in range(40 - int(40 * share))]
            x = fp.fingerprints(["\n".join(a), "\n".join(b)])
            near.append(fp.likeness(x[:1], x[1:])[0])
        assert abs(np.mean(near) - share) < 0.06


def plain(rows):
    rows = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: r[:2])
    for (_, t, i), (_, u, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        yield i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()


def check(spark, rows):
    got = fp.fingerprint_documents(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")).collect()
    key = lambda x: (x[0] is not None, x[0], x[1], x[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(plain(rows), key=key)
    return got


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", 7)
    rng = random.Random(7)
    rows = [(rng.randrange(-50, 200), "".join(rng.choices("ab é😀.\n", k=rng.randrange(60)))) for _ in range(120)]
    rows += [(None, "null id"), (None, None), (5, None), (5, ""), (5, "same"), (5, "same"), (999, "x" * 200_000)]
    got = check(spark, rows)
    same = {r.fingerprint for r in got if r.doc_id == 5 and r.n_chars == 4}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    check(spark, [(1, "alone. here")])
    check(spark, [])


def test_edited_is_nearer_than_next(spark):
    got = fp.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000
    assert sum(r.near_edited > r.near_next for r in got) > 900
