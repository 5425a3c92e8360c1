import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import neardup as nd
from quillspark.llm.graph import components, extended


def doc(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def change(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(1)
    for edits, repeat in ((0, 1), (4, 1), (15, 1), (3, 7), (40, 3)):
        base = doc(rng, 120)
        other = change(rng, base, edits) + (" " + " ".join(base.split()[:30])) * (repeat - 1)
        true = nd.similarity(nd.multiset(base), nd.multiset(other))
        h = nd.signatures(2, *nd.shingles([base.encode(), other.encode()]), size=4096)
        assert abs((h[0] == h[1]).mean() - true) < 0.035, (edits, repeat)


def test_signature_against_plain_minimum_over_unit_weights():
    """With weights in steps of one, equal components are as likely as for single elements (shingle, copy number)."""
    value = np.arange(1, 41, dtype=np.uint64) * np.uint64(1234567891011)
    wa, wb = np.tile([1, 2, 5, 9, 3], 8), np.tile([1, 3, 4, 16, 1], 8)
    h = nd.signatures(2, np.repeat([0, 1], 40), np.concatenate([value, value]), np.concatenate([wa, wb]), size=8192)
    assert abs((h[0] == h[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.02


def test_shingles_are_exact_multisets():
    rng = random.Random(3)
    texts = [doc(rng, n, 3) for n in (0, 1, 4, 5, 6, 200)] + [" a\tb\n\nc  d\x0be \r", "", "é ß\x1fx y"]
    text, value, times = nd.shingles([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert sorted(times[text == k]) == sorted(nd.multiset(t).values())
    assert len({(v) for v in value}) == len({s for t in texts for s in nd.multiset(t)})


def brute(rows):
    texts = {}
    for i, t in rows:
        if (t or "").encode().split():
            texts.setdefault(t, []).append(i)
    keys = list(texts)
    sets, parent = [nd.multiset(t) for t in keys], list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if nd.similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    ids = {}
    for k, t in enumerate(keys):
        ids.setdefault(find(k), []).extend(i for i in texts[t] if i is not None)
    of = {t: min(ids[find(k)], default=None) for k, t in enumerate(keys)}
    return Counter((i, of[t] if (t or "").encode().split() else i) for i, t in rows)


def family(rng):
    """A star of copies far from each other, a chain, exact copies, and texts near the threshold."""
    base, rows = doc(rng, 100), []
    rows += [base] + [change(rng, base, 2) for _ in range(25)]
    step = doc(rng, 90)
    for _ in range(12):
        step = change(rng, step, 1)
        rows.append(step)
    rows += [doc(rng, 50)] * 4 + [doc(rng, n) for n in (1, 2, 4, 5, 9)] * 2
    near = doc(rng, 100)
    return rows + [near] + [change(rng, near, n) for n in range(1, 8)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [t for _ in range(6) for t in family(rng)] + ["", None, " \n", "", "one", "one", "a " * 3000, "a " * 2999]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (None, "only without id"), (ids[3], texts[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    assert Counter((r.doc_id, r.class_id) for r in nd.classes(docs).collect()) == brute(rows)
    kept = nd.stage(spark, docs, "")
    assert kept.columns == docs.columns
    expected = Counter(i for i, c in brute(rows) if i == c)
    empty = {i for i, t in rows if not (t or "").split()}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id not in empty) == Counter({i: 1 for i in expected if i not in empty})


@pytest.mark.parametrize("probes", [0, 1])
def test_blocks_find_what_probes_leave(spark, monkeypatch, probes):
    monkeypatch.setattr(nd, "PROBES", probes)
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "STREAM", 8)
    rng = random.Random(6)
    texts = [t for _ in range(3) for t in family(rng)]
    drift = doc(rng, 150)
    for _ in range(60):  # copies of copies: near their neighbours, far from the ends
        drift = change(rng, drift, rng.randrange(3))
        texts.append(drift)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in nd.classes(docs).collect()) == brute(list(enumerate(texts)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(docs).count() == 0 and nd.stage(spark, docs, "").count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(nd.common, "FEW_NARROW", few)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("few", [100_000, 10])
def test_extended_as_all_at_once(spark, monkeypatch, few):
    """Stars, chains, ties of known nodes, nodes that are new, and links that say nothing new."""
    monkeypatch.setattr(nd.common, "FEW_NARROW", few)
    rng = random.Random(3)
    first = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(8)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    for more in ([], [(5, 9)], [(59, 104), (205, 300), (300, 301), (400, 401), (7, 3), (250, 251)] + [(0, 500 + k) for k in range(20)]):
        some = lambda rows: spark.createDataFrame(rows, "a long, b long")
        got = {r.node: r.label for r in extended(components(some(first)), some(more)).collect()}
        assert got == {r.node: r.label for r in components(some(first + more)).collect()}
