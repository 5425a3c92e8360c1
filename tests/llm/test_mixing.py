import random
import re
from collections import Counter, defaultdict

from quillspark.llm import mixing


def goals(size_of):
    """Targets by repeated sharing."""
    names = sorted([s for s in size_of if s is not None], key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = set(), sum(size_of.values())
    while True:
        left = total - sum(3 * size_of[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: 3 * size_of[s] if s in full else weight[s] * left / w for s in names}
        above = {s for s in names if t[s] > 3 * size_of[s] + 1e-9}
        if not above:
            return t
        full |= above


def brute(rows, found_order, blocks, counts):
    """Words taken of each document, word by word: rank r of a source takes block r modulo its blocks."""
    taken = Counter()
    for s, order in found_order.items():
        words = [k for k in order for _ in range(rows[k][2])]
        n, size = blocks[s], len(words)
        for r in range(counts[s]):
            b = r % n
            for x in range(b * size // n, (b + 1) * size // n):
                taken[words[x]] += 1
    return taken


def make(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["big"] * 8 + ["a", "é", "Z", "😀", "", None])
        rows.append((i, s, rng.choice([0, 1, 3, 40, 200])))
    rows += [(n, "tiny", 2), (n + 1, "tiny", 5), (n + 2, "none", 0), (None, "a", 9), (7, "a", 11), (n, "tiny", 2)]
    return rows


def test_against_brute_force(spark):
    rows = make(1)
    text = lambda n, i: " \t".join(f"w{i}" for _ in range(n)) if n else random.Random(i).choice(["", None, " \n"])
    docs = spark.createDataFrame([(i, text(n, i), s, 0, "x") for i, s, n in rows], "doc_id long, text string, source string, taken int, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size_of = defaultdict(int)
    for _, s, n in rows:
        size_of[s] += n
    t, total = goals(size_of), Counter()
    for r in got:
        assert r.source_size == size_of[r.source] and abs(r.target - t[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        total[r.source] += r.taken
    for s in size_of:
        assert abs(total[s] - t[s]) <= max(3, 0.02 * t[s]), (s, total[s], t[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    sized = mixing.sizes(docs)
    g = mixing.targets(sized)
    laid = mixing.laid_out(sized, g).orderBy("idx", "position").collect()
    sched = mixing.schedule(g).collect()
    order, names = defaultdict(list), {r.idx: (r.source, r.blocks) for r in g.collect()}
    rows2 = []
    for r in laid:
        order[r.source].append(len(rows2))
        rows2.append((r.doc_id, r.text_hash, r.size))
    counts = Counter(names[r.idx][0] for r in sched)
    assert sorted(r["rank"] for r in sched if names[r.idx][0] == "big") == list(range(counts["big"]))
    expected = brute(rows2, order, {s: b for s, b in names.values()}, counts)
    assert Counter((r.doc_id, r.text_hash, r.taken) for r in got) == Counter((i, h, expected[k]) for k, (i, h, _) in enumerate(rows2))


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 500, f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    slots = sorted((r.slot, r.idx) for r in mixing.schedule(mixing.targets(mixing.sizes(docs))).collect())
    for start in range(0, len(slots) - 120, 97):
        some = Counter(i for _, i in slots[start : start + 120])
        assert all(abs(some[k] - 120 * (k + 1) / 6) <= 4 for k in range(3))


def test_stage_takes_what_mix_says(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(n)), s, "en") for i, s, n in make(2, 120) if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += words(r.text)
    expected, shared = Counter(), Counter((i, t) for i, t, _, _ in rows)
    for r in mixing.mix(docs).collect():
        expected[r.doc_id] += r.taken
    alike = {i for (i, _), n in shared.items() if n > 1}
    assert all(taken[i] == expected[i] for i in expected if i not in alike) and all(abs(taken[i] - expected[i]) < 2 for i in alike)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.stage(spark, docs, "").count() == 0
    only = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(only).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
