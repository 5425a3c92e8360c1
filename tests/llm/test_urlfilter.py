import random

import numpy as np

from quillspark.llm import urlfilter
from quillspark.llm.boosting import BoostedTrees


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_rules_against_plain_python(spark):
    urls = [None, "", "no scheme.org/", "http://a.ORG", "http://a.ORG/", "https://example.org/es/x", "https://x.example.org/en/12?a=1", "http://notexample.org/es/1", "http://b.com/fr/", "http://b.com/de/?x#y", "http://b.com?x=/de/", "http://c.net/a://b.org/", "a\nb://É.org/\nx", "http://org/x", "https://example.org/en/2", "http://example.org#/es/", "://com/de/1"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, "http://a.ORG", "h", "r"), (None, "http://b.com/de/", None, None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    assert len(got) == len(rows)
    for r, (i, u, _, _) in zip(got, rows, strict=True):
        host, path, rule, verdict = plain(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.block_probability is None) == (rule is not None)


def test_trees_learn_from_lexical_features():
    rng = random.Random(3)
    rows, y = [], []
    for _ in range(4000):
        bad = rng.random() < 0.4
        host = ("".join(rng.choices("abc0123456789", k=18)) if bad else "".join(rng.choices("abcdefgh", k=8))) + rng.choice([".net", ".info" if bad else ".edu"])
        path = "/" + "/".join("".join(rng.choices("xyz19", k=4)) for _ in range(rng.randint(1, 5)))
        rows.append((f"http://{host}{path}" + "?a=1&b=2&c=3" * (bad and rng.random() < 0.7), host, path))
        y.append(int(bad))
    model = urlfilter.fit(rows[:3000], y[:3000])
    assert np.mean((model.probability(rows[3000:]) >= 0.5) == np.array(y[3000:])) > 0.97


def test_trees_alone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    m = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert BoostedTrees().fit(np.zeros((0, 3)), []).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (BoostedTrees().fit(np.zeros((9, 3)), [1] * 9).predict(np.zeros((1, 3))) > 0.9).all()


def test_empty_table(spark):
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_large_table_has_all_rows(spark):
    assert urlfilter.query(spark, "/root/testdata/sf0.01").count() == 250


def test_capped_sample_keeps_class_ratio(spark):
    # URLs without a rule look like either kind, so their probability is the share of blocked ones, a tenth
    urls = [f"http://s{i * 7919 % 10007}.x.com/{'de' if i % 10 == 0 else 'fr'}/x" for i in range(2000)]
    urls += [f"http://s{i * 7919 % 10007}.x.com/yz/x" for i in range(2000, 2200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mean = [np.mean([r.block_probability for r in urlfilter.filter_urls(pages, train_rows=n).where("rule is null").collect()]) for n in (150, 10_000)]
    assert abs(mean[1] - 0.1) < 0.05 and abs(mean[0] - mean[1]) < 0.08


def test_suffix_statistics_count_all_ruled_urls(spark):
    urls = [f"http://s{i}.d{i % 40}.com/{'de' if i % 40 < 15 else 'fr'}/{i}" for i in range(1200)] + [f"http://t{i}.d{i % 40}.com/yz/{i}" for i in range(200)]
    labelled = urlfilter.ruled(spark.createDataFrame([(u,) for u in urls], "url string"), urlfilter.RULES).where("ruling is not null")
    got = {r.suffix: (r.b0 + r.b1, r.n0 + r.n1) for r in urlfilter.suffix_counts(labelled).collect()}
    assert got["com"] == (450, 1200) and got["d3.com"] == (30, 30) and got["d30.com"] == (0, 30) and len(got) == 41
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = [{r.page_id: (r.verdict, r.block_probability) for r in urlfilter.filter_urls(pages, train_rows=100, most_suffixes=m).collect()} for m in (100_000, 0)]
    assert out[0] == out[1] and len(out[0]) == 1400
    # a domain's URLs get its statistics, whether or not the sample has it
    assert sum((out[0][1200 + i][0] == "block") == (i % 40 < 15) for i in range(200)) > 190
