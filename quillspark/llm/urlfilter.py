"""URL filters: host and path rules first, then gradient-boosted trees on lexical features of the URL.

The trees learn from labelled URLs: here those on which a rule decides. Features are lengths, depth, digit and other
character ratios, entropy, parameter counts, and statistics of the host's suffixes (how often URLs under the same last
label, and last two labels, were to be blocked, smoothed, and how many there were).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .boosting import BoostedTrees

#: (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TRAIN_ROWS = 10_000  # labelled URLs of each verdict at most that the trees are fitted on, those with the smallest hashes
MOST_SUFFIXES = 100_000  # up to so many are handed to the workers at once, more are joined to the rows; results are the same
SALTS = 16
PRIOR = 5.0  # weight of the overall share in suffix statistics


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path."""
    shape = "(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    take = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(take(1), upper, upper.lower()), take(2)


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and ruling to url; the longest fitting rule wins (of equally long ones the first by text)."""
    host, path = parts(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = ruling = F.lit(None).cast("string")
    for verdict, h, p in reversed(order):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruling = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return urls.withColumns({"rule": rule, "ruling": ruling})


def suffixes(host: str) -> list[str]:
    labels = host.split(":")[0].split(".")
    return [".".join(labels[-n:]) for n in (1, 2)]


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Features that need nothing but the URL."""
    url = url or ""
    n, counts = max(1, len(url)), Counter(url)
    rest = url.partition("://")[2]
    query = rest.partition("#")[0].partition("?")[2]
    labels = host.split(".")
    names = [s for s in path.split("/") if s]
    share = lambda s, test: sum(map(test, s)) / max(1, len(s))
    return [
        len(url), len(host), len(path), len(query), len(names), len(labels), max(map(len, labels)), max(map(len, names), default=0),
        share(url, str.isdigit), share(host, str.isdigit), share(path, str.isdigit), share(url, str.isalpha),
        -sum(c / n * math.log2(c / n) for c in counts.values()), query.count("=") + query.count("&"), len(set(query.split("&"))) if query else 0,
        host.count("-"), url.count("%"), url.count("@"), "#" in url, url[:6].lower() == "https:", path.endswith("/"), "." in (names[-1] if names else ""), host.startswith("www."), ":" in host,
    ]


class UrlModel:
    """Trees and suffix statistics: those of MOST_SUFFIXES, or else of a batch's."""

    def __init__(self, trees: BoostedTrees, stats: dict[str, tuple[float, int]], share: float):
        self.trees, self.stats, self.share = trees, stats, share

    def features(self, url: str | None, host: str, path: str) -> list[float]:
        row = lexical(url, host, path)
        for s in suffixes(host):
            blocked, n = self.stats.get(s, (0.0, 0))
            row += [(blocked + PRIOR * self.share) / (n + PRIOR), math.log1p(n)]
        return row

    def probability(self, rows: list[tuple[str | None, str, str]]) -> np.ndarray:
        """Of each (url, host, path) to be blocked."""
        return self.trees.predict(np.array([self.features(*r) for r in rows], float)) if rows else np.zeros(0)


def fit(rows: list[tuple[str | None, str, str]], blocked: list[int], weights: list[float] | None = None, known: dict[str, list] | None = None) -> UrlModel:
    """Fits suffix statistics on one half of the labelled rows for the other and the trees on all; then statistics on all.
    Rows count in the trees and the share by their weights, 1 each by default. The statistics are known for halves by
    hash_order (number blocked and number of URLs of the even half, of the odd one), or counted on the rows."""
    y = np.array(blocked, float)
    share = float(np.average(y, weights=weights)) if len(y) else 0.5

    def stats(chosen) -> dict[str, tuple[float, int]]:
        found: dict[str, list] = {}
        for k in chosen:
            for s in set(suffixes(rows[k][1])):
                t = found.setdefault(s, [0.0, 0])
                t[0], t[1] = t[0] + y[k], t[1] + 1
        return {s: (b, n) for s, (b, n) in found.items()}

    halves = [range(0, len(rows), 2), range(1, len(rows), 2)]
    counts = [stats(h) for h in halves]
    if known is not None:
        halves = [[k for k, r in enumerate(rows) if hash_order(r[0]) % 2 == h] for h in (0, 1)]
        counts = [{s: (v[2 * h], v[2 * h + 1]) for s, v in known.items() if v[2 * h + 1]} for h in (0, 1)]
    x = [[]] * len(rows)
    for own, other in zip(halves, counts[::-1], strict=True):
        half = UrlModel(BoostedTrees(), {s: (2 * b, 2 * n) for s, (b, n) in other.items()}, share)
        for k in own:
            x[k] = half.features(*rows[k])
    return UrlModel(BoostedTrees().fit(np.array(x, float), y, weights), {s: tuple(sum(c.get(s, (0, 0))[j] for c in counts) for j in (0, 1)) for s in counts[0] | counts[1]}, share)


def suffix_columns() -> list[Column]:
    """suffixes() of the column host."""
    return [F.substring_index(F.substring_index("host", ":", 1), ".", -n) for n in (1, 2)]


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """suffix, and numbers of blocked and of all URLs in the even (b0, n0) and the odd half (b1, n1) of distinct ruled ones."""
    each = labelled.select(F.explode(F.array_distinct(F.array(*suffix_columns()))).alias("suffix"), (F.col("ruling") == "block").cast("long").alias("b"), (F.crc32(F.col("url").cast("binary")) % 2).alias("h"))
    sums = [F.sum(F.when(F.col("h") == h, v).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k, v in (("b", F.col("b")), ("n", F.lit(1)))]
    return each.groupBy("suffix").agg(*sums)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS, most_suffixes: int = MOST_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_probability (null where a rule decides).

    A null URL, or one without ://, has empty host and path, so no rule fits and the trees decide. Each row is judged,
    repeated ones alike; an empty table gives no row. Other columns are not read. Where no URL is ruled the probability is
    0.5; at 0.5 and above the verdict is block. Suffix statistics count all distinct ruled URLs; the trees are fitted on a
    sample.
    """
    judged = ruled(pages.selectExpr("cast(page_id as long) page_id", "url"), rules)
    labelled = judged.where("ruling is not null").select("url", "host", "path", "ruling").distinct()
    n = {r.ruling: r["count"] for r in labelled.groupBy("ruling").count().collect()}
    weight = {verdict: max(1.0, k / train_rows) for verdict, k in n.items()}  # URLs for each one taken
    taken: list = []
    for verdict in ("allow", "block"):
        taken += labelled.where(F.col("ruling") == verdict).orderBy(F.xxhash64("url"), "url").limit(train_rows).collect()
    taken.sort(key=lambda r: (hash_order(r.url), r.url))
    counted = common.written(suffix_counts(labelled), "suffixes")
    few = counted.count() <= most_suffixes
    wanted = counted
    if not few:
        own = sorted({s for r in taken for s in suffixes(r.host)})
        wanted = counted.join(F.broadcast(pages.sparkSession.createDataFrame([(s,) for s in own], "suffix string")), "suffix", "left_semi")
    known = {r.suffix: [r.b0, r.n0, r.b1, r.n1] for r in wanted.collect()}
    model = fit([(r.url, r.host, r.path) for r in taken], [int(r.ruling == "block") for r in taken], [weight[r.ruling] for r in taken], known)
    if not few:
        s1, s2 = suffix_columns()
        salted = counted.select("suffix", (F.col("b0") + F.col("b1")).alias("b"), (F.col("n0") + F.col("n1")).alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = judged.withColumns({"s1": s1, "s2": s2, "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
        for k in ("1", "2"):
            judged = judged.join(salted.select(F.col("suffix").alias(f"s{k}"), "salt", F.col("b").alias(f"b{k}"), F.col("n").alias(f"n{k}")), [f"s{k}", "salt"], "left")
        judged = judged.select("page_id", "url", "host", "path", "rule", "ruling", "s1", "b1", "n1", "s2", "b2", "n2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            open_ = pdf["ruling"].isna()
            if not few:
                model.stats = {s: (b, n) for k in ("1", "2") for s, b, n in zip(pdf[f"s{k}"], pdf[f"b{k}"], pdf[f"n{k}"], strict=True) if n == n and n is not None}
            p = pd.Series(np.nan, index=pdf.index)
            p[open_] = model.probability(list(pdf.loc[open_, ["url", "host", "path"]].itertuples(index=False, name=None)))
            pdf["verdict"] = pdf["ruling"].where(~open_, np.where(p >= 0.5, "block", "allow"))
            pdf["block_probability"] = p.astype(object).where(open_, None)
            yield pdf[["page_id", "host", "path", "rule", "verdict", "block_probability"]]

    return judged.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, block_probability double")


def hash_order(url: str) -> int:
    """An order in which both halves of the fit get all kinds of URLs."""
    import zlib

    return zlib.crc32(url.encode())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page's URL."""
    return filter_urls(common.table(spark, sf_dir, "pages"))
