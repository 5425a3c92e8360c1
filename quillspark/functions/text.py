"""Segmentation of a text into paragraphs, sentences, words and quotations, as columns.

documented() adds one column per structure, each computed once in a projection of its own; everything built on them is a
narrow expression, so a whole analysis of texts needs no shuffle.

Quotations are paired over the whole text, so sentences carry marks instead of their quotation marks: OPEN and CLOSE stand for
those of matched quotations (straight and curly ones), ASKED for a question mark within one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .patterns import count, has, java, matches, replaced, trimmed

OPEN, CLOSE, CURLY_OPEN, CURLY_CLOSE, ASKED, CUT = "\u0004", "\u0005", "\u0006", "\u0007", "\u000e", "\u0001"
CLOSERS = f"[.!?\"'”’)\\]{OPEN}{CLOSE}{CURLY_CLOSE}{ASKED}]"
#: The end of a sentence: a full stop that ends no abbreviation, or another mark, closing marks, then space or the end.
SENTENCE_END = f"((?:(?<!\\b(?i:{'|'.join(lx.ABBREVIATIONS)}))\\.|[!?{ASKED}]){CLOSERS}*+)(?=\\s|$)"
_STARTS_SENTENCE = r"(?<=[.!?]\s{1,2}|\n\s{0,2})|(?<![\s\S])"
VOCABULARY = f"((?:{_STARTS_SENTENCE}|(?![A-Z]))(?:{lx.WORD}))|{lx.WORD}"


def words(text: Column) -> Column:
    return matches(text, lx.WORD)


def count_words(text: Column) -> Column:
    return count(text, lx.WORD)


def paragraphs(text: Column) -> Column:
    """Lines without outer white space, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Pieces up to sentence ends, trimmed; pieces without a word are left out."""
    marked = F.regexp_replace(paragraph, java(SENTENCE_END), f"$1{CUT}")
    return F.filter(F.transform(F.split(marked, CUT), trimmed), lambda s: has(s, lx.WORD))


def syllables(word: Column) -> Column:
    """An estimate by groups of vowels."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(w, r"(?:[^laeiouy]es|ed|[^laeiouy]e)\z", ""), r"\Ay", "")
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}"))))


def stem(word: Column) -> Column:
    """The first suffix of the list that leaves four characters goes."""
    w = F.regexp_replace(F.regexp_replace(F.lower(word), "’", "'"), r"'s\z", "")
    out = w
    for s in reversed(lx.STEM_SUFFIXES):
        out = F.when((F.length(w) - len(s) >= 4) & w.endswith(s), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def lemma_in(word: Column, terms) -> Column:
    """Whether a word, or one of a few reductions of it, is in a list."""
    forms = [word, F.regexp_replace(word, r"ies\z", "y"), F.regexp_replace(word, r"(?:es|s|ed|ing|ly|al)\z", ""), F.regexp_replace(word, r"(?:ing|ed)\z", "e")]
    return forms[0].isin(*terms) | forms[1].isin(*terms) | forms[2].isin(*terms) | forms[3].isin(*terms)


def taught_terms(terms: Column) -> Column:
    """Words of more than two letters of the taught terms (null ones aside), and their stems."""
    found = F.filter(F.flatten(F.transform(F.array_compact(F.coalesce(terms, F.array().cast("array<string>"))), lambda t: F.split(F.lower(t), "[^a-zÀ-ɏ']+"))), lambda w: F.length(w) > 2)
    return F.array_distinct(F.concat(found, F.transform(found, stem)))


def space_parts(text: Column) -> Column:
    """Number of parts between white space."""
    return count(text, r"\s+") + 1


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*lx.STOP_CONTENT)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def _marked_quote(q: Column) -> Column:
    straight = F.substring(q, 1, 1) == '"'
    inner = F.translate(F.substring(q, F.lit(2), F.length(q) - 2), "?", ASKED)
    return F.when(straight, F.concat(F.lit(OPEN), inner, F.lit(CLOSE))).otherwise(F.concat(F.lit(CURLY_OPEN), inner, F.lit(CURLY_CLOSE)))


def unmarked(text: Column) -> Column:
    """A sentence as it stands in the text."""
    return F.translate(text, OPEN + CLOSE + CURLY_OPEN + CURLY_CLOSE + ASKED, '""“”?')


#: A whole quotation within a sentence.
QUOTED = f"[{OPEN}{CURLY_OPEN}][^{OPEN}{CLOSE}{CURLY_OPEN}{CURLY_CLOSE}]*[{CLOSE}{CURLY_CLOSE}]"


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row. Projections above may refer to them within lambdas: a generator of
    one row stands between, across which the optimizer doesn't copy expressions into each other, where a lambda would
    repeat them for every element."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


Levels = list[dict[str, Column]]


def made_once(make: Callable) -> Callable:
    """make() with its results kept for as long as the JVM is the same: large sets of columns take seconds to put together."""
    kept: dict = {}

    @wraps(make)
    def get(*args):
        jvm = SparkContext._jvm
        if args not in kept or kept[args][0] is not jvm:
            kept[args] = (jvm, make(*args))
        return kept[args][1]

    return get


_REFERRED = re.compile(r"(?<![A-Za-z0-9])_[a-z]+")


def names_in(columns: Iterable[Column]) -> set[str]:
    """The columns of structure (underscored names) that columns refer to; perhaps some more."""
    return {n for c in columns for n in _REFERRED.findall(repr(c))}


def pruned(levels: Levels, wanted: Iterable[str]) -> tuple[Levels, set[str]]:
    """Of levels, each made of the ones before, what the wanted columns need, and what those need from before the levels.
    The optimizer can't see through the generators that settle them."""
    needed, kept = set(wanted), []
    for level in reversed(levels):
        some = {k: c for k, c in level.items() if k in needed}
        needed = (needed - set(level)) | names_in(some.values())
        kept.append(some)
    return kept[::-1], needed


def built(df: DataFrame, levels: Levels) -> DataFrame:
    for level in levels:
        df = settled(df, level) if level else df
    return df


#: What documented() adds.
STRUCTURE = ("_t", "_words", "_n", "_gaps", "_quotes", "_paras", "_sents", "_taught", "_vocab")


def documented(df: DataFrame, text: str = "text", taught: str | None = None, only: Iterable[str] = STRUCTURE) -> DataFrame:
    """df with the structure of its texts (null: empty), or with those columns of it that are in only:

    _words (lower case), _n (their number), _gaps and _quotes (the text around and in quotations), _paras (marked),
    _sents (array of t marked text, p paragraph from 0, i place in it from 0, m sentences of it, w lower-case words),
    _taught, and _vocab (words outside quotations that are neither names nor taught).
    """
    return built(df, pruned(_structure(text, taught), only)[0]).drop("_nested", "_hollow")


@made_once
def _structure(text: str, taught: str | None) -> Levels:
    t = F.coalesce(F.col(text), F.lit(""))
    terms = taught_terms(F.col(taught)) if taught else F.array().cast("array<string>")
    pairs = F.zip_with("_gaps", "_quotes", lambda g, q: F.concat(F.coalesce(g, F.lit("")), F.coalesce(_marked_quote(q), F.lit(""))))
    hollow = F.zip_with("_gaps", "_quotes", lambda g, q: F.concat(F.coalesce(g, F.lit("")), F.when(q.isNotNull(), F.lit('""')).otherwise("")))
    nested = F.transform("_paras", lambda p, k: F.struct(k.alias("p"), sentences(p).alias("s")))
    flat = F.flatten(F.transform("_nested", lambda x: F.transform(x["s"], lambda s, k: F.struct(s.alias("t"), x["p"].alias("p"), k.alias("i"), F.size(x["s"]).alias("m"), F.transform(words(s), F.lower).alias("w")))))
    seen = F.filter(matches(F.col("_hollow"), VOCABULARY, 1), lambda w: w != "")
    vocab = F.filter(seen, lambda w: ~(F.array_contains("_taught", F.lower(w)) | F.array_contains("_taught", stem(w))))
    plain = F.when(F.size("_taught") == 0, seen).otherwise(vocab)
    return [
        {"_t": t, "_taught": terms, "_gaps": F.split(t, java(lx.QUOTE), -1), "_quotes": matches(t, lx.QUOTE), "_words": F.transform(words(t), F.lower)},
        {"_n": F.size("_words"), "_paras": paragraphs(F.array_join(pairs, "")), "_hollow": F.array_join(hollow, "")},
        {"_nested": nested},
        {"_sents": flat, "_vocab": plain},
    ]
