import re

import pytest

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx
from quillspark.functions.patterns import java
from pyspark.sql import functions as F

TEXT = 'Mr. Kay said "Why? I went." to us etc. and left! Really?! (Yes.) It is i.e. fine.\n\n  She’s "here." Then Bob, no.\nétude naïve ok. “A quote?” it\u00a0ends. No. 5 is St. Ives… end'


def one(spark, text, taught=None):
    df = spark.createDataFrame([(text, taught)], "text string, terms array<string>")
    return tx.documented(df, taught="terms").first()


def plain_sentences(p):
    abbr = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|St|vs|etc|e\.g|i\.e|p|pp|ch|Vol|No)\.$", re.I | re.A)
    word = re.compile("[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)*")
    out, start, i = [], 0, 0
    while i < len(p):
        if p[i] in ".!?":
            j = i + 1
            while j < len(p) and p[j] in ".!?\"'”’)]":
                j += 1
            if (j == len(p) or p[j].isspace()) and not (p[i] == "." and abbr.search(p[max(0, i - 5) : i + 1])):
                out.append(p[start:j].strip())
                start, i = j, j - 1
        i += 1
    out.append(p[start:].strip())
    return [s for s in out if word.search(s)]


def test_sentences_as_scanned_by_hand(spark):
    r = one(spark, TEXT)
    paras = [p.strip() for p in TEXT.split("\n") if p.strip()]
    restore = lambda s: s.translate(str.maketrans(tx.OPEN + tx.CLOSE + tx.CURLY_OPEN + tx.CURLY_CLOSE + tx.ASKED, '""“”?'))
    assert [restore(p) for p in r._paras] == paras
    assert [(restore(s.t), s.p) for s in r._sents] == [(s, k) for k, p in enumerate(paras) for s in plain_sentences(p)]
    assert all(s.m == sum(x.p == s.p for x in r._sents) for s in r._sents)


def test_words_and_quotes(spark):
    r = one(spark, TEXT)
    assert r._words == [w.lower() for w in re.findall("[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)*", TEXT)] and r._n == len(r._words)
    assert r._quotes == ['"Why? I went."', '"here."', "“A quote?”"]


def test_vocabulary_leaves_out_quotes_names_and_taught(spark):
    r = one(spark, 'The symbol grew. Ralph met I and Bob. "Big words" again.\nSymbols rule', ["symbol of power"])
    assert r._vocab == ["The", "grew", "Ralph", "met", "and", "again", "rule"]


@pytest.mark.parametrize("word, n", [("", 0), ("the", 1), ("symbolized", 3), ("yes", 1), ("table", 2), ("rhythm", 1), ("beautiful", 4), ("created", 1), ("Étude", 1)])
def test_syllables(spark, word, n):
    assert spark.range(1).select(tx.syllables(F.lit(word))).first()[0] == n


@pytest.mark.parametrize("a, b", [("symbolizes", "symboliz"), ("symbolized", "symboliz"), ("nation", "nation"), ("realities", "real"), ("Bob’s", "bob"), ("running", "runn"), ("cats", "cats"), ("stories", "stor")])
def test_stem(spark, a, b):
    assert spark.range(1).select(tx.stem(F.lit(a))).first()[0] == b


def test_patterns_have_ascii_boundaries_and_wide_space(spark):
    f = lambda s, p: spark.range(1).select(F.lit(s).rlike(java(p))).first()[0]
    assert f("onè", r"\bon\b") and f("a\u00a0b", r"a\sb") and not f("a\n", r"a$") and f("x]y", r"[\]]")


def test_long_lists_cover_the_alphabet():
    for words in (lx.EVERYDAY, lx.ACADEMIC):
        assert words == sorted(words) and len(words) == len(set(words)) > 200
        assert {w[0] for w in words} >= set("abcdefghilmnoprstuvwy")
