"""The features worked out in batches against those worked out as columns."""

import math
import random

from quillspark.essays import PASSAGES
from quillspark.functions import text as tx
from quillspark.operators import batch, discourse, style
from quillspark.operators.features import DISCOURSE, STYLE
from quillspark.plans import analysis

NAMES = [f.id for f in (*STYLE, *DISCOURSE)]
ODD = [
    None, "", " \n\t ", "Yes", "1954? 12 (3)!", "i dont know; thats alot", 'He said: "is it? Yes." (p. 4) and "no" then “a world of fear?” she writes "x y z".',
    "Dr. Smith e.g. met Mrs.. Brown etc.) and St. Ives. pp. 3. Vol. 2. Then left.\x01Cut here. And.", "Épower power's hegemonyé _power power_x İdea İdeas.  Ideas are\nBig.   The SOCIETY﻿",
    "On the other hand , society. However,although thus— - --(not 3)(see it) :5 :x", "The power is shown. " * 60 + "\n" + "The power is shown. " * 3, "this shows\u0085that. This means nothing, walking ing, and so. Walking slowly, he ran.",
    "😀 Smile 😀. \"😀 a b\" he said.\n\nIt shows 😀 that society is order. First, it is.\nFinally order.", "a" * 300 + " " + "b. " * 80,
]


def texts() -> list:
    r = random.Random(5)
    bits = [x for p in PASSAGES for x in p.replace("\n", " \n ").split(" ")] + ["\n", '"', "“", "”", ".", "?", ",", "(3)", "Mr.", "1960s", "’s", "’", "　", "ß", "Ǆ"]
    return [*ODD, *PASSAGES, "\n".join(PASSAGES), *(r.choice(["", " "]).join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(5, 400))) for _ in range(40))]


def test_as_columns(spark):
    rows = [(k, t, ["Power of Society", None] if k % 3 == 0 else None) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, text string, taught array<string>")
    docs = style.style_features(tx.documented(df, "text", "taught"))
    docs = style.vocabulary_details(discourse.discourse_features(discourse.moves(docs)))
    columns = ["id", "word_count", "sentences", *NAMES, "_stems", "_verbs"]
    theirs = {r.id: r for r in docs.selectExpr("*", "_n as word_count", "size(_sents) as sentences").select(*columns).collect()}
    ours = {r.id: r for r in batch.all_features(df, "text", "taught").select(*columns).collect()}
    assert ours.keys() == theirs.keys()
    for k, a in ours.items():
        for c in columns:
            x, y = (set(v) if c == "_stems" else v for v in (a[c], theirs[k][c]))
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12), (k, c, x, y)


def test_forgetting_and_words_of_patterns():
    assert batch.needed(batch.python(r"\b(?:written in|19\d\d|cold war)\b", False)) == {"written", "#", "cold"} and not batch.needed(batch.python(r"[a-z]{4}"))
    whole, kept = batch.Engine(batch.lx.Lexicon()), batch.KEPT
    try:
        expected = [whole.features(t, None) for t in texts()]
        batch.KEPT = (10, 2)
        small = batch.Engine(batch.lx.Lexicon())
        assert [small.features(t, None) for t in texts()] == expected
    finally:
        batch.KEPT = kept


def test_analysis_works_out_features_in_batches(spark):
    """A lambda for each word took most of an analysis's time."""
    plan = analysis.featured(spark.createDataFrame([("a", "x")], "sample_id string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


def test_texts_of_a_batch_as_one_by_one():
    """Together with other texts, in quotations over several sentences, over the ends of paragraphs, with marks of our own in a text."""
    more = ["See for\nexample. As a\n \nresult it is.", 'He said "Go. Then Come. Be" and Left. "A. Big" Bee.', "\x04 Peter\x06 is. The\x05 End", "On the other\nhand, İalso aİ.\n   Yes. p. Xenon! no", "Furthermore, it is. While we wait here, it is ultimately so? Moreover, yes"]
    every = [*texts(), *more]
    terms = [["Power of Society", None] if k % 3 == 0 else None for k in range(len(every))]
    one, many = batch.Engine(batch.lx.Lexicon()), batch.Engine(batch.lx.Lexicon())
    assert many.all_features(every, terms) == [one.features(t, k) for t, k in zip(every, terms)]
    got = dict(zip(NAMES, one.features(more[0], None)[2]))
    assert got["transitionRate"] == 2 / 8 * 100
    assert dict(zip(NAMES, one.features(more[4], None)[2]))["surface_genericTransitions"] == 2 / 13 * 1000


def test_gates_know_whole_words_and_lemmas():
    """What a pattern needs as a word let every word that holds it through; a lemma took three substitutions for each word."""
    assert batch.pieces(batch.python(r"\b(?:is|been)\s+\w+ed\b", False)) == {("is", True), ("been", True)}
    assert batch.pieces(batch.python(r"\bideolog\w*", False)) == {("ideolog", False)}
    gates = batch.Gates({"a": batch.python(r"\b(?:is|been)\s", False), "b": batch.python(r"\bpart\w*", False)})
    assert gates.of_words(["this", "is", "been's", "éis", "parting", "apart", "o"]) == {"is": 1, "been's": 1, "éis": 1, "parting": 2, "apart": 2}
    known = batch.forms(frozenset(["make", "city", "go"]))
    assert {"make", "making", "maked", "city", "cities", "go", "goes", "gos", "goly"} <= known and "makes" not in known


def test_words_only_and_what_is_read_again(spark):
    """New vocabulary and verbs took all features; each table of an analysis worked the comparisons out anew."""
    df = spark.createDataFrame([(str(k), "w", "current" if k == 5 else "baseline", str(k), t) for k, t in enumerate([*PASSAGES[1:6], PASSAGES[7], None])], "sample_id string, writer_id string, role string, ts string, text string")
    whole, part = analysis.featured(df), analysis.worded(df, ("_verbs", "_stems"))
    columns = ["sample_id", "word_count", "_stems", "_verbs"]
    assert sorted(map(repr, part.select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect())) and "mattr" not in part.columns
    table = analysis.featured(df, extras=())
    result, few = analysis.analyze(table), analysis.analyze(table, only=["clauseDensity", "meanSentenceLength"])
    assert result.new_vocabulary is None and result.verbs is None and "Window" not in result.rows._jdf.queryExecution().optimizedPlan().toString()
    said = lambda r: sorted(map(repr, r.composites.where("composite = 'sentenceComplexity'").collect()))
    assert said(result) == said(few) and len(said(few)) == 1
