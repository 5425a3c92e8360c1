"""The 49 features of style, each a column over the structure that functions.text.documented adds.

A text without words has no values. Rates are per words of the text; sentence features are means over its sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.patterns import count, has, java
from ..functions.text import Levels, built, documented, lemma_in, made_once, names_in, pruned, settled, space_parts, stem, syllables
from .features import STYLE

WINDOW = 50


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.try_divide(_sum(a), F.size(a)))


def sd(a: Column, centre: Column) -> Column:
    """Sample standard deviation by two passes, given the mean's column; 0 below two values."""
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre))
    return F.when(F.size(a) < 2, 0.0).otherwise(F.sqrt(F.try_divide(squares, F.size(a) - 1)))


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    middle = F.floor(n / 2).cast("int")
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(s, middle).cast("double")).otherwise((F.get(s, middle - 1) + F.get(s, middle)) / 2)


def per(n: Column, of: Column, unit: float) -> Column:
    return F.when(of == 0, 0.0).otherwise(F.try_divide(n.cast("double"), of) * unit)


def counted(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def _markers(s: Column) -> Column:
    """Clause markers of a sentence: subordinators, relatives, coordinations and participles after commas."""
    w = s["w"]
    sub = counted(w, lambda x, k: x.isin(*lx.SUBORDINATORS) & ~((x == "as") & (F.coalesce(F.get(w, k + 1), F.lit("")) == "well")))
    rel = counted(w, lambda x, k: x.isin(*lx.RELATIVES) & (k > 0) & ~((x == "that") & F.coalesce(F.get(w, k + 1), F.lit("")).isin(*lx.DETERMINERS)))
    return F.struct(sub.alias("sub"), rel.alias("rel"), count(s["t"], r",\s+(?:and|but|or|so|yet)\s", case=False).alias("coord"), count(s["t"], r",\s+\w+ing\b").alias("ing"))


def _mattr(w: Column, sorted_: Column, n: Column) -> Column:
    """Mean share of distinct words in windows of 50. A word is distinct in a window where it comes first, that is in those
    that begin after its last occurrence before; sorted by word and place, that one is the neighbour. No window is built."""

    def firsts(e, j):
        before = F.get(sorted_, j - 1)
        last = F.when((j > 0) & (before["x"] == e["x"]), before["k"]).otherwise(-1)
        return F.greatest(F.lit(0), F.least(e["k"], n - WINDOW) - F.greatest(F.lit(0), e["k"] - (WINDOW - 1), last + 1) + 1)

    whole = F.try_divide(F.size(F.array_distinct(w)).cast("double"), n)
    return F.when(n <= WINDOW, whole).otherwise(_sum(F.transform(sorted_, firsts)) / (WINDOW * (n - WINDOW + 1)))


def _repeated(s: Column) -> Column:
    """Number of values of a sorted array that occur more than once."""
    return counted(s, lambda x, k: (x == F.get(s, k - 1)) & F.coalesce(x != F.get(s, k - 2), F.lit(True)))


def _phrase(p: str) -> str:
    """A whole phrase, its first word first, so that Java searches for that."""
    head, *rest = p.split(" ")
    return head + f"(?<![A-Za-z0-9_]{head})" + java("".join(rf"\s+{r}" for r in rest)) + "(?![A-Za-z0-9_])"


def _steps() -> Column:
    """Texts around quotations and quotations in turn."""
    return F.flatten(F.zip_with("_gaps", "_quotes", lambda g, q: F.array(F.coalesce(g, F.lit("")), F.coalesce(q, F.lit("")))))


def _quotes() -> Column:
    """Of each quotation of two parts at least: whether a reporting verb or colon leads to it, whether it continues a sentence."""
    steps = F.col("_steps")

    def around(q, k):
        # 40 characters before: quotations have three at least, so 30 steps back suffice
        first = F.greatest(F.lit(1), 2 * k + 1 - 29)
        before = F.array_join(F.slice(steps, first, 2 * k + 1 - first + 1), "")
        before = F.when(F.length(before) > 40, F.substring(before, F.length(before) - 39, F.lit(40))).otherwise(before)
        says = has(before, lx.REPORTING, case=False) | has(before, r":\s*$")
        return F.struct(q.alias("q"), says.alias("says"), (has(before, r"[a-z,]\s*$") & ~says).alias("woven"))

    return F.filter(F.transform("_quotes", around), lambda x: space_parts(x["q"]) >= 2)


@made_once
def _columns(lexicon: lx.Lexicon) -> dict[str, Column]:
    t, w, n, sents, vocab, paras = F.col("_t"), F.col("_words"), F.col("_n"), F.col("_sents"), F.col("_vocab"), F.col("_paras")
    n_s, lengths, marks, quotes = F.size("_sents"), F.col("_lengths"), F.col("_marks"), F.col("_quoting")
    listed = lambda terms: counted(w, lambda x: x.isin(*terms))
    share = lambda test: per(counted(sents, test), n_s, 100)
    of_vocab = lambda test: per(counted(vocab, test), F.size(vocab), 100)
    after = F.slice(paras, 2, F.greatest(F.lit(0), F.size(paras) - 1))
    basic, advanced = listed(lx.BASIC_VERBS), listed(lx.ADVANCED_VERBS)
    transitions = sum((F.regexp_count("_low", F.lit(_phrase(p))) for p in lx.TRANSITIONS), F.lit(0))
    opener = java("^(?:" + "|".join(lx.TRANSITIONS) + ")[ ,]")
    first = lambda s: F.coalesce(F.get(s["w"], 0), F.lit(""))
    comma_early = lambda s: F.array_join(F.slice(F.split(s["t"], java(r"\s+")), 1, 14), " ").contains(",")
    outside = F.flatten(F.transform("_gaps", lambda g: F.regexp_extract_all(g, F.lit(lx.WORD), F.lit(0))))
    slips = counted(outside, lambda x: (x == "i") | F.lower(x).isin(*lx.MISSPELLINGS)) + counted(sents, lambda s: has(s["t"], "^[a-z]"))
    out = {
        "meanSentenceLength": mean(lengths),
        "medianSentenceLength": median(lengths),
        "sentenceLengthSD": sd(lengths, F.col("_centre")),
        "clauseDensity": mean(F.transform(marks, lambda m: 1 + m["sub"] + m["rel"] + m["coord"])),
        "subordinateRate": mean(F.transform(marks, lambda m: m["sub"] + m["rel"])),
        "coordinationRate": mean(F.transform(marks, lambda m: m["coord"])),
        "fragmentRate": per(counted(lengths, lambda x: x <= 4), n_s, 100),
        "rhetoricalQuestionRate": share(lambda s: has(s["t"], r"\?\s*$")),
        "openerVariety": per(F.size(F.array_distinct(F.transform(sents, first))), n_s, 100),
        "patternRepetition": per(n_s - F.size(F.array_distinct(F.transform(sents, lambda s: F.array_join(F.slice(s["w"], 1, 2), " ")))), n_s, 100),
        "mattr": _mattr(w, F.col("_placed"), n),
        "ttr300": F.try_divide(F.size(F.array_distinct(F.slice(w, 1, 300))).cast("double"), F.least(n, F.lit(300))),
        "rareWordRate": of_vocab(lambda x: (F.length(x) >= 7) & ~lemma_in(F.lower(x), lexicon.everyday)),
        "academicRate": of_vocab(lambda x: lemma_in(F.lower(x), lexicon.academic)),
        "longWordRate": of_vocab(lambda x: syllables(x) >= 3),
        "abstractNounRate": per(count(t, lx.ABSTRACT, case=False), n, 100),
        "modifierDensity": per(counted(w, lambda x: (x.endswith("ly") & (F.length(x) > 4) & ~x.isin(*lx.LY_NOT_ADVERBS)) | x.rlike(r"(?:ous|ive|ful|less|able|ible|ical)\z")), n, 100),
        "advancedVerbShare": F.when(basic + advanced >= 2, per(advanced, basic + advanced, 100)),
        "hedgingRate": per(listed(lx.HEDGES), n, 1000),
        "intensifierRate": per(listed(lx.INTENSIFIERS), n, 1000),
        "modalRate": per(listed(lx.MODALS), n, 100),
        "transitionRate": per(transitions, n, 100),
        "repeatedPhraseRate": per(_repeated(F.col("_trigrams")), n, 1000),
        "embedding": mean(F.transform(marks, lambda m: m["sub"] + m["rel"] + m["ing"])),
        "passiveRate": share(lambda s: has(s["t"], lx.PASSIVE, case=False)),
        "nominalizationRate": per(count(t, lx.NOMINAL, case=False), n, 100),
        "prepDensity": per(listed(lx.PREPOSITIONS), n, 100),
        "introClauseRate": share(lambda s: (first(s).isin(*lx.SUBORDINATORS, *lx.PREPOSITIONS) | first(s).rlike(r"(?:ing|ed)\z")) & comma_early(s)),
        "participialRate": per(counted(sents, lambda s: has(s["t"], r",\s+[a-z]+ing\b") | has(s["t"], r"^[A-Z][a-z]+(?:ing|ed)\b[^.]*,")), n_s, 10),
        "semicolonRate": per(count(t, ";"), n, 1000),
        "colonRate": per(count(t, r":(?!\d)"), n, 1000),
        "dashRate": per(count(t, "—|–| - |--"), n, 1000),
        "parentheticalRate": per(count(t, r"\((?!\s*(?:p\.?\s*)?\d)[^)]{3,}\)"), n, 1000),
        "firstPersonRate": per(listed(lx.FIRST_PERSON), n, 100),
        "quoteIntroSays": F.when(F.size(quotes) >= 2, per(counted(quotes, lambda q: q["says"]), F.size(quotes), 100)),
        "quoteIntegrated": F.when(F.size(quotes) >= 2, per(counted(quotes, lambda q: q["woven"]), F.size(quotes), 100)),
        "paragraphOpenerTransition": F.when(F.size(after) >= 2, per(counted(after, lambda p: F.lower(p).rlike(opener)), F.size(after), 100)),
        "certaintyRate": per(listed(lx.BOOSTERS), n, 1000),
        "evaluativeRate": per(listed(lx.EVALUATIVE), n, 1000),
        "qualificationRate": share(lambda s: has(s["t"], lx.QUALIFIED, case=False)),
        "mechanicsRate": per(slips, n, 1000),
        "contractionRate": per(count(t, lx.CONTRACTION, case=False), n, 100),
        "surface_uniformity": F.when(F.size(lengths) >= 5, sd(lengths, F.col("_centre")) / F.greatest(F.lit(1.0), mean(lengths))),
    }
    for name, pattern, case in lx.SURFACE:
        out[f"surface_{name}"] = per(count(t, pattern, case), n, 1000)
    return {f.id: F.when(n > 0, out[f.id].cast("double")) for f in STYLE}


@made_once
def _levels() -> Levels:
    """What features need beside the structure: what lambdas refer to has a column of its own, as within a lambda it would be
    worked out for every element."""
    sents, w, n = F.col("_sents"), F.col("_words"), F.col("_n")
    three = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))
    trigrams = F.when(n >= 3, F.array_sort(three)).otherwise(F.array().cast("array<string>"))
    return [
        {"_lengths": F.transform(sents, lambda s: F.size(s["w"])), "_marks": F.transform(sents, _markers), "_steps": _steps(), "_low": F.lower("_t"), "_placed": F.array_sort(F.transform(w, lambda x, k: F.struct(x.alias("x"), k.alias("k")))), "_trigrams": trigrams},
        {"_quoting": _quotes(), "_centre": mean(F.col("_lengths"))},
    ]


def _chosen(only: list[str] | None, lexicon: lx.Lexicon | None) -> tuple[dict[str, Column], Levels, set[str]]:
    """The columns of features, the levels that they need, and what those need of the structure."""
    columns = _columns(lexicon or lx.Lexicon())
    columns = {k: columns[k] for k in only or columns}
    return columns, *pruned(_levels(), names_in(columns.values()))


def style_features(docs: DataFrame, only: list[str] | None = None, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """docs, on which documented() was called, with a column for each feature (or for those in only)."""
    columns, levels, _ = _chosen(only, lexicon)
    return built(docs, levels).withColumns(columns).drop(*[k for level in levels for k in level])


def vocabulary_details(docs: DataFrame, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """docs with _stems (of all words), _rare (map of the stems of sophisticated words to their last form) and _verbs (map of
    analytical verbs to counts)."""
    lexicon = lexicon or lx.Lexicon()
    known = lambda x: (F.length(x) >= 8) & ~lemma_in(F.lower(x), lexicon.everyday)
    strong = lambda x: lemma_in(F.lower(x), lexicon.academic) | (syllables(x) >= 3) | F.lower(x).isin(*lx.ADVANCED_VERBS)
    rare = F.filter("_vocab", lambda x: known(x) & strong(x))
    pairs = F.transform(rare, lambda x: F.struct(stem(x).alias("k"), F.lower(x).alias("v")))
    docs = settled(docs, {"_stems": F.array_distinct(F.transform("_words", stem)), "_pairs": pairs, "_verb": F.filter("_words", lambda x: x.isin(*lx.BASIC_VERBS, *lx.ADVANCED_VERBS))})
    last = F.filter("_pairs", lambda x, k: ~F.exists(F.slice("_pairs", k + 2, F.size("_pairs")), lambda y: y["k"] == x["k"]))
    verbs = F.transform(F.array_distinct("_verb"), lambda v: F.struct(v.alias("k"), counted(F.col("_verb"), lambda x: x == v).alias("v")))
    return docs.withColumns({"_rare": F.map_from_entries(last), "_verbs": F.map_from_entries(verbs)}).drop("_pairs", "_verb")


def of_texts(df: DataFrame, text: str = "text", taught: str | None = None, only: list[str] | None = None, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """df with the features of its texts, and _n, their words; only what these need is worked out."""
    needed = _chosen(only, lexicon)[2] | {"_n"}
    return style_features(documented(df, text, taught, needed), only, lexicon)
