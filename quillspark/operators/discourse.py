"""What sentences do: rhetorical moves, levels of abstraction, chains of reasoning, and the 20 features made of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.patterns import count, has
from ..functions.text import QUOTED, Levels, built, content_words, documented, jaccard, made_once, names_in, pruned, space_parts, unmarked
from .features import DISCOURSE
from .style import counted, mean

# Short names of moves, and the order in which steps of a chain are told.
CODES = {
    "thesis": "T", "claim": "C", "context": "Ctx", "evidence": "E", "explanation": "X", "reasoning": "R",
    "qualification": "Q", "counterpoint": "Cp", "implication": "I", "summary": "S", "conclusion": "Cn",
}
STEPS = ["interpretation", "technique", "context", "qualification", "implication"]
TECHNIQUE = "|".join(p for k, p in lx.EVIDENCE_TYPES.items() if k != "context")
SAME_CLAIM = 0.45


def _cue(t: Column, name: str) -> Column:
    return has(t, lx.CUES[name], case=name == "evidenceLead")


def _quotes(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0))


def _observed(s: Column) -> Column:
    """What is seen in a sentence by itself."""
    t, out = s["t"], {}
    for name in ("counterpoint", "qualification", "implication", "context", "explanation", "reasoning", "thesis", "analytic", "citation"):
        out[name] = _cue(t, name)
    out["long_quote"] = F.exists(_quotes(t), lambda q: space_parts(q) >= 3)
    out["quote"] = F.exists(_quotes(t), lambda q: space_parts(q) >= 2)
    out["lead"] = _cue(t, "evidenceLead")
    out["opens"] = has(t, lx.OPENS_BY_INTERPRETING) & _cue(F.substring(t, 1, 60), "explanation")
    out["names"] = has(F.substring(t, F.lit(2), F.length(t)), r"\s[A-Z][a-z]+")
    out["technique"] = has(t, TECHNIQUE, case=False)
    out["abstract"], out["nominal"] = count(t, lx.ABSTRACT, case=False), count(t, lx.NOMINAL, case=False)
    return F.struct(s["t"].alias("t"), s["p"].alias("p"), s["i"].alias("i"), s["m"].alias("m"), *[c.alias(k) for k, c in out.items()])


def _tagged(s: Column) -> Column:
    """The tags of a sentence in their order."""
    proof = s["long_quote"] | s["citation"] | s["lead"]
    tags = [("counterpoint", s["counterpoint"]), ("evidence", proof), ("explanation", s["opens"]), ("qualification", s["qualification"]), ("implication", s["implication"]), ("context", s["context"]), ("explanation", s["explanation"]), ("reasoning", s["reasoning"])]
    return s.withField("tags", F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tags]))))


def _moved(s: Column) -> Column:
    """The primary move, by place and tags, and the level of abstraction."""
    paras, tags = F.size("_paras"), s["tags"]
    tagged = lambda k: F.array_contains(tags, k)
    intro = F.when(s["thesis"] | (s["i"] == s["m"] - 1), "thesis").otherwise("context")
    outro = F.when(s["i"] == 0, "conclusion").when(tagged("implication"), "implication").when(tagged("qualification"), "qualification").otherwise("conclusion")
    untagged = F.when(s["names"] & ~s["analytic"], "summary").otherwise("explanation")
    body = F.when((s["i"] == 0) & ~tagged("evidence"), "claim").otherwise(F.coalesce(F.get(tags, 0), untagged))
    move = F.when((paras >= 3) & (s["p"] == 0), intro).when((paras >= 3) & (s["p"] == paras - 1), outro).otherwise(body)
    level = F.when((s["abstract"] >= 2) | ((s["abstract"] >= 1) & (s["nominal"] >= 2)), 2).when(s["analytic"] | s["technique"], 1).otherwise(0)
    kept = [s[k].alias(k) for k in ("t", "p", "i", "tags", "technique", "quote", "citation")]
    return F.struct(move.alias("move"), level.alias("level"), *kept)


def _chain(s: Column, k: Column) -> Column:
    """The distinct steps that follow a piece of evidence in its paragraph, up to the next evidence or claim."""
    after = F.slice("_moves", k + 2, F.size("_moves"))
    stop = F.array_position(F.transform(after, lambda n: (n["p"] != s["p"]) | n["move"].isin("evidence", "claim")), True)
    run = F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after)
    does = lambda n, x: (n["move"] == x) | F.array_contains(n["tags"], x)
    tests = {
        "interpretation": lambda n: does(n, "explanation") | does(n, "reasoning") | (n["move"] == "summary"),
        "technique": lambda n: n["technique"],
        "context": lambda n: does(n, "context"),
        "qualification": lambda n: does(n, "qualification") | does(n, "counterpoint"),
        "implication": lambda n: does(n, "implication") | (n["level"] == 2),
    }
    found = [F.when(F.exists(run, tests[x]) | (s["technique"] if x == "technique" else F.lit(False)), F.lit(x)) for x in STEPS]
    return F.array_compact(F.array(*found))


@made_once
def _move_levels() -> Levels:
    paras = F.size("_paras")
    role = lambda p: F.when((paras >= 3) & (p == 0), "introduction").when((paras >= 3) & (p == paras - 1), "conclusion").otherwise("body")
    run = lambda m: F.filter(m, lambda x, k: (k == 0) | (x != F.coalesce(F.get(m, k - 1), F.lit(""))))
    flow = F.transform("_byp", lambda m, p: F.struct(p.alias("index"), role(p).alias("role"), run(m).alias("sequence"), F.size(F.array_distinct(m)).alias("distinct")))
    marked = F.transform("_moves", lambda s, k: F.when(s["move"] == "evidence", _chain(s, k)))
    return [
        {"_moves": F.transform("_sents", _observed)},
        {"_moves": F.transform("_moves", _tagged)},
        {"_moves": F.transform("_moves", _moved)},
        {"_byp": F.transform("_paras", lambda _, p: F.transform(F.filter("_moves", lambda s: s["p"] == p), lambda s: s["move"]))},
        {"_flow": flow, "_chains": F.filter(marked, lambda c: c.isNotNull())},
    ]


MADE = ("_moves", "_flow", "_chains")


def moves(docs: DataFrame, only: Iterable[str] = MADE) -> DataFrame:
    """docs, on which documented() was called, with _moves (array of move, level, t, p, i, tags, technique, quote, citation),
    _flow (per paragraph its role, run of moves and number of distinct ones) and _chains (steps after each evidence)."""
    return built(docs, pruned(_move_levels(), only)[0]).drop("_byp")


def moved(df: DataFrame, only: Iterable[str] = MADE) -> DataFrame:
    """df with those of the columns of moves() that are in only, of its column text."""
    return moves(documented(df, only=pruned(_move_levels(), only)[1]), only)


def _same(x: Column, others: Column, k: Column) -> Column:
    return F.exists(F.transform(others, lambda o, j: (j != k) & (jaccard(x, o) >= SAME_CLAIM)), lambda b: b)


@made_once
def _columns() -> dict[str, Column]:
    s, n, flow, chains = F.col("_moves"), F.size("_moves"), F.col("_flow"), F.col("_chains")
    number = lambda *m: counted(s, lambda x: x["move"].isin(*m)).cast("double")
    does = lambda x, m: (x["move"] == m) | F.array_contains(x["tags"], m)
    six = lambda c: F.when(n >= 6, c)
    paras = F.greatest(F.lit(1), F.size(flow))
    body = F.filter(flow, lambda p: p["role"] == "body")
    shaped = F.when(F.size(body) >= 2, body).otherwise(flow)
    share = lambda test: F.when(n > 0, F.try_divide(counted(s, test) * 100.0, n))
    claims, evidence = number("claim", "thesis"), number("evidence")
    analysis = F.filter(s, lambda x: x["move"].isin("explanation", "reasoning", "implication", "qualification"))
    proofs = F.filter(s, lambda x: does(x, "evidence"))
    quotes = F.filter(F.transform("_quotes", space_parts), lambda k: k >= 2)
    part = lambda a, test, least: F.when(F.size(a) >= least, F.try_divide(counted(a, test) * 100.0, F.size(a)))
    matched = lambda p: F.exists(s, lambda x: has(x["t"], p, case=False)).cast("int")
    kinds = sum(map(matched, lx.EVIDENCE_TYPES.values()), F.lit(0))
    repeated = counted(F.col("_claims"), lambda c, k: (jaccard(c, F.col("_thesis")) >= SAME_CLAIM) | _same(c, F.col("_claims"), k))
    return {
        "movesPerParagraph": F.when((F.size(flow) > 0) & (n >= 6), mean(F.transform(shaped, lambda p: p["distinct"]))),
        "chainLength": F.when((F.size(flow) > 0) & (n >= 6), mean(F.transform(shaped, lambda p: F.size(p["sequence"])))),
        "evidencePerClaim": F.when(claims >= 2, F.try_divide(evidence, claims)),
        "explanationPerEvidence": F.when(evidence >= 3, F.try_divide(number("explanation", "reasoning"), evidence)),
        "qualificationPerParagraph": six(counted(s, lambda x: does(x, "qualification")) / paras),
        "counterPerParagraph": six(number("counterpoint") / paras),
        "implicationPerParagraph": six(counted(s, lambda x: does(x, "implication")) / paras),
        "summaryShare": six(F.try_divide(number("summary") * 100, n)),
        "claimRepetition": F.when(F.size("_claims") >= 3, F.try_divide(repeated * 100.0, F.size("_claims"))),
        "abstractionIndex": F.when(n > 0, mean(F.transform(s, lambda x: x["level"]))),
        "abstractShare": share(lambda x: x["level"] == 2),
        "concreteShare": share(lambda x: x["level"] == 0),
        "reasoningDepth": F.when(F.size(chains) >= 2, mean(F.transform(chains, F.size))),
        "techniqueNaming": part(analysis, lambda x: x["technique"], 4),
        "thematicLeapRate": part(chains, lambda c: F.array_contains(c, "implication"), 3),
        "quotesPer100": F.when(F.col("_n") > 0, F.try_divide(F.size(quotes) * 100.0, F.col("_n"))),
        "meanQuoteLength": F.when(F.size(quotes) >= 2, mean(quotes)),
        "paraphraseShare": part(proofs, lambda x: ~x["quote"], 3),
        "evidenceSpecificity": part(proofs, lambda x: x["quote"] | x["citation"] | x["t"].rlike("[0-9]"), 3),
        "evidenceTypeDiversity": kinds,
    }


def _chosen(only: list[str] | None) -> tuple[dict[str, Column], Levels, set[str]]:
    """The columns of features, the levels that they need, and what those need of moves and structure."""
    thesis = F.get(F.filter("_moves", lambda x: x["move"] == "thesis"), 0)["t"]
    claims = F.transform(F.filter("_moves", lambda x: x["move"] == "claim"), lambda x: content_words(x["t"]))
    columns = _columns()
    columns = {f.id: columns[f.id].cast("double") for f in DISCOURSE if only is None or f.id in only}
    return columns, *pruned([{"_claims": claims, "_thesis": content_words(F.coalesce(thesis, F.lit("")))}], names_in(columns.values()))


def discourse_features(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """docs, on which moves() was called, with a column for each feature (or for those in only)."""
    columns, levels, _ = _chosen(only)
    return built(docs, levels).withColumns(columns).drop("_claims", "_thesis")


def pattern(sequence: Column) -> Column:
    """A paragraph's run of moves as short names."""
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.array_join(F.transform(sequence, lambda m: code[m]), " → ")


def typical_chain(chains: Column) -> Column:
    """The most frequent chain of reasoning in words, of equally frequent ones the first."""
    told = F.transform(chains, lambda c: F.array_join(F.concat(F.array(F.lit("observation")), c), " → "))
    ranked = F.transform(F.array_distinct(told), lambda d, k: F.struct((-counted(told, lambda x: x == d)).alias("n"), k.alias("k"), d.alias("d")))
    return F.get(F.array_sort(ranked), 0)["d"]


def conclusion_strategy(flow: Column) -> Column:
    last = F.try_element_at(flow, F.lit(-1))
    return F.when(last["role"] == "conclusion", F.when(F.array_contains(last["sequence"], "implication"), "extends to wider implications").otherwise("restates the argument"))


def sentence_table(docs: DataFrame, *ids: str) -> DataFrame:
    """A row per sentence: place, text, move, all moves and level."""
    rows = docs.select(*ids, F.posexplode("_moves").alias("n", "s"))
    return rows.select(*ids, "n", F.col("s.p").alias("paragraph"), unmarked(F.col("s.t")).alias("sentence"), F.col("s.move").alias("move"), F.array_distinct(F.concat(F.array("s.move"), "s.tags")).alias("moves"), F.col("s.level").alias("level"), F.col("s.technique").alias("technique"))


def of_texts(df: DataFrame, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """df with the discourse features of its texts; only what these need is worked out."""
    needed = _chosen(only)[2]
    structure = pruned(_move_levels(), needed)[1]
    return discourse_features(moves(documented(df, text, only=structure), needed), only)
