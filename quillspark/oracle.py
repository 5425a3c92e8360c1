"""DuckDB SQL for the queries of the catalogue, written independently of the columns: sentences and words are rows or lists.

RE2 has ASCII word boundaries, as the patterns mean them; it has no look-around, so what needs that is counted by difference.
"""

from __future__ import annotations

from . import essays
from .functions import lexicon as lx
from .functions.patterns import re2
from .operators.discourse import TECHNIQUE

W = re2(lx.WORD)
LEX = lx.Lexicon()
_SP = "' ' || chr(9) || chr(13)"

BASE = f"""
t as (select doc_id, source, lang, {essays.sql()} as t from documents),
w as (select doc_id, source, lang, t, list_transform(regexp_extract_all(t, '{W}'), lambda x: lower(x)) as w from t),
b as (select *, len(w) as n from w),
p as (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {_SP})), lambda x: x <> '') as ps from t),
pe as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as k, len(ps) as np from p),
sl as (select doc_id, k, np, list_filter(list_transform(string_split(regexp_replace(regexp_replace(p, '(?i)\\b({"|".join(lx.ABBREVIATIONS)})\\.', '\\1' || chr(2), 'g'),
  '([.!?][.!?"''”’)\\]]*)(\\s|\\z)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'), {_SP})), lambda x: regexp_matches(x, '{W}')) as ss from pe),
s as (select doc_id, k, np, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as i, len(ss) as m from sl),
sw as (select *, list_transform(regexp_extract_all(s, '{W}'), lambda x: lower(x)) as v from s),
sg as (select *, len(v) as l from sw)
"""


def listed(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def n_in(terms, w: str = "w") -> str:
    return f"len(list_filter({w}, lambda x: list_contains({listed(terms)}, x)))"


def n_re(pattern: str, case: bool = True, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, '{re2(pattern, case)}'))"


def has(pattern: str, case: bool = True, t: str = "s") -> str:
    return f"regexp_matches({t}, '{re2(pattern, case)}')"


def per(n: str, unit: int) -> str:
    return f"({n}) * {unit}.0 / n"


_SUB = f"(len(list_filter(list_transform(range(1, l + 1), lambda j: list_contains({listed(lx.SUBORDINATORS)}, v[j]) and not (v[j] = 'as' and coalesce(v[j + 1], '') = 'well')), lambda y: y)))"
_REL = f"(len(list_filter(list_transform(range(2, l + 1), lambda j: list_contains({listed(lx.RELATIVES)}, v[j]) and not (v[j] = 'that' and list_contains({listed(lx.DETERMINERS)}, coalesce(v[j + 1], '')))), lambda y: y)))"
_COORD = n_re(r",\s+(?:and|but|or|so|yet)\s", False, "s")
_QUOTES = f"regexp_extract_all(t, '{re2(lx.QUOTE)}')"
_HOLLOW = f"regexp_replace(t, '{re2(lx.QUOTE)}', '\"\"', 'g')"
_VOCAB = f"list_transform(list_filter(regexp_extract_all(chr(10) || {_HOLLOW}, '(?:[.!?]\\s{{1,2}}|\\n\\s{{0,2}})(?:{W})|(?:{W})'), lambda x: not regexp_matches(x, '^[A-Z]')), lambda x: regexp_extract(x, '{W}'))"


def lemma(x: str, terms) -> str:
    li = listed(terms)
    forms = [x, f"regexp_replace({x}, 'ies\\z', 'y')", f"regexp_replace({x}, '(?:es|s|ed|ing|ly|al)\\z', '')", f"regexp_replace({x}, '(?:ing|ed)\\z', 'e')"]
    return "(" + " or ".join(f"list_contains({li}, {f})" for f in forms) + ")"


def syllables(x: str) -> str:
    a = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    core = f"regexp_replace(regexp_replace({a}, '(?:[^laeiouy]es|ed|[^laeiouy]e)\\z', ''), '^y', '')"
    return f"(case when {a} = '' then 0 when length({a}) <= 3 then 1 else greatest(1, len(regexp_extract_all({core}, '[aeiouy]{{1,2}}'))) end)"


def of_vocab(test: str) -> str:
    return f"(case when len(v) = 0 then 0.0 else len(list_filter(v, lambda x: {test})) * 100.0 / len(v) end)"


_LY = f"((ends_with(x, 'ly') and length(x) > 4 and not list_contains({listed(lx.LY_NOT_ADVERBS)}, x)) or regexp_matches(x, '(?:ous|ive|ful|less|able|ible|ical)\\z'))"
_TRI = "list_transform(range(1, greatest(n - 1, 1)), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])"
#: Over b: t, w (lower-case words), n.
TEXT = {
    "mattr": "case when n <= 50 then len(list_distinct(w)) * 1.0 / n else cast(list_sum(list_transform(range(1, n - 48), lambda j: len(list_distinct(w[j:j + 49])))) as double) / (50 * (n - 49)) end",
    "ttr300": "len(list_distinct(w[1:300])) * 1.0 / least(n, 300)",
    "abstractNounRate": per(n_re(lx.ABSTRACT, False), 100), "modifierDensity": per(f"len(list_filter(w, lambda x: {_LY}))", 100),
    "advancedVerbShare": f"case when {n_in(lx.BASIC_VERBS)} + {n_in(lx.ADVANCED_VERBS)} >= 2 then {n_in(lx.ADVANCED_VERBS)} * 100.0 / ({n_in(lx.BASIC_VERBS)} + {n_in(lx.ADVANCED_VERBS)}) end",
    "hedgingRate": per(n_in(lx.HEDGES), 1000), "intensifierRate": per(n_in(lx.INTENSIFIERS), 1000), "modalRate": per(n_in(lx.MODALS), 100),
    "transitionRate": per(" + ".join(n_re(rf"\b{p.replace(' ', chr(92) + 's+')}\b", True, "lower(t)") for p in lx.TRANSITIONS), 100),
    "nominalizationRate": per(n_re(lx.NOMINAL, False), 100), "prepDensity": per(n_in(lx.PREPOSITIONS), 100), "semicolonRate": per(n_re(";"), 1000),
    "colonRate": per(f"{n_re(':')} - {n_re(':[0-9]')}", 1000), "dashRate": per(n_re("—|–| - |--"), 1000),
    "parentheticalRate": per("len(list_filter(regexp_extract_all(t, '\\([^)]{3,}\\)'), lambda x: not regexp_matches(x, '^\\(\\s*(?:p\\.?\\s*)?[0-9]')))", 1000),
    "firstPersonRate": per(n_in(lx.FIRST_PERSON), 100), "certaintyRate": per(n_in(lx.BOOSTERS), 1000), "evaluativeRate": per(n_in(lx.EVALUATIVE), 1000), "contractionRate": per(n_re(lx.CONTRACTION, False), 100),
} | {f"surface_{k}": per(n_re(p, c), 1000) for k, p, c in lx.SURFACE}
#: Over b with v, the vocabulary tokens.
VOCAB = {
    "rareWordRate": of_vocab(f"length(x) >= 7 and not {lemma('lower(x)', LEX.everyday)}"), "academicRate": of_vocab(lemma("lower(x)", LEX.academic)), "longWordRate": of_vocab(f"{syllables('x')} >= 3"),
}
_SHARE = lambda test: f"avg(case when {test} then 100.0 else 0.0 end)"
#: Aggregates over the sentences of a text.
SENTENCE = {
    "meanSentenceLength": "avg(l)", "medianSentenceLength": "median(l)", "sentenceLengthSD": "coalesce(stddev_samp(l), 0)", "clauseDensity": f"avg(1 + {_SUB} + {_REL} + {_COORD})",
    "subordinateRate": f"avg({_SUB} + {_REL})", "coordinationRate": f"avg({_COORD})", "fragmentRate": _SHARE("l <= 4"), "openerVariety": "count(distinct v[1]) * 100.0 / count(*)",
    "patternRepetition": "(count(*) - count(distinct array_to_string(v[1:2], ' '))) * 100.0 / count(*)", "embedding": f"avg({_SUB} + {_REL} + {n_re(r',' + chr(92) + 's+' + chr(92) + 'w+ing' + chr(92) + 'b', True, 's')})",
    "passiveRate": _SHARE(has(lx.PASSIVE, False)), "qualificationRate": _SHARE(has(lx.QUALIFIED, False)),
    "introClauseRate": _SHARE(f"(list_contains({listed(lx.SUBORDINATORS + lx.PREPOSITIONS)}, v[1]) or regexp_matches(v[1], '(?:ing|ed)\\z')) and contains(array_to_string(regexp_split_to_array(s, '\\s+')[1:14], ' '), ',')"),
    "participialRate": f"avg(case when {has(r',' + chr(92) + 's+[a-z]+ing' + chr(92) + 'b')} or {has('^[A-Z][a-z]+(?:ing|ed)' + chr(92) + 'b[^.]*,')} then 10.0 else 0.0 end)",
    "surface_uniformity": "case when count(*) >= 5 then coalesce(stddev_samp(l), 0) / greatest(1, avg(l)) end",
}


def _with(*more: str) -> str:
    return "with " + ",".join([BASE, *more]) + " "


def value(expr: str) -> str:
    return f"round(case when n > 0 then ({expr}) end, 6) as value"


def style(name: str) -> str | None:
    """SQL with doc_id and value, or None."""
    if name in TEXT:
        return _with() + f"select doc_id, {value(TEXT[name])} from b"
    if name in VOCAB:
        return _with(f"vb as (select *, {_VOCAB} as v from b)") + f"select doc_id, {value(VOCAB[name])} from vb"
    if name in SENTENCE:
        return _with(f"f as (select doc_id, {SENTENCE[name]} as x from sg group by doc_id)") + f"select doc_id, {value('x')} from b left join f using (doc_id)"
    if name == "rhetoricalQuestionRate":
        marked = f"z as (select doc_id, list_sum(list_transform(regexp_extract_all(t, '{re2(lx.QUOTE)}'), lambda q: len(regexp_extract_all(q[2:-2], '\\?(?:\\s|\\z)')))) as inside from t)"
        return _with(marked, f"f as (select doc_id, sum(case when {has(r'\?' + chr(92) + 's*$')} then 1 else 0 end) as q, count(*) as c from sg group by doc_id)") + f"select doc_id, {value('(q - least(q, coalesce(inside, 0))) * 100.0 / c')} from b left join f using (doc_id) left join z using (doc_id)"
    if name == "repeatedPhraseRate":
        return _with(f"f as (select doc_id, count(*) filter (c > 1) as again from (select doc_id, x, count(*) as c from (select doc_id, unnest({_TRI}) as x from b where n >= 3) group by doc_id, x) group by doc_id)") + f"select doc_id, {value('coalesce(again, 0) * 1000.0 / n')} from b left join f using (doc_id)"
    if name in ("quoteIntroSays", "quoteIntegrated"):
        before = "right(array_to_string(list_transform(range(1, j + 1), lambda i: case when i > 1 then q[i - 1] else '' end || g[i]), ''), 40)"
        lists = f"qa as (select doc_id, n, {_QUOTES} as q, string_split_regex(t, '{re2(lx.QUOTE)}') as g from b), qb as (select doc_id, n, list_filter(list_transform(range(1, len(q) + 1), lambda j: {{'q': q[j], 'b': {before}}}), lambda x: len(regexp_extract_all(x.q, '\\s+')) >= 1) as q from qa)"
        says = f"({has(lx.REPORTING, False, 'x.b')} or regexp_matches(x.b, ':\\s*\\z'))"
        test = says if name == "quoteIntroSays" else f"(regexp_matches(x.b, '[a-z,]\\s*\\z') and not {says})"
        return _with(lists) + f"select doc_id, {value(f'case when len(q) >= 2 then len(list_filter(q, lambda x: {test})) * 100.0 / len(q) end')} from qb"
    if name == "paragraphOpenerTransition":
        opener = "^(?:" + "|".join(lx.TRANSITIONS) + ")[ ,]"
        return _with(f"f as (select doc_id, case when count(*) filter (k > 0) >= 2 then count(*) filter (k > 0 and regexp_matches(lower(p), '{opener}')) * 100.0 / count(*) filter (k > 0) end as x from pe group by doc_id)") + f"select doc_id, {value('x')} from b left join f using (doc_id)"
    if name == "mechanicsRate":
        words = f"len(list_filter(regexp_extract_all(regexp_replace(t, '{re2(lx.QUOTE)}', chr(7), 'g'), '{W}'), lambda x: x = 'i' or list_contains({listed(lx.MISSPELLINGS)}, lower(x))))"
        return _with("f as (select doc_id, count(*) filter (regexp_matches(s, '^[a-z]')) as low from sg group by doc_id)") + f"select doc_id, {value(f'({words} + coalesce(low, 0)) * 1000.0 / n')} from b left join f using (doc_id)"
    return None


# Sentences with their tags, moves and levels.
def _cue(name: str) -> str:
    return has(lx.CUES[name], name == "evidenceLead")


_INNER = f"regexp_extract_all(s, '{re2(lx.QUOTE)}')"


def _quoted(gaps: int) -> str:
    """Whether a sentence holds a quotation with so many gaps between its parts."""
    return f"len(list_filter({_INNER}, lambda q: len(regexp_extract_all(q, '\\s+')) >= {gaps})) > 0"


MOVES = f"""
ob as (select doc_id, k, np, i, m, s, {", ".join(f"{_cue(c)} as c_{c}" for c in lx.CUES)}, {_quoted(2)} as long_quote, {_quoted(1)} as quote,
  regexp_matches(s, '{re2(lx.OPENS_BY_INTERPRETING)}') and {has(lx.CUES["explanation"], False, "s[1:60]")} as opens, regexp_matches(s[2:], '\\s[A-Z][a-z]+') as names,
  {has(TECHNIQUE, False)} as technique, {n_re(lx.ABSTRACT, False, "s")} as abstract, {n_re(lx.NOMINAL, False, "s")} as nominal from sg),
tg as (select *, long_quote or c_citation or c_evidenceLead as evidence, list_filter([case when c_counterpoint then 'counterpoint' end, case when long_quote or c_citation or c_evidenceLead then 'evidence' end,
  case when opens then 'explanation' end, case when c_qualification then 'qualification' end, case when c_implication then 'implication' end, case when c_context then 'context' end,
  case when c_explanation then 'explanation' end, case when c_reasoning then 'reasoning' end], lambda x: x is not null) as tags from ob),
mv as (select *, case when np >= 3 and k = 0 then case when c_thesis or i = m - 1 then 'thesis' else 'context' end
  when np >= 3 and k = np - 1 then case when i = 0 then 'conclusion' when c_implication then 'implication' when c_qualification then 'qualification' else 'conclusion' end
  when i = 0 and not evidence then 'claim' else coalesce(tags[1], case when names and not c_analytic then 'summary' else 'explanation' end) end as move,
  case when abstract >= 2 or (abstract >= 1 and nominal >= 2) then 2 when c_analytic or technique then 1 else 0 end as level from tg),
pa as (select p.doc_id, unnest(range(0, len(ps))) as k, len(ps) as np from p),
run as (select doc_id, k, count(distinct move) as dist, count(*) filter (prev is null or prev <> move) as steps from (select doc_id, k, move, lag(move) over (partition by doc_id, k order by i) as prev from mv) group by doc_id, k),
pf as (select pa.doc_id, pa.k, np >= 3 and (pa.k = 0 or pa.k = np - 1) as outer_, coalesce(dist, 0) as dist, coalesce(steps, 0) as steps from pa left join run on pa.doc_id = run.doc_id and pa.k = run.k),
pd as (select doc_id, count(*) as np, case when count(*) filter (not outer_) >= 2 then avg(dist) filter (not outer_) else avg(dist) end as dist, case when count(*) filter (not outer_) >= 2 then avg(steps) filter (not outer_) else avg(steps) end as steps from pf group by doc_id),
isl as (select *, sum(case when move in ('evidence', 'claim') then 1 else 0 end) over (partition by doc_id, k order by i) as isle from mv),
ch as (select doc_id, k, isle, max(case when is_x then 1 else 0 end) + max(case when technique then 1 else 0 end) + max(case when is_c then 1 else 0 end) + max(case when is_q then 1 else 0 end) + max(case when is_i then 1 else 0 end) as depth, max(case when is_i then 1 else 0 end) as leap
  from (select doc_id, k, isle, technique, first_value(move) over (partition by doc_id, k, isle order by i) as lead, not (move = 'evidence') and (list_contains(tags, 'explanation') or list_contains(tags, 'reasoning') or move in ('explanation', 'reasoning', 'summary')) as is_x,
    not (move = 'evidence') and (list_contains(tags, 'context') or move = 'context') as is_c, not (move = 'evidence') and (list_contains(tags, 'qualification') or list_contains(tags, 'counterpoint') or move in ('qualification', 'counterpoint')) as is_q,
    not (move = 'evidence') and (list_contains(tags, 'implication') or move = 'implication' or level = 2) as is_i from isl where isle > 0) where lead = 'evidence' group by doc_id, k, isle),
cs as (select doc_id, count(*) as chains, avg(depth) as depth, avg(leap) * 100.0 as leap from ch group by doc_id),
ag as (select doc_id, count(*) as ns, {", ".join(f"count(*) filter (move = '{x}') as m_{x}" for x in ("claim", "thesis", "evidence", "explanation", "reasoning", "counterpoint", "summary"))},
  count(*) filter (move = 'qualification' or list_contains(tags, 'qualification')) as qual, count(*) filter (move = 'implication' or list_contains(tags, 'implication')) as impl, avg(level) as level,
  {_SHARE("level = 2")} as abs2, {_SHARE("level = 0")} as con0, count(*) filter (move in ('explanation', 'reasoning', 'implication', 'qualification')) as an, count(*) filter (technique and move in ('explanation', 'reasoning', 'implication', 'qualification')) as an_t,
  count(*) filter (move = 'evidence' or evidence) as ev, count(*) filter ((move = 'evidence' or evidence) and not quote) as ev_p, count(*) filter ((move = 'evidence' or evidence) and (quote or c_citation or regexp_matches(s, '[0-9]'))) as ev_s,
  {" + ".join(f"max(case when {has(p, False)} then 1 else 0 end)" for p in lx.EVIDENCE_TYPES.values())} as kinds from mv group by doc_id),
qs as (select doc_id, list_filter(list_transform({_QUOTES}, lambda q: len(regexp_extract_all(q, '\\s+')) + 1), lambda c: c >= 2) as q from t),
cl as (select doc_id, k, i, move, list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z]{{4,}}'), lambda x: not list_contains({listed(lx.STOP_CONTENT)}, x))) as c from mv where move in ('claim', 'thesis')),
th as (select doc_id, arg_min(c, k * 100000 + i) as c from cl where move = 'thesis' group by doc_id),
cr as (select doc_id, count(*) as claims, count(*) filter (rep) as rep from (select a.doc_id, a.k, a.i, bool_or(len(list_intersect(a.c, o.c)) * 1.0 / greatest(1, len(a.c) + len(o.c) - len(list_intersect(a.c, o.c))) >= 0.45) as rep from (select * from cl where move = 'claim') a
  left join (select doc_id, k, i, c from cl where move = 'claim' union all select doc_id, -1, -1, c from th) o on a.doc_id = o.doc_id and not (a.k = o.k and a.i = o.i) group by a.doc_id, a.k, a.i) group by doc_id),
"""
_ALL = """al as (select b.doc_id, n, coalesce(ns, 0) as ns, greatest(1, coalesce(pd.np, 0)) as np, m_claim, m_thesis, m_evidence, m_explanation, m_reasoning, m_counterpoint, m_summary, qual, impl, level, abs2, con0, an, an_t, ev, ev_p, ev_s, coalesce(kinds, 0) as kinds,
  pd.dist, pd.steps, coalesce(chains, 0) as chains, cs.depth, cs.leap, q, coalesce(claims, 0) as claims, rep from b left join ag on b.doc_id = ag.doc_id left join pd on b.doc_id = pd.doc_id left join cs on b.doc_id = cs.doc_id left join qs on b.doc_id = qs.doc_id left join cr on b.doc_id = cr.doc_id)"""
MOVES = MOVES.rstrip() + "\n" + _ALL
DISCOURSE = {
    "movesPerParagraph": "case when ns >= 6 then dist end", "chainLength": "case when ns >= 6 then steps end", "evidencePerClaim": "case when m_claim + m_thesis >= 2 then m_evidence * 1.0 / (m_claim + m_thesis) end",
    "explanationPerEvidence": "case when m_evidence >= 3 then (m_explanation + m_reasoning) * 1.0 / m_evidence end", "qualificationPerParagraph": "case when ns >= 6 then qual * 1.0 / np end", "counterPerParagraph": "case when ns >= 6 then m_counterpoint * 1.0 / np end",
    "implicationPerParagraph": "case when ns >= 6 then impl * 1.0 / np end", "summaryShare": "case when ns >= 6 then m_summary * 100.0 / ns end", "claimRepetition": "case when claims >= 3 then coalesce(rep, 0) * 100.0 / claims end",
    "abstractionIndex": "case when ns > 0 then level end", "abstractShare": "case when ns > 0 then abs2 end", "concreteShare": "case when ns > 0 then con0 end", "reasoningDepth": "case when chains >= 2 then depth end",
    "techniqueNaming": "case when an >= 4 then an_t * 100.0 / an end", "thematicLeapRate": "case when chains >= 3 then leap end", "quotesPer100": "case when n > 0 then len(q) * 100.0 / n end", "meanQuoteLength": "case when len(q) >= 2 then list_avg(q) end",
    "paraphraseShare": "case when ev >= 3 then ev_p * 100.0 / ev end", "evidenceSpecificity": "case when ev >= 3 then ev_s * 100.0 / ev end", "evidenceTypeDiversity": "kinds * 1.0",
}


def discourse(name: str) -> str:
    return _with(MOVES) + f"select doc_id, round({DISCOURSE[name]}, 6) as value from al"


def moves() -> str:
    return _with(MOVES) + "select doc_id, k as paragraph, move, level, count(*) as n from mv group by all"


PRIMITIVES = {
    "words": _with() + "select doc_id, n as n_words, len(list_distinct(w)) as n_distinct from b",
    "sentences": _with() + "select doc_id, count(*) as n_sentences, max(l) as longest from sg group by doc_id",
    "paragraphs": _with() + "select doc_id, len(ps) as n_paragraphs from p",
    "quotes": _with() + f"select doc_id, len({_QUOTES}) as n_quotes from t",
    "syllables": _with() + f"select x as word, max({syllables('x')}) as n from (select unnest(w) as x from b) group by x",
    "p90_sentence": _with() + "select doc_id, list_sort(list(l))[least(count(*), cast(floor(0.9 * count(*)) as int) + 1)] as p90 from sg group by doc_id having count(*) >= 10",
}


def stems() -> str:
    w = "regexp_replace(x, '''s\\z', '')"
    cases = " ".join(f"when length({w}) - {len(s)} >= 4 and ends_with({w}, '{s}') then left({w}, length({w}) - {len(s)})" for s in lx.STEM_SUFFIXES)
    return _with() + f"select distinct x as word, case {cases} else {w} end as stem from (select unnest(w) as x from b)"


PRIMITIVES["stems"] = stems()

# A profile of writers over a table of their documents: the last one is the piece, the others its baseline.
_PROFILE = f"""
f as (select doc_id, avg(l) as x from sg group by doc_id),
d as (select b.doc_id, source, lang, n, x, max(b.doc_id) over (partition by source) as last from b left join f on b.doc_id = f.doc_id),
cur as (select * from d where doc_id = last),
pr as (select c.doc_id as piece_id, c.x as cx, o.doc_id, o.x, o.lang, floor((case when o.lang = c.lang and o.lang <> '' then 0.9 else 0.4 end) * (case when o.n < 120 then 0.5 else 1 end) * 100 + 0.5) / 100 as w from cur c join d o on o.source = c.source and o.doc_id < c.doc_id),
pt as (select *, row_number() over (partition by piece_id order by doc_id) - 1 as k, sum(w * x) over (partition by piece_id) / sum(w) over (partition by piece_id) as m from pr where x is not null),
st as (select piece_id, max(cx) as cx, max(m) as mean, case when count(*) < 2 then 0 else sqrt(sum(w * (x - m) * (x - m)) / sum(w) * count(*) / (count(*) - 1)) end as sd, min(x) as lo, max(x) as hi, count(*) as n,
  regr_slope(x, k) as slope, case when var_pop(x) = 0 then 0 else regr_r2(x, k) end as r2, regr_intercept(x, k) + regr_slope(x, k) * count(*) as nxt from pt group by piece_id)
"""
PROFILE = {
    "similarity_weight": _with(_PROFILE) + "select piece_id, doc_id, w as weight from pr",
    "n_eff": _with(_PROFILE) + "select piece_id, count(*) as n, round(sum(w) * sum(w) / sum(w * w), 6) as n_eff, count(distinct case when lang = '' then 'unspecified' else coalesce(lang, 'unspecified') end) as genres from pr group by piece_id",
    "sufficiency": _with(_PROFILE) + "select piece_id, case when count(*) < 3 then 'insufficient' when count(*) >= 10 and count(distinct lang) >= 2 then 'strong' when count(*) >= 5 then 'preferred' else 'minimum' end as sufficiency from pr group by piece_id",
    "weighted_profile": _with(_PROFILE) + "select piece_id, round(mean, 6) as mean, round(sd, 6) as sd, round(lo, 6) as lo, round(hi, 6) as hi, n from st",
    "trend": _with(_PROFILE) + "select piece_id, round(slope, 6) as slope, round(r2, 6) as r2, round(nxt, 6) as next from st where n >= 4",
    "deviation": _with(_PROFILE) + "select piece_id, round((cx - mean) / greatest(sd, 0.12 * abs(mean), 2.5), 6) as raw_z from st where cx is not null",
    "verb_counts": _with() + f"select source, x as verb, count(*) as n from (select source, unnest(list_filter(w, lambda y: list_contains({listed(lx.BASIC_VERBS + lx.ADVANCED_VERBS)}, y))) as x from b) group by source, x",
    "genre_counts": "select lower(lang) as genre, count(*) as n from documents group by 1",
    "first_seen_words": _with() + "select source, count(*) as n_new from (select distinct source, x from (select source, doc_id, max(doc_id) over (partition by source) as last, unnest(w) as x from b) where doc_id = last and length(x) >= 8 except select distinct source, x from (select source, doc_id, max(doc_id) over (partition by source) as last, unnest(w) as x from b) where doc_id < last) group by source",
}

# Events: a user is a sample, value stands for inserted words; pauses are days and hours, as the table's events are far apart.
EVENTS = {
    "ev_sessions": "select user_id, count(*) as sessions, max(n) as longest from (select user_id, g, count(*) as n from (select user_id, sum(brk) over (partition by user_id order by ts) as g from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 12 hours then 1 else 0 end as brk from events)) group by user_id, g) group by user_id",
    "ev_active": "select user_id, cast(coalesce(sum(gap) filter (gap <= 43200000000), 0) as bigint) as active_us from (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events) group by user_id",
    "ev_window": "select user_id, round(max(s), 4) as largest from (select user_id, sum(value) over (partition by user_id order by ts range between current row and interval 1 day following) as s from events) group by user_id",
    "ev_islands": "select user_id, g as island, count(*) as n, round(sum(value), 4) as total from (select user_id, value, sum(brk) over (partition by user_id order by ts) as g from (select user_id, ts, value, case when event_type = 'error' or lag(event_type) over (partition by user_id order by ts) is null or lag(event_type) over (partition by user_id order by ts) = 'error' or ts - lag(ts) over (partition by user_id order by ts) > interval 12 hours then 1 else 0 end as brk, event_type from events) where true) group by user_id, g",
    "ev_growth": "select user_id, round(sum(value) filter (ts <= s + (e - s) / 2) * 100.0 / sum(value), 4) as at_half from (select user_id, ts, value, min(ts) over (partition by user_id) as s, max(ts) over (partition by user_id) as e from events) group by user_id having sum(value) > 0",
}

# The log derived from documents: chunks of forty characters, each fifth deleted and put in again.
_LOG = """ck as (select doc_id, unnest(range(0, (length(text) + 39) // 40)) as k, text from documents where text <> ''),
cc as (select doc_id, k, text[k * 40 + 1 : k * 40 + 40] as c from ck)"""
LOG = {
    "replay_roundtrip": "select cast(doc_id as varchar) as sample_id, md5(text) as text_md5, length(text) as chars from documents where text <> ''",
    "process_retention": f"with {_LOG} select cast(doc_id as varchar) as sample_id, round(sum(length(c)) * 100.0 / (sum(length(c)) + coalesce(sum(length(c)) filter (k % 5 = 4), 0)), 6) as value from cc group by doc_id",
    "process_activeMinutes": f"with {_LOG} select cast(doc_id as varchar) as sample_id, round((max(k) * 3000 + case when max(k) % 5 = 4 then 900 else 0 end) / 60000.0, 6) as value from cc group by doc_id",
    "process_sessions": "select cast(doc_id as varchar) as sample_id, 1.0 as value from documents where text <> ''",
    "process_pastedShare": "select cast(doc_id as varchar) as sample_id, 0.0 as value from documents where text <> ''",
    "process_pasteEvents": "select cast(doc_id as varchar) as sample_id, 0.0 as value from documents where text <> ''",
    "process_multiParagraphPastes": "select cast(doc_id as varchar) as sample_id, 0.0 as value from documents where text <> ''",
}

_LAST = "(select *, doc_id = max(doc_id) over (partition by source) as last from documents)"
_EVEN = "regexp_replace(regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '\\s+\\z', ''), '[ \\t]+\\n', chr(10), 'g')"
_SUBMITTED = "case doc_id % 3 when 0 then text || ' ' || chr(9) || chr(10) when 1 then text || 'x' else replace(text, chr(10), ' ' || chr(13) || chr(10)) end"
ROSTER = {
    "most_similar": _with(_PROFILE) + "select piece_id, doc_id as sample_id, w as weight from pr qualify row_number() over (partition by piece_id order by w desc, doc_id desc) = 1",
    "pieces_per_assignment": f"select lang as assignment_id, count(*) filter (last) as n from {_LAST} where lang is not null group by lang",
    "into_baseline": f"select case when last and doc_id % 2 = 1 then 'current' else 'baseline' end as role, case when last and doc_id % 2 = 0 then true end as include, case when last and doc_id % 2 = 0 then true end as authentic, count(*) as n from {_LAST} group by all",
    "assignment_edit": f"select case when last then 'current' else 'baseline' end as role, case when last and lang = 'en' then 'essay' else lang end as genre, case when last and lang = 'en' then 'analysis' end as assignment_type, case when last and lang = 'en' then true end as timed, count(*) as n from {_LAST} group by all",
    "edit_totals": f"with {_LOG}, su as (select doc_id, sum(length(c)) as a, coalesce(sum(length(c)) filter (k % 5 = 4), 0) as b from cc group by doc_id) select cast(doc_id as varchar) as sample_id, cast(a + b as bigint) as inserted, cast(b as bigint) as deleted, cast(a + b as bigint) as typed, cast(0 as bigint) as pasted_surviving, round(b / (a + b), 6) as revision_ratio from su",
    "matches_submission": f"select cast(doc_id as varchar) as sample_id, {_EVEN.format('text')} = {_EVEN.format('(' + _SUBMITTED + ')')} as matches from documents where text <> ''",
    "merged_ranges": "select user_id, min(h) as start, max(h) + 6 as stop from (select user_id, h, sum(brk) over (partition by user_id order by h rows unbounded preceding) as g from (select user_id, h, case when h - lag(h) over (partition by user_id order by h) <= 7 then 0 else 1 end as brk from (select distinct user_id, epoch_ms(ts) // 3600000 as h from events))) group by user_id, g",
}


def series(names: list[str]) -> str:
    each = " union all ".join(f"select '{n}' as feature_id, doc_id, value from ({style(n)})" for n in names)
    return f"select source as writer_id, feature_id, row_number() over (partition by source, feature_id order by doc_id) as place, doc_id as sample_id, case when last then 'current' else 'baseline' end as role, value from ({each}) join {_LAST} using (doc_id) where value is not null"
