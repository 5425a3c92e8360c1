"""All features of style and discourse of many texts at once: what functions.text, style and discourse say as columns, worked
out in Arrow batches for the analysis of large tables, where a lambda for each word, interpreted, takes most of the time.

Texts are taken some hundreds at a time. Each is split into sentences; what a sentence shows and counts is worked out once for
as long as it is the same sentence, and a text adds up its sentences. What a word is, is found for all new words of a batch
together. A pattern is only tried where a word holds a piece, or is a word, which its matches can't be without.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions.patterns import SPACES
from ..functions.text import ASKED, CLOSE, CLOSERS, CURLY_CLOSE, CURLY_OPEN, CUT, OPEN, QUOTED
from .discourse import SAME_CLAIM, STEPS, TECHNIQUE
from .features import DISCOURSE, STYLE
from .style import WINDOW

#: Words and sentences that are kept at most; beyond it they are worked out anew.
KEPT = 200_000, 20_000
#: What there may be beside the features: the distinct stems of all words, and a map of analytical verbs to counts.
EXTRAS = "_stems", "_verbs"
#: Texts and characters that are worked on together.
TEXTS = 500, 4_000_000
BLANKS = re.sub(r"\\x0B|\\u([0-9A-F]{4})-\\u([0-9A-F]{4})|\\u([0-9A-F]{4})|\\[tnfr]", lambda m: "".join(map(chr, range(int(m[1], 16), int(m[2], 16) + 1))) if m[1] else m[0].encode().decode("unicode_escape"), SPACES)


def python(pattern: str, case: bool = True) -> re.Pattern:
    """A pattern of the dialect of functions.patterns for Python."""
    out, inside = [], False
    for t in re.findall(r"\\.|\[\^?|\]|\$|[^\\\[\]$]+", pattern):
        inside = t.startswith("[") or inside and t != "]"
        out.append((SPACES if inside else f"[{SPACES}]") if t == r"\s" else f"[^{SPACES}]" if t == r"\S" and not inside else r"\Z" if t == "$" and not inside else t)
    return re.compile("".join(out), re.ASCII | (0 if case else re.IGNORECASE))


def pieces(pattern: re.Pattern) -> frozenset[tuple[str, bool]]:
    """Pieces of words, one of which is in whatever the pattern matches, in lower case, and whether it stands there with no ASCII
    letter beside it; # is a digit. Empty: none are known."""

    letters = {ord(x) for x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def apart(item: tuple) -> bool:
        op, arg = str(item[0]), item[1]
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            return arg[0] > 0 and len(arg[2]) == 1 and apart(arg[2][0])
        if op == "IN":
            return all(str(k) == "LITERAL" and x not in letters or str(k) == "RANGE" and letters.isdisjoint(range(x[0], x[1] + 1)) for k, x in arg)
        return op == "AT" and str(arg) != "AT_NON_BOUNDARY" or op == "LITERAL" and arg not in letters

    def of(seq, left: bool, right: bool) -> frozenset[tuple[str, bool]]:
        items, found, run, edge = list(seq), [], "", left
        for k, (op, arg) in enumerate([*items, (None, None)]):
            name = str(op)
            if name == "LITERAL" and chr(arg).isascii() and chr(arg).isalpha():
                edge = edge if run else left if k == 0 else apart(items[k - 1])
                run += chr(arg).lower()
                continue
            after = right if op is None else apart((op, arg))
            if run:
                found.append(frozenset([(run, edge and after)]))
            run = ""
            before, beyond = (left if k == 0 else apart(items[k - 1])), (right if k >= len(items) - 1 else apart(items[k + 1]))
            if name == "LITERAL" and chr(arg) in "0123456789" or name == "IN" and len(arg) == 1 and str(arg[0][1]) == "CATEGORY_DIGIT":
                found.append(frozenset([("#", False)]))
            elif name == "SUBPATTERN":
                found.append(of(arg[-1], before, beyond))
            elif name == "BRANCH":
                each = [of(b, before, beyond) for b in arg[1]]
                found.append(frozenset().union(*each) if all(each) else frozenset())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                found.append(of(arg[2], before and arg[1] == 1, beyond and arg[1] == 1))
        return max(found, key=lambda s: (min((len(x) for x, _ in s), default=0), bool(s) and all(w for _, w in s)), default=frozenset())

    return of(re._parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE), False, False)


def needed(pattern: re.Pattern) -> frozenset[str]:
    """The pieces by themselves."""
    return frozenset(x for x, _ in pieces(pattern))


class Gates:
    """Patterns by name, each with a bit; a mask of bits says which ones a text may match."""

    def __init__(self, patterns: dict[str, re.Pattern]) -> None:
        self.patterns, self.bits, self.always, self.digits = patterns, {k: 1 << i for i, k in enumerate(patterns)}, 0, 0
        self.find = {k: p.match if p.pattern.startswith("^") and "|^" not in p.pattern else p.search for k, p in patterns.items()}
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        for k, p in patterns.items():
            found = pieces(p)
            if ("#", False) in found:
                self.digits |= self.bits[k]
            if not found or any(len(x) < 2 and not whole for x, whole in found - {("#", False)}):
                self.always |= self.bits[k]
                continue
            for x, whole in found - {("#", False)}:
                into = self.words if whole else self.parts
                into[x] = into.get(x, 0) | self.bits[k]

    def of_words(self, words: list[str]) -> dict[str, int]:
        """Of lower-case words: the masks that are not 0."""
        out = {w: self.words[w] for w in words if w in self.words}
        for w in words:
            if not (w.isascii() and w.isalpha()):
                for x in re.findall("[a-z]+", w.replace("i\u0307", " ")):
                    if x in self.words:
                        out[w] = out.get(w, 0) | self.words[x]
        joined = "\n".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        for piece, bit in self.parts.items():
            at, found = joined.find(piece), []
            while at >= 0:
                found.append(at)
                at = joined.find(piece, at + 1)
            for k in np.unique(np.searchsorted(ends, found, "right")):
                out[words[k]] = out.get(words[k], 0) | bit
        return out


LISTS = {
    "basic": lx.BASIC_VERBS, "advanced": lx.ADVANCED_VERBS, "hedging": lx.HEDGES, "intensifier": lx.INTENSIFIERS, "modal": lx.MODALS, "prep": lx.PREPOSITIONS,
    "first": lx.FIRST_PERSON, "certainty": lx.BOOSTERS, "evaluative": lx.EVALUATIVE,
}
_CUES = ("counterpoint", "qualification", "implication", "context", "explanation", "reasoning", "thesis", "analytic", "citation")


BEGUN = r"(?:^|[.!?]\s+)"
#: A sentence without cues has these.
_NO_KINDS = [False] * len(lx.EVIDENCE_TYPES)
#: Counts of words are added up in parts of one number: all, rare ones, academic ones and long ones.
PART = 32


def forms(terms: frozenset[str]) -> frozenset[str]:
    """The words of which the catalogue's rough lemma is one of the terms (functions.text.lemma_in)."""

    def is_one(w: str) -> bool:
        return w in terms or re.sub(r"ies\Z", "y", w) in terms or re.sub(r"(?:es|s|ed|ing|ly|al)\Z", "", w) in terms or re.sub(r"(?:ing|ed)\Z", "e", w) in terms

    made = {t[:-1] + x for t in terms for e, xs in (("y", ["ies"]), ("e", ["ing", "ed"])) if t.endswith(e) for x in xs}
    return terms | {w for w in made | {t + x for t in terms for x in ("es", "s", "ed", "ing", "ly", "al")} if is_one(w)}


class Engine:
    """What one worker keeps between texts."""

    def __init__(self, lexicon: lx.Lexicon) -> None:
        self.everyday, self.academic = forms(frozenset(lexicon.everyday)), forms(frozenset(lexicon.academic))
        self.word, self.quote, self.space = python(lx.WORD), python(lx.QUOTE), python(r"\s+")
        self.end = python(f"[.!?{ASKED}]{CLOSERS}*+(?=\\s|$)")
        self.short = python(r"\b(?:" + "|".join(lx.ABBREVIATIONS) + ")$", case=False)
        self.starts = python(r"(?:[.!?]\s{1,2}|\n\s{0,2})$")
        self.digit, self.mark, self.broken = re.compile("[0-9]"), re.compile(f"[{OPEN}{CLOSE}{CURLY_OPEN}{CURLY_CLOSE}]"), python(f"[{OPEN}{CLOSE}{CURLY_OPEN}{CURLY_CLOSE}]|[.!?]\\s")
        self.lists, self.verbs = [frozenset(x) for x in LISTS.values()], frozenset((*lx.BASIC_VERBS, *lx.ADVANCED_VERBS))
        self.listed = frozenset().union(*self.lists)
        self.ends = ("ing", "ed")
        self.subs, self.rels, self.dets, self.opening = frozenset(lx.SUBORDINATORS), frozenset(lx.RELATIVES), frozenset(lx.DETERMINERS), frozenset((*lx.SUBORDINATORS, *lx.PREPOSITIONS))
        self.clauses = self.subs | self.rels
        self.misspelt, self.stop, self.ly = frozenset(lx.MISSPELLINGS), frozenset(lx.STOP_CONTENT), frozenset(lx.LY_NOT_ADVERBS)
        self.content, self.quoted = re.compile("[a-z]{4,}"), python(QUOTED)
        across = [k for k, p, _ in lx.SURFACE if "[^.]" in p or "[.!?]" in p]  # these may go over the end of a sentence
        self.of_text = Gates({f"surface_{k}": python(p, c) for k, p, c in lx.SURFACE if k in across})
        #: Patterns that begin at the text's start or after the end of a sentence, as both: a search for either tries every place.
        self.begun = {f"surface_{k}": (python(x, c), python(r"[.!?]\s+" + x, c)) for k, p, c in lx.SURFACE if p.startswith(BEGUN) and "|" + BEGUN not in p for x in [p.removeprefix(BEGUN)]}
        inner = {f"surface_{k}": python(p, c) for k, p, c in lx.SURFACE if k not in across}
        transitions = {f"transition_{k}": python(r"\b" + r"\s+".join(p.split(" ")) + r"\b") for k, p in enumerate(lx.TRANSITIONS)}
        self.of_sentence = Gates(
            {k: python(lx.CUES[k], False) for k in _CUES} | {"lead": python(lx.CUES["evidenceLead"]), "technique": python(TECHNIQUE, False), "abstract": python(lx.ABSTRACT, False), "nominal": python(lx.NOMINAL, False)}
            | {"passive": python(lx.PASSIVE, False), "qualified": python(lx.QUALIFIED, False), "coord": python(r",\s+(?:and|but|or|so|yet)\s", False), "ing": python(r",\s+\w+ing\b"), "ing_low": python(r",\s+[a-z]+ing\b"), "opening_part": python(r"^[A-Z][a-z]+(?:ing|ed)\b[^.]*,")}
            | {f"kind_{k}": python(p, False) for k, p in lx.EVIDENCE_TYPES.items()} | {"contraction": python(lx.CONTRACTION, False)} | transitions | inner
        )
        bits = self.of_sentence.bits
        self.with_comma, self.transitions = sum(bits[k] for k in ("coord", "ing", "ing_low", "opening_part")), [(k, bits[k]) for k in transitions]
        self.any_cue = sum(bits[k] for k in (*_CUES, "lead", "technique"))
        self.inner, self.any_inner = [(k, bits[k]) for k in inner], sum(bits[k] for k in inner)
        self.any_transition, self.any_kind = sum(b for _, b in self.transitions), sum(bits[f"kind_{k}"] for k in lx.EVIDENCE_TYPES)
        #: Words after which a transition may go on in the next paragraph.
        self.going_on = frozenset(w for t in lx.TRANSITIONS for w in t.split(" ")[:-1])
        self.names, self.opens = python(r"\s[A-Z][a-z]+"), python(lx.OPENS_BY_INTERPRETING)
        self.colon, self.paren = python(r":(?!\d)"), python(r"\((?!\s*(?:p\.?\s*)?\d)[^)]{3,}\)")
        self.reporting, self.colon_ends, self.woven = python(lx.REPORTING, False), python(r":\s*$"), python(r"[a-z,]\s*$")
        self.opener = python("^(?:" + "|".join(lx.TRANSITIONS) + ")[ ,]")
        self.forget_words()

    def forget_words(self) -> None:
        self.ids: dict[str, int] = {}
        self.counted = np.zeros((1024, len(LISTS) + 1), np.int32)
        self.stems: dict[str, str] = {}
        self.text_mask: dict[str, int] = {}
        self.sentence_mask: dict[str, int] = {}
        self.vocab: dict[str, int] = {}  # of words as they stand, in parts
        self.within: dict[str, int] = {}  # the same, without words that begin with A to Z
        self.forget_sentences()

    def forget_sentences(self) -> None:
        self.seen: dict[str, tuple] = {}
        self.quoting: dict[str, int] = {}

    def learn(self, raw: list[str]) -> None:
        """What there is to know of words as they stand, none of which is known."""
        lows = "\n".join(raw).lower().split("\n")
        letters = re.sub(r"[^a-z\n]", "", "\n".join(lows))
        cores = re.sub(r"(?m)^y", "", re.sub(r"(?m)(?:[^laeiouy\n]es|ed|[^laeiouy\n]e)$", "", letters))
        sounds = re.sub(r"[aeiouy]{1,2}", "#", cores).split("\n")
        for x, low, w, s in zip(raw, lows, letters.split("\n"), sounds):
            v = 1 | (len(x) >= 7 and low not in self.everyday) << PART | (low in self.academic) << 2 * PART | (len(w) > 3 and s.count("#") >= 3) << 3 * PART
            self.vocab[x] = v
            self.within[x] = 0 if "A" <= x[0] <= "Z" else v
        ids = self.ids
        new = [w for w in dict.fromkeys(lows) if w not in ids]
        n = len(ids)
        ids.update(zip(new, range(n, n + len(new))))
        while len(ids) > len(self.counted):
            self.counted = np.concatenate([self.counted, np.zeros_like(self.counted)])
        for k, w in enumerate(new, n):
            if w in self.listed:
                self.counted[k, :-1] = [w in x for x in self.lists]
            if w.endswith(("ous", "ive", "ful", "less", "able", "ible", "ical")) or w.endswith("ly") and len(w) > 4 and w not in self.ly:
                self.counted[k, -1] = 1
            self.stems[w] = stem(w)
        self.text_mask |= self.of_text.of_words(new)
        self.sentence_mask |= self.of_sentence.of_words(new)

    def cut(self, paragraph: str) -> list[tuple[int, str]]:
        """Pieces of a paragraph, as functions.text.sentences has them but for those without a word, which are here, too; where each
        begins."""
        out, begun = [], 0
        for m in self.end.finditer(paragraph):
            k = m.start()
            if paragraph[k] == "." and self.short.search(paragraph[max(0, k - 5) : k]):
                # what follows the full stop may end a sentence itself
                if m.end() == k + 1 or not (m := self.end.match(paragraph, k + 1)):
                    continue
            out.append((begun, paragraph[begun : m.end()]))
            begun = m.end()
        out.append((begun, paragraph[begun:]))
        if CUT in paragraph:
            out = [(at + sum(len(x) + 1 for x in parts[:k]), p) for at, s in out for parts in [s.split(CUT)] for k, p in enumerate(parts)]
        return [(at + len(s) - len(x), x.rstrip(BLANKS)) for at, s in out if (x := s.lstrip(BLANKS))]

    def heard(self, t: str, inside: bool) -> tuple[int, int]:
        """Of a sentence: its words outside of quotations that count for the vocabulary, in parts, and its first word, if that is at
        its very start and begins with A to Z, as whether it counts depends on what is before. inside: begins within a quotation."""
        if inside:
            shut = re.search(f"[{CLOSE}{CURLY_CLOSE}]", t)
            t = '"' + t[shut.end() :] if shut else ""
        t = re.sub(f"{OPEN}[^{CLOSE}]*(?:{CLOSE}|\\Z)|{CURLY_OPEN}[^{CURLY_CLOSE}]*(?:{CURLY_CLOSE}|\\Z)", '""', t)
        out = first = 0
        for m in self.word.finditer(t):
            x, k = m[0], m.start()
            if not k and "A" <= x[0] <= "Z":
                first = self.vocab[x]
            elif not "A" <= x[0] <= "Z" or self.starts.search(t[max(0, k - 3) : k]):
                out += self.vocab[x]
        return out, first

    def sentence(self, t: str, raw: list[str]) -> tuple:
        """What a sentence shows by itself."""
        joined = "\n".join(raw)
        lower = joined.lower()
        w = lower.split("\n")
        g = self.of_sentence
        p, find, bits = g.patterns, g.find, g.bits
        digit = self.digit.search(t) is not None
        mask = g.always | (g.digits if digit else 0)
        masks = self.sentence_mask
        for x in w:
            if x in masks:
                mask |= masks[x]
        comma = "," in t
        if not comma:
            mask &= ~self.with_comma
        has = lambda k: bool(mask & bits[k]) and find[k](t) is not None
        number = lambda k: len(p[k].findall(t)) if mask & bits[k] else 0
        sub = rel = 0
        if not self.clauses.isdisjoint(w):
            for k, x in enumerate(w):
                if x in self.clauses:
                    y = w[k + 1] if k + 1 < len(w) else ""
                    sub += x in self.subs and not (x == "as" and y == "well")
                    rel += x in self.rels and k > 0 and not (x == "that" and y in self.dets)
        parts = [len(self.space.findall(q)) + 1 for q in self.quoted.findall(t)] if OPEN in t or CURLY_OPEN in t else []
        longest = max(parts, default=0)
        first = w[0]
        citation = abstract = nominal = coord = ing = contraction = 0
        passive = participle = qualified = False
        inflected = first.endswith(self.ends)
        if mask:
            citation, abstract, nominal, coord, ing, contraction = has("citation"), number("abstract"), number("nominal"), number("coord"), number("ing"), number("contraction")
            passive, participle, qualified = has("passive"), has("ing_low") or inflected and has("opening_part"), has("qualified")
        kinds, moved, thesis, analytic, technique, transitions, surface = _NO_KINDS, (), False, False, False, 0, None
        proof = citation or longest >= 3
        if mask & self.any_cue:
            explains, analytic, technique, thesis = has("explanation"), has("analytic"), has("technique"), has("thesis")
            opens = explains and bool(self.opens.match(t)) and bool(p["explanation"].search(t[:60]))
            proof = proof or has("lead")
            moved = (("counterpoint", has("counterpoint")), ("evidence", proof), ("explanation", opens), ("qualification", has("qualification")), ("implication", has("implication")), ("context", has("context")), ("explanation", explains), ("reasoning", has("reasoning")))
            moved = tuple(dict.fromkeys(k for k, c in moved if c))
        elif proof:
            moved = ("evidence",)
        if mask & self.any_kind:
            kinds = [has(f"kind_{k}") for k in lx.EVIDENCE_TYPES]
        if mask & self.any_transition:
            low = t.lower()
            transitions = sum(len(p[k].findall(low)) for k, bit in self.transitions if mask & bit)
        if mask & self.any_inner:
            surface = {k: c for k, bit in self.inner if mask & bit and (c := len(p[k].findall(t)))} or None
        level = 2 if abstract >= 2 or abstract >= 1 and nominal >= 2 else 1 if analytic or technique else 0
        opening = comma and (first in self.opening or inflected) and "," in " ".join(self.space.split(t)[:14])
        at_first = 0
        if self.broken.search(t):
            vocab, at_first = self.heard(t, False)
        else:
            vocab = sum(map(self.within.__getitem__, raw))
            if "A" <= t[0] <= "Z":
                at_first = self.vocab[raw[0]]
        texts = 0
        for x in w:
            if x in self.text_mask:
                texts |= self.text_mask[x]
        k = t[0] == joined[0]  # a name is no first word
        return (
            len(w), sub, rel, coord, ing, first, " ".join(w[:2]), (t[-1] == "?", passive, opening, participle, qualified, "a" <= t[0] <= "z"),
            moved, level, thesis, analytic, technique, longest >= 2, citation, not moved and joined[k:] != lower[k:] and self.names.search(t, 1) is not None, digit, kinds,
            w, vocab, at_first, (abstract, nominal, contraction, transitions), texts, surface, "i" in raw or not self.misspelt.isdisjoint(w),
        )

    def split(self, text: str | None) -> tuple:
        """A text's quotations and sentences: itself, paragraphs, what is outside of quotations, quotations, and for each sentence
        its text, paragraph, place in it, whether a capital counts at its start, and whether it begins within a quotation."""
        t = text or ""
        gaps, quotes, marked, at = [], [], [], 0
        if '"' in t or "“" in t:
            for m in self.quote.finditer(t):
                gap, q = t[at : m.start()], m[0]
                inner = q[1:-1].replace("?", ASKED)
                marked += [gap, OPEN + inner + CLOSE if q[0] == '"' else CURLY_OPEN + inner + CURLY_CLOSE]
                gaps.append(gap)
                quotes.append((q, m.start()))
                at = m.end()
        gaps.append(t[at:])
        paras, sents = [], []
        for line, p in enumerate("".join([*marked, t[at:]]).split("\n")):
            if not (x := p.lstrip(BLANKS)):
                continue
            before = len(p) - len(x) <= 2 if line else len(x) == len(p)
            x, inside, i = x.rstrip(BLANKS), False, 0
            any_mark = bool(quotes) and self.mark.search(x) is not None
            for k, s in self.cut(x):
                if self.word.search(s):
                    begins = "A" <= s[0] <= "Z" and (before if not k else self.starts.search(x[max(0, k - 3) : k]) is not None)
                    sents.append((s, len(paras), i, begins, inside))
                    i += 1
                if any_mark and (found := self.mark.findall(s)):
                    inside = found[-1] in (OPEN, CURLY_OPEN)
            paras.append(x)
        return t, paras, gaps, quotes, sents

    def features(self, text: str | None, taught: Iterable[str] | None) -> tuple[int, int, list, list, list]:
        return self.all_features([text], [taught])[0]

    def all_features(self, texts: list[str | None], taught: list[Iterable[str] | None], extras: tuple[str, ...] = EXTRAS) -> list[tuple[int, int, list, list | None, list | None]]:
        """Of each text: _n, the number of sentences, the values of STYLE and DISCOURSE in their order, stems and analytical verbs,
        the last two if they are among the extras."""
        if len(self.vocab) > KEPT[0]:
            self.forget_words()
        if len(self.seen) + len(self.quoting) > KEPT[1]:
            self.forget_sentences()
        split = [self.split(t) for t in texts]
        new = {s[0]: None for x in split for s in x[-1] if s[0] not in self.seen}
        raw = dict(zip(new, map(self.word.findall, new)))
        if unknown := [x for x in dict.fromkeys(x for w in raw.values() for x in w) if x not in self.vocab]:
            self.learn(unknown)
        self.seen.update({s: self.sentence(s, w) for s, w in raw.items()})
        return [self.told(*x, k, extras) for x, k in zip(split, taught)]

    def told(self, t, paras, gaps, quotes, found, taught, extras) -> tuple[int, int, list, list, list]:
        seen, ids = self.seen, self.ids
        sizes = [0] * len(paras)
        for f in found:
            sizes[f[1]] += 1
        sents = [(seen[s], p, i, sizes[p], s) for s, p, i, _, _ in found]
        words = list(chain.from_iterable([s[0][18] for s in sents]))
        n = len(words)
        here, verbs = self.extra(words, extras)
        style = self.style(t, words, np.fromiter(map(ids.__getitem__, words), np.int64, n), n, sents, paras, gaps, quotes, taught, found) if n else [None] * len(STYLE)
        return n, len(sents), style + self.discourse(n, sents, paras, quotes), here, verbs

    def extra(self, words: list[str], extras: tuple[str, ...]) -> tuple[list | None, list | None]:
        distinct = set(words)
        here = sorted(set(map(self.stems.__getitem__, distinct))) if "_stems" in extras else None
        verbs = None if "_verbs" not in extras else [] if self.verbs.isdisjoint(distinct) else list(Counter(x for x in words if x in self.verbs).items())
        return here, verbs

    def plain(self, texts: list[str | None], extras: tuple[str, ...]) -> list[tuple[int, list | None, list | None]]:
        """_n and the extras only, which take no sentences."""
        if len(self.vocab) > KEPT[0]:
            self.forget_words()
        every = ["\n".join(self.word.findall(t or "")).lower() for t in texts]
        every = [x.split("\n") if x else [] for x in every]
        if "_stems" in extras:
            if len(self.stems) > KEPT[0]:
                self.forget_words()
            self.stems.update({x: stem(x) for w in every for x in w if x not in self.stems})
        return [(len(w), *self.extra(w, extras)) for w in every]

    def vocabulary(self, t: str, quotes, sents, found, taught) -> int:
        """Words outside of quotations and taught terms, without capitalized ones that start no sentence, in parts."""
        terms = taught_terms(taught)
        if not terms and not any(m in t for m in (OPEN, CLOSE, CURLY_OPEN, CURLY_CLOSE)):
            out = 0
            for (r, _, _, _, s), (_, _, _, begins, inside) in zip(sents, found):
                if inside:
                    if s not in self.quoting:
                        self.quoting[s] = self.heard(s, True)[0]
                    out += self.quoting[s]
                else:
                    out += r[19] + (r[20] if begins else 0)
            return out
        hollow = self.quote.sub('""', t)
        out = 0
        for m in self.word.finditer(hollow):
            x = m[0]
            if "A" <= x[0] <= "Z" and (k := m.start()) and not self.starts.search(hollow[max(0, k - 3) : k]):
                continue
            if not (terms and (x.lower() in terms or stem(x) in terms)):
                out += self.vocab[x]
        return out

    def transition_count(self, t: str, sents, paras) -> int:
        """Transitions of a text: its sentences', unless one may go on after the end of a paragraph."""
        for (r, p, i, m, s), (_, after, *_) in zip(sents, sents[1:]):
            if after != p and r[18][-1] in self.going_on and s[-1].isalpha():
                return sum(len(self.of_sentence.patterns[k].findall(t.lower())) for k, _ in self.transitions)
        return sum(s[0][21][3] for s in sents)

    def style(self, t, words, got, n, sents, paras, gaps, quotes, taught, found) -> list:
        of, n_s, total = self.of_text, len(sents), self.counted[got].sum(0)
        lists = dict(zip(LISTS, map(int, total)))
        mask = of.always
        for s in sents:
            mask |= s[0][22]
        if of.digits and self.digit.search(t):
            mask |= of.digits
        counts = [sum(x) for x in zip(*(s[0][21][:3] for s in sents))]
        
        def number(k: str) -> int:
            if k not in of.bits:
                return sum(s[0][23].get(k, 0) for s in surfaces)
            if not mask & of.bits[k]:
                return 0
            if k not in self.begun:
                return len(of.patterns[k].findall(t))
            m = self.begun[k][0].match(t)
            return (m is not None) + len(self.begun[k][1].findall(t, m.end() if m else 0))

        surfaces = [s for s in sents if s[0][23]]
        per = lambda a, b, unit: 0.0 if b == 0 else float(a) / b * unit
        lengths = [s[0][0] for s in sents]
        centre = mean(lengths)
        marks = [s[0][1:5] for s in sents]
        shown = [sum(x) for x in zip(*(s[0][7] for s in sents))] or [0] * 6
        known, *sizes = ((v := self.vocabulary(t, quotes, sents, found, taught)) >> k * PART & (1 << PART) - 1 for k in range(4))
        spoken = []
        for q, k in quotes:
            if self.space.search(q):
                before = t[max(0, k - 40) : k]
                says = bool(self.reporting.search(before) or self.colon_ends.search(before))
                spoken.append((says, bool(self.woven.search(before)) and not says))
        after = paras[1:]
        slips = shown[5]
        if any(s[0][24] for s in sents):
            slips += sum(x == "i" or x.lower() in self.misspelt for g in gaps for x in self.word.findall(g))
        both = lists["basic"] + lists["advanced"]
        spread = sd(lengths, centre)
        out = {
            "meanSentenceLength": centre, "medianSentenceLength": median(lengths), "sentenceLengthSD": spread,
            "clauseDensity": mean([1 + a + b + c for a, b, c, _ in marks]), "subordinateRate": mean([a + b for a, b, _, _ in marks]), "coordinationRate": mean([c for _, _, c, _ in marks]),
            "fragmentRate": per(sum(x <= 4 for x in lengths), n_s, 100), "rhetoricalQuestionRate": per(shown[0], n_s, 100), "openerVariety": per(len({s[0][5] for s in sents}), n_s, 100),
            "patternRepetition": per(n_s - len({s[0][6] for s in sents}), n_s, 100), "mattr": mattr(got, n), "ttr300": len(set(words[:300])) / min(n, 300),
            "rareWordRate": per(sizes[0], known, 100), "academicRate": per(sizes[1], known, 100), "longWordRate": per(sizes[2], known, 100), "abstractNounRate": per(counts[0], n, 100),
            "modifierDensity": per(int(total[-1]), n, 100), "advancedVerbShare": per(lists["advanced"], both, 100) if both >= 2 else None, "hedgingRate": per(lists["hedging"], n, 1000),
            "intensifierRate": per(lists["intensifier"], n, 1000), "modalRate": per(lists["modal"], n, 100), "transitionRate": per(self.transition_count(t, sents, paras), n, 100), "repeatedPhraseRate": per(repeated(got), n, 1000),
            "embedding": mean([a + b + d for a, b, _, d in marks]), "passiveRate": per(shown[1], n_s, 100), "nominalizationRate": per(counts[1], n, 100), "prepDensity": per(lists["prep"], n, 100),
            "introClauseRate": per(shown[2], n_s, 100), "participialRate": per(shown[3], n_s, 10), "semicolonRate": per(t.count(";"), n, 1000), "colonRate": per(len(self.colon.findall(t)), n, 1000),
            "dashRate": per(sum(map(t.count, ("—", "–", " - ", "--"))), n, 1000), "parentheticalRate": per(len(self.paren.findall(t)), n, 1000), "firstPersonRate": per(lists["first"], n, 100),
            "quoteIntroSays": per(sum(a for a, _ in spoken), len(spoken), 100) if len(spoken) >= 2 else None, "quoteIntegrated": per(sum(b for _, b in spoken), len(spoken), 100) if len(spoken) >= 2 else None,
            "paragraphOpenerTransition": per(sum(bool(self.opener.match(p[:64].lower())) for p in after), len(after), 100) if len(after) >= 2 else None, "certaintyRate": per(lists["certainty"], n, 1000),
            "evaluativeRate": per(lists["evaluative"], n, 1000), "qualificationRate": per(shown[4], n_s, 100), "mechanicsRate": per(slips, n, 1000), "contractionRate": per(counts[2], n, 100),
            "surface_uniformity": spread / max(1.0, centre) if n_s >= 5 else None,
        }
        return [per(number(f.id), n, 1000) if f.id not in out else out[f.id] for f in STYLE]

    def discourse(self, n_words, sents, paras, quotes) -> list:
        n_p, n = len(paras), len(sents)
        moves = [self.move(r, p, i, m, n_p) for r, p, i, m, _ in sents]
        tags, levels = [s[0][8] for s in sents], [s[0][9] for s in sents]
        does = lambda k, x: moves[k] == x or x in tags[k]
        by: list[list[str]] = [[] for _ in paras]
        for m, s in zip(moves, sents):
            by[s[1]].append(m)
        flow = [(len(set(m)), sum(not k or x != m[k - 1] for k, x in enumerate(m))) for m in by]
        body = flow[1:-1] if n_p >= 3 else flow
        shaped = body if len(body) >= 2 else flow
        chains = [self.chain(k, sents, moves, tags, levels) for k, m in enumerate(moves) if m == "evidence"]
        number = lambda *m: float(sum(x in m for x in moves))
        claims, evidence, around = number("claim", "thesis"), number("evidence"), max(1, n_p)
        analysis = [s[0] for s, m in zip(sents, moves) if m in ("explanation", "reasoning", "implication", "qualification")]
        proofs = [s[0] for k, s in enumerate(sents) if does(k, "evidence")]
        parts = [k for q, _ in quotes if (k := len(self.space.findall(q)) + 1) >= 2]
        words = lambda s: frozenset(self.content.findall(s.lower())) - self.stop
        said = [words(s[4]) for s, m in zip(sents, moves) if m == "claim"]
        thesis = next((words(s[4]) for s, m in zip(sents, moves) if m == "thesis"), frozenset())
        share = lambda test: sum(map(test, levels)) * 100.0 / n if n else None
        part = lambda a, test, least: sum(map(test, a)) * 100.0 / len(a) if len(a) >= least else None
        six = n >= 6
        out = {
            "movesPerParagraph": mean([a for a, _ in shaped]) if flow and six else None, "chainLength": mean([b for _, b in shaped]) if flow and six else None,
            "evidencePerClaim": evidence / claims if claims >= 2 else None, "explanationPerEvidence": number("explanation", "reasoning") / evidence if evidence >= 3 else None,
            "qualificationPerParagraph": sum(does(k, "qualification") for k in range(n)) / around if six else None, "counterPerParagraph": number("counterpoint") / around if six else None,
            "implicationPerParagraph": sum(does(k, "implication") for k in range(n)) / around if six else None, "summaryShare": number("summary") * 100 / n if six else None,
            "claimRepetition": restated(said, thesis) * 100.0 / len(said) if len(said) >= 3 else None, "abstractionIndex": mean(levels) if n else None,
            "abstractShare": share(lambda x: x == 2), "concreteShare": share(lambda x: x == 0), "reasoningDepth": mean([len(c) for c in chains]) if len(chains) >= 2 else None,
            "techniqueNaming": part(analysis, lambda r: r[12], 4), "thematicLeapRate": part(chains, lambda c: "implication" in c, 3), "quotesPer100": len(parts) * 100.0 / n_words if n_words else None,
            "meanQuoteLength": mean(parts) if len(parts) >= 2 else None, "paraphraseShare": part(proofs, lambda r: not r[13], 3), "evidenceSpecificity": part(proofs, lambda r: r[13] or r[14] or r[16], 3),
            "evidenceTypeDiversity": float(sum(map(any, zip(*(s[0][17] for s in sents))))),
        }
        return [out[f.id] for f in DISCOURSE]

    @staticmethod
    def move(r: tuple, p: int, i: int, m: int, n_p: int) -> str:
        """The primary move of a sentence, as discourse._moved has it."""
        tags = r[8]
        if n_p >= 3 and p == 0:
            return "thesis" if r[10] or i == m - 1 else "context"
        if n_p >= 3 and p == n_p - 1:
            return "conclusion" if i == 0 else "implication" if "implication" in tags else "qualification" if "qualification" in tags else "conclusion"
        if i == 0 and "evidence" not in tags:
            return "claim"
        return tags[0] if tags else "summary" if r[15] and not r[11] else "explanation"

    @staticmethod
    def chain(k: int, sents, moves, tags, levels) -> set[str]:
        """The steps after a piece of evidence, as discourse._chain has them."""
        found = {"technique"} if sents[k][0][12] else set()
        for j in range(k + 1, len(sents)):
            move, tag = moves[j], tags[j]
            if sents[j][1] != sents[k][1] or move in ("evidence", "claim") or len(found) == len(STEPS):
                break
            does = lambda x: move == x or x in tag  # noqa: B023, E731
            for step, yes in (("interpretation", does("explanation") or does("reasoning") or move == "summary"), ("technique", sents[j][0][12]), ("context", does("context")), ("qualification", does("qualification") or does("counterpoint")), ("implication", does("implication") or levels[j] == 2)):
                if yes:
                    found.add(step)
        return found


def mean(a: list) -> float:
    return sum(a) / len(a) if a else 0.0


def sd(a: list, centre: float) -> float:
    squares = 0.0
    for x in a:
        squares += (x - centre) * (x - centre)
    return math.sqrt(squares / (len(a) - 1)) if len(a) >= 2 else 0.0


def median(a: list) -> float:
    s, k = sorted(a), len(a) // 2
    return 0.0 if not a else float(s[k]) if len(a) % 2 else (s[k - 1] + s[k]) / 2


def mattr(got: np.ndarray, n: int) -> float:
    """style._mattr over the numbers of words."""
    if n <= WINDOW:
        return len(np.unique(got)) / n
    order = np.argsort(got, kind="stable")
    last = np.full(n, -1)
    same = got[order[1:]] == got[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    k = np.arange(n)
    firsts = np.maximum(0, np.minimum(k, n - WINDOW) - np.maximum(np.maximum(0, k - (WINDOW - 1)), last + 1) + 1)
    return float(firsts.sum()) / (WINDOW * (n - WINDOW + 1))


def repeated(got: np.ndarray) -> int:
    """Number of runs of three words that occur more than once."""
    if len(got) < 4:
        return 0
    s = np.sort(got[:-2] << 42 | got[1:-1] << 21 | got[2:])
    same = s[1:] == s[:-1]
    return int(same[0]) + int((same[1:] & ~same[:-1]).sum())


def restated(claims: list[frozenset], thesis: frozenset) -> int:
    """Claims that are like the thesis or like another claim."""
    like = lambda a, b: (both := len(a & b)) / max(1, len(a) + len(b) - both) >= SAME_CLAIM
    times = Counter(claims)
    by: dict[str, list[frozenset]] = {}
    for c in times:
        for w in c:
            by.setdefault(w, []).append(c)

    def told(c: frozenset) -> bool:
        return like(c, thesis) or times[c] > 1 and bool(c) or any(like(c, o) for o in {o for w in c for o in by[w]} if o != c)

    return sum(k for c, k in times.items() if told(c))


_BY_LAST = {k: tuple(s for s in lx.STEM_SUFFIXES if s[-1] == k) for k in {s[-1] for s in lx.STEM_SUFFIXES}}


def stem(word: str) -> str:
    w = word.lower()
    if not w.isalpha():
        w = w.replace("’", "'").removesuffix("'s")
    for s in _BY_LAST.get(w[-1:], ()):
        if w.endswith(s) and len(w) - len(s) >= 4:
            return w[: -len(s)]
    return w


def syllables(word: str) -> int:
    w = re.sub("[^a-z]", "", word.lower())
    core = re.sub(r"\Ay", "", re.sub(r"(?:[^laeiouy]es|ed|[^laeiouy]e)\Z", "", w))
    return 0 if not w else 1 if len(w) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", core)))


def taught_terms(terms: Iterable[str] | None) -> set[str]:
    found = {w for t in terms or () if t is not None for w in re.split("[^a-zÀ-ɏ']+", t.lower()) if len(w) > 2}
    return found | {stem(w) for w in found}


@lru_cache(1)
def _engine(lexicon: lx.Lexicon) -> Engine:
    return Engine(lexicon)


_TYPES = {"_stems": T.ArrayType(T.StringType()), "_verbs": T.MapType(T.StringType(), T.IntegerType())}
_ARROW = {"_stems": pa.list_(pa.string()), "_verbs": pa.map_(pa.string(), pa.int32())}


def all_features(df: DataFrame, text: str = "text", taught: str | None = None, lexicon: lx.Lexicon | None = None, extras: tuple[str, ...] = EXTRAS) -> DataFrame:
    """df with a column for each feature of STYLE and DISCOURSE, word_count, sentences, and of the extras _stems (distinct, of all
    words) and _verbs (map of analytical verbs to counts): the values of style_features() and discourse_features(). A null text
    is an empty one, as there; an empty table stays empty."""
    lexicon = lexicon or lx.Lexicon()
    names = [f.id for f in (*STYLE, *DISCOURSE)]
    schema = T.StructType([*df.schema.fields, *[T.StructField(k, T.DoubleType()) for k in names], *[T.StructField(k, T.IntegerType()) for k in ("word_count", "sentences")], *[T.StructField(k, _TYPES[k]) for k in extras]])

    return df.mapInArrow(_run(lexicon, text, taught, names, extras), schema)


def words_only(df: DataFrame, text: str = "text", extras: tuple[str, ...] = EXTRAS) -> DataFrame:
    """df with word_count and the extras, as all_features() has them."""
    schema = T.StructType([*df.schema.fields, T.StructField("word_count", T.IntegerType()), *[T.StructField(k, _TYPES[k]) for k in extras]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(lx.Lexicon())
        for whole in batches:
            for b in _slices(whole, whole.column(text)):
                rows = engine.plain(b.column(text).to_pylist(), extras)
                made = [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1 + EXTRAS.index(k)] for r in rows], _ARROW[k]) for k in extras]]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "word_count", *extras])

    return df.mapInArrow(run, schema)


def _slices(whole: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows in their order, so many and of so many characters at a time, but one at least."""
    at = size = 0
    for k, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if k > at and (k - at == TEXTS[0] or size + (n or 0) > TEXTS[1]):
            yield whole.slice(at, k - at)
            at, size = k, 0
        size += n or 0
    if whole.num_rows > at:
        yield whole.slice(at)


def _run(lexicon: lx.Lexicon, text: str, taught: str | None, names: list[str], extras: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(lexicon)
        for whole in batches:
            for b in _slices(whole, whole.column(text)):
                terms = b.column(taught).to_pylist() if taught else [None] * b.num_rows
                rows = engine.all_features(b.column(text).to_pylist(), terms, extras)
                values = list(zip(*(r[2] for r in rows)))
                made = [pa.array(v, pa.float64()) for v in values]
                made += [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[3 + EXTRAS.index(k)] for r in rows], _ARROW[k]) for k in extras]]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names, "word_count", "sentences", *extras])

    return run
