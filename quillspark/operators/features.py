"""The catalogue of features: what each is called, how it is grouped and how much it may count."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Feature:
    """unit decides rare-event damping; min_spread is the least spread of a writer's values; direction, for process features,
    the only one that counts; weak features carry little weight and never lead."""

    id: str
    category: str
    group: str
    label: str
    unit: str
    digits: int
    min_spread: float
    weight: float = 1.0
    weak: bool = False
    direction: str = ""


SENTENCES, WORDS100, WORDS1000, FINAL = "% of sentences", "per 100 words", "per 1,000 words", "per 100 final words"

# Identifiers, groups, units, digits and least spreads.
_STYLE = [
    ("meanSentenceLength", "sentence", "words", 1, 2.5), ("medianSentenceLength", "sentence", "words", 0, 2.5), ("sentenceLengthSD", "sentence", "words (SD)", 1, 2),
    ("clauseDensity", "sentence", "", 2, 0.25), ("subordinateRate", "sentence", "per sentence", 2, 0.15), ("coordinationRate", "sentence", "per sentence", 2, 0.1),
    ("fragmentRate", "sentence", SENTENCES, 0, 4), ("rhetoricalQuestionRate", "sentence", SENTENCES, 0, 3), ("openerVariety", "sentence", "% distinct", 0, 6),
    ("patternRepetition", "sentence", SENTENCES, 0, 6), ("mattr", "lexical", "", 3, 0.03), ("ttr300", "lexical", "", 3, 0.04), ("rareWordRate", "lexical", "% of words", 1, 1.5),
    ("academicRate", "lexical", "% of words", 1, 1.2), ("longWordRate", "lexical", "% of words", 1, 2), ("abstractNounRate", "lexical", WORDS100, 2, 0.5),
    ("modifierDensity", "lexical", WORDS100, 1, 1), ("advancedVerbShare", "lexical", "% of analytical verbs", 0, 10), ("hedgingRate", "lexical", WORDS1000, 1, 4),
    ("intensifierRate", "lexical", WORDS1000, 1, 3), ("modalRate", "lexical", WORDS100, 2, 0.5), ("transitionRate", "lexical", WORDS100, 2, 0.5),
    ("repeatedPhraseRate", "lexical", WORDS1000, 1, 3), ("embedding", "syntax", "markers per sentence", 2, 0.2), ("passiveRate", "syntax", SENTENCES, 0, 5),
    ("nominalizationRate", "syntax", WORDS100, 1, 0.8), ("prepDensity", "syntax", WORDS100, 1, 1.2), ("introClauseRate", "syntax", SENTENCES, 0, 6),
    ("participialRate", "syntax", "per 10 sentences", 1, 1), ("semicolonRate", "syntax", WORDS1000, 1, 1.5), ("colonRate", "syntax", WORDS1000, 1, 1.5),
    ("dashRate", "syntax", WORDS1000, 1, 1.5), ("parentheticalRate", "syntax", WORDS1000, 1, 1.5), ("firstPersonRate", "voice", WORDS100, 2, 0.4),
    ("quoteIntroSays", "voice", "% of quotations", 0, 12), ("quoteIntegrated", "voice", "% of quotations", 0, 12), ("paragraphOpenerTransition", "voice", "% of paragraphs", 0, 15),
    ("certaintyRate", "voice", WORDS1000, 1, 3), ("evaluativeRate", "voice", WORDS1000, 1, 4), ("qualificationRate", "voice", SENTENCES, 0, 7),
    ("mechanicsRate", "mechanics", WORDS1000, 1, 3), ("contractionRate", "mechanics", WORDS100, 2, 0.4),
]
_SURFACE = ["genericTransitions", "notOnlyButAlso", "importantToNote", "genericConclusion", "repetitiveQualification", "signposting"]
_DISCOURSE = [
    ("movesPerParagraph", "architecture", "moves", 1, 0.5), ("chainLength", "architecture", "steps", 1, 0.8), ("evidencePerClaim", "architecture", "ratio", 1, 0.5),
    ("explanationPerEvidence", "architecture", "ratio", 1, 0.4), ("qualificationPerParagraph", "architecture", "per paragraph", 2, 0.5),
    ("counterPerParagraph", "architecture", "per paragraph", 2, 0.25), ("implicationPerParagraph", "architecture", "per paragraph", 2, 0.3),
    ("summaryShare", "architecture", SENTENCES, 0, 8), ("claimRepetition", "architecture", "% of claims", 0, 15), ("abstractionIndex", "abstraction", "index 0–2", 2, 0.15),
    ("abstractShare", "abstraction", SENTENCES, 0, 8), ("concreteShare", "abstraction", SENTENCES, 0, 8), ("reasoningDepth", "reasoning", "steps", 1, 0.6),
    ("techniqueNaming", "reasoning", "% of analysis sentences", 0, 10), ("thematicLeapRate", "reasoning", "% of evidence", 0, 15), ("quotesPer100", "evidence", WORDS100, 2, 0.4),
    ("meanQuoteLength", "evidence", "words", 1, 4), ("paraphraseShare", "evidence", "% of evidence", 0, 15), ("evidenceSpecificity", "evidence", "% of evidence", 0, 15),
    ("evidenceTypeDiversity", "evidence", "types", 0, 1.5),
]
_PROCESS = [
    ("activeMinutes", "process", "minutes", 0, 8, "down", 0.6), ("sessions", "process", "sessions", 0, 1, "down", 0.5), ("typingRate", "process", "words per active minute", 1, 4, "up", 0.8),
    ("revisionDensity", "process", FINAL, 1, 1.2, "down", 1.0), ("surfaceEditRate", "process", FINAL, 1, 1.5, "down", 0.5), ("firstDraftShare", "process", "% of final text", 0, 10, "up", 1.0),
    ("retention", "process", "% of text written", 0, 6, "up", 0.7), ("longestContinuous", "process", "words", 0, 60, "up", 0.9), ("continuousShare", "process", "% of final text", 0, 12, "up", 1.0),
    ("pastedShare", "external", "% of final text", 0, 8, "up", 1.0), ("largestInsertion", "external", "words", 0, 30, "up", 1.0), ("pasteEvents", "external", "events", 0, 1, "up", 0.6),
    ("multiParagraphPastes", "external", "events", 0, 0.8, "up", 0.8),
]


def _label(name: str) -> str:
    """Words of a camel-case identifier."""
    out = "".join(f" {c.lower()}" if c.isupper() and not name[k - 1].isupper() else c for k, c in enumerate(name.replace("_", " ")))
    return out[0].upper() + out[1:]


STYLE = [Feature(i, "style", g, _label(i), u, d, m) for i, g, u, d, m in _STYLE]
STYLE += [Feature(f"surface_{i}", "style", "surface", _label(i), WORDS1000, 1, 2, 0.25, True) for i in _SURFACE]
STYLE.append(Feature("surface_uniformity", "style", "surface", "Uniform sentence lengths", "variation", 2, 0.08, 0.25, True))
DISCOURSE = [Feature(i, "discourse", g, _label(i), u, d, m, 0.8) for i, g, u, d, m in _DISCOURSE]
PROCESS = [Feature(i, c, c, _label(i), u, d, m, w, False, way) for i, c, u, d, m, way, w in _PROCESS]
ALL = STYLE + DISCOURSE + PROCESS
BY_ID = {f.id: f for f in ALL}
CATEGORIES = [("style", "Style"), ("discourse", "Discourse"), ("process", "Process"), ("external", "External insertion")]
LEVELS = ["LOW", "MODERATE", "MODERATE-HIGH", "HIGH", "VERY HIGH"]
SEGMENTS = [2, 4, 6, 8, 10]
