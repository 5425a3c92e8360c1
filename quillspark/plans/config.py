"""Settings of an analysis, with defaults; a saved map of sections changes known keys only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.lexicon import Lexicon
from ..operators.process import ProcessSettings


@dataclass(frozen=True)
class Baseline:
    minimum: int = 3
    preferred: int = 5
    strong: int = 10  # and at least two genres
    min_words: int = 120
    relative_spread: float = 0.12


@dataclass(frozen=True)
class Genres:
    same_type: float = 1.0
    same_genre: float = 0.9
    same_subject: float = 0.7
    different: float = 0.4
    timed_mismatch: float = 0.3


@dataclass(frozen=True)
class Strength:
    moderate: float = 1.75
    high: float = 2.75
    very_high: float = 3.75


@dataclass(frozen=True)
class Trend:
    min_samples: int = 4
    min_fit: float = 0.5


@dataclass(frozen=True)
class Categories:
    moderate: float = 1.5
    moderate_high: float = 2.2
    high: float = 3.0
    very_high: float = 4.0
    top: int = 4


#: Reference mean and spread of process features, for writers without process history.
REFERENCE = {
    "typingRate": (14, 6), "revisionDensity": (4, 2), "firstDraftShare": (55, 15), "retention": (82, 8), "longestContinuous": (140, 80),
    "continuousShare": (20, 15), "pastedShare": (3, 6), "largestInsertion": (35, 30), "pasteEvents": (0.5, 1), "multiParagraphPastes": (0, 0.6),
}


@dataclass(frozen=True)
class Config:
    baseline: Baseline = Baseline()
    genres: Genres = Genres()
    strength: Strength = Strength()
    trend: Trend = Trend()
    categories: Categories = Categories()
    process: ProcessSettings = ProcessSettings()
    reference: dict = field(default_factory=lambda: dict(REFERENCE))
    lexicon: Lexicon = Lexicon()

    def merged(self, saved: dict[str, dict]) -> Config:
        """With the known keys of saved; unknown sections and keys are left out."""
        new = self
        for section, values in saved.items():
            own = getattr(self, section, None)
            if own is None or not isinstance(values, dict):
                continue
            if isinstance(own, dict):
                changed = own | {k: v for k, v in values.items() if k in own}
            else:
                changed = replace(own, **{k: v for k, v in values.items() if hasattr(own, k)})
            new = replace(new, **{section: changed})
        return new
