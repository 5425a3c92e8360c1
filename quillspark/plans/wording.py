"""Wording of findings. It says what differs, never why, and names nobody's conduct."""

from __future__ import annotations

#: Ordinary reasons, by feature group, for which writing changes.
ALTERNATIVES = {
    "sentence": ["Lessons on combining sentences.", "A different kind of task, for instance against the clock.", "Growth as a writer.", "Help with editing.", "A grammar checker."],
    "lexical": ["Vocabulary that the topic needs.", "Terms taught for the task.", "Word lists or frames that were handed out.", "Reading done for the task.", "A dictionary or thesaurus."],
    "syntax": ["Lessons on punctuation or complex sentences.", "A model text that was followed.", "Help with editing.", "Growth over time."],
    "voice": ["Advice to write in another voice.", "A template for paragraphs.", "Another audience."],
    "mechanics": ["A spelling checker.", "Careful proofreading.", "Another device."],
    "surface": ["Linking words are widely taught.", "A template or frame.", "A model text."],
    "architecture": ["A new way to build essays, from class.", "A rubric that asks for it.", "Planning with somebody.", "Another kind of task."],
    "abstraction": ["Recent lessons on theory.", "Secondary reading.", "A topic that invites general thoughts.", "Growth in analysis."],
    "reasoning": ["A scheme of analysis from class.", "A model text.", "Talk about the text before writing."],
    "evidence": ["Evidence chosen together.", "Research that was allowed.", "Another text or genre."],
    "process": ["A topic that was well prepared.", "Dictation.", "A draft on paper or elsewhere.", "A plan learnt by heart.", "Another place or time to write."],
    "external": ["Own notes or earlier work.", "Material that was handed out.", "Sources, to be cited.", "Joint work.", "Text moved from another document.", "Assistance with writing."],
}
DISCLAIMER = "A deviation describes a change. Teaching, practice, editing, joint work, genre, familiarity with the topic and much else change how people write."
LEADS = {
    "HIGH": "This piece differs from the writer's established profile in several independent ways.",
    "MODERATE": "Some features of this piece differ from the writer's established profile.",
    "LOW": "This piece is largely in line with the writer's established profile.",
    "INCONCLUSIVE": "There is too little to go by: not enough earlier writing, and no record of the process.",
}
NOT_WHY = "This describes a change in the writing or in how it came about. It doesn't say why."
SEVERAL = "Several categories agree."
THIN = "The baseline is too small for a reliable comparison."
#: Never to appear in anything that is written out.
BARRED = ["cheat", "plagiar", "guilty", "dishonest", "fraud", "misconduct", "probability", "% likely", "ai-generated", "suspicio"]
