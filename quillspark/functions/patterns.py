r"""Patterns with ASCII word boundaries and Unicode white space, compiled for Spark and for RE2.

In the dialect \b and \w are about ASCII letters, digits and the underscore, \s is any Unicode white space, ^ and $ are the
ends of the whole input. Java's \b follows Unicode letters, its \s is ASCII and its $ stops before a final newline, so the
three are spelled out. A \b always stands beside something that begins or ends with a word character: at the start of a
pattern or branch, or before a letter, \w or a group, it asks that none comes before; elsewhere that none follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_TOKEN = re.compile(r"\\.|\[\^?|\]|\$|[^\\\[\]$]+")


def java(pattern: str, case: bool = True) -> str:
    """For Spark's rlike, regexp_count and their kind."""
    out, inside = [], False
    tokens = _TOKEN.findall(pattern)
    for k, t in enumerate(tokens):
        if t.startswith("["):
            inside = True
            out.append(t)
        elif t == "]":
            inside = False
            out.append(t)
        elif t == r"\b" and not inside:
            opens = not k or tokens[k - 1].endswith(("|", "(", ":", "!", "=", "<"))
            out.append(BEFORE if opens or (k + 1 < len(tokens) and (tokens[k + 1] == r"\w" or tokens[k + 1][0].isalnum() or tokens[k + 1][0] == "(")) else AFTER)
        elif t == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif t == r"\S" and not inside:
            out.append(f"[^{SPACES}]")
        elif t == "$" and not inside:
            out.append(r"\z")
        else:
            out.append(t)
    return ("" if case else "(?i)") + "".join(out)


def re2(pattern: str, case: bool = True) -> str:
    """For DuckDB; the text of a SQL literal, quotes doubled."""
    return (("" if case else "(?i)") + pattern.replace("$", r"\z")).replace("'", "''")


def has(text: Column, pattern: str, case: bool = True) -> Column:
    return text.rlike(java(pattern, case))


def count(text: Column, pattern: str, case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, case)))


def replaced(text: Column, pattern: str, by: str, case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, case), by)


def matches(text: Column, pattern: str, group: int = 0, case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, case)), F.lit(group))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")
