"""Weighted text search over the listing fields.

A listing's fields are reduced to one lower-case line of words per weight class.
A word or phrase matches when it stands in the line between spaces, so matching
stays a plain string test inside generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields in vector order, and what one occurrence weighs.
WEIGHTED_FIELDS = (
    ("title", 1.0),
    ("city", 0.4),
    ("locality", 0.4),
    ("state", 0.4),
    ("bank_name", 0.2),
    ("address", 0.1),
)

_TERM = re.compile(r'(-?)"([^"]*)"|(\S+)')
_SEPARATOR = r"(?U)[^\p{L}\p{N}]+"


def words_line(text: Column) -> Column:
    """`` word word `` in lower case, single spaced, with a space at both ends."""
    return F.concat(
        F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR, " ")), F.lit(" ")
    )


def listing_line() -> Column:
    """All searchable fields of a listing as one line, in vector order."""
    return words_line(F.concat_ws(" ", *[F.col(name) for name, _ in WEIGHTED_FIELDS]))


@dataclass(frozen=True)
class Term:
    phrase: str
    negated: bool


def alternatives(text: str) -> list[list[Term]]:
    """Web-search text: words are required, ``or`` separates alternatives, ``-`` excludes, quotes keep order."""
    groups: list[list[Term]] = [[]]
    for dash, quoted, word in _TERM.findall(text):
        if word.lower() == "or":
            groups.append([])
            continue
        negated = bool(dash) or word.startswith("-")
        phrase = " ".join(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if phrase:
            groups[-1].append(Term(phrase, negated))
    return [group for group in groups if group]


def _has(line: Column, phrase: str) -> Column:
    return line.contains(f" {phrase} ")


def matches(text: str, line: Column) -> Column:
    """True when any alternative holds entirely; text without a single word matches nothing."""
    groups = alternatives(text)
    if not groups:
        return F.lit(False)

    def holds(term: Term) -> Column:
        return ~_has(line, term.phrase) if term.negated else _has(line, term.phrase)

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(holds, group)) for group in groups])


def rank(text: str) -> Column:
    """Weighted count of the wanted phrases over the fields (an ordering, not a database's rank value)."""
    wanted = list(dict.fromkeys(t.phrase for group in alternatives(text) for t in group if not t.negated))
    total = F.lit(0.0)
    for name, weight in WEIGHTED_FIELDS:
        line = words_line(F.col(name))
        for phrase in wanted:
            # Double every gap so that neighbours do not share the space between them.
            doubled = F.replace(line, F.lit(" "), F.lit("  "))
            needle = f" {phrase.replace(' ', '  ')} "
            without = F.length(F.replace(doubled, F.lit(needle), F.lit("")))
            total = total + (F.length(doubled) - without) / F.lit(float(len(needle))) * F.lit(weight)
    return total
