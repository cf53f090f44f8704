"""Regex construction and boolean predicate building.

All patterns reach Spark as *foldable literals* so that ``RLike`` compiles each
one once per task instead of once per row. Flags: ``i`` case-insensitive,
``u`` Unicode case folding (plain ``(?i)`` misses accented pairs such as É/é),
``U`` Unicode character classes so ``\\b``, ``\\w`` and ``\\s`` behave as in
Python 3 ``re`` regardless of the JDK version.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE_CI = "(?iuU)"
UNICODE_CS = "(?U)"


def quote(literal: str) -> str:
    """Quote a literal for java.util.regex (``\\Q…\\E`` with embedded ``\\E`` handled)."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def flags(case_insensitive: bool = True) -> str:
    return UNICODE_CI if case_insensitive else UNICODE_CS


def literal_regex(literal: str, case_insensitive: bool = True, whole_word: bool = True,
                  regex: bool = False, normalize_ws: bool = False) -> str:
    """Literal → (word-bounded, case-insensitive) Java regex."""
    return alternation_regex([literal], case_insensitive, whole_word, regex, normalize_ws)


def _body(alt: str, regex: bool, normalize_ws: bool) -> str:
    if regex:
        return alt
    if normalize_ws:
        return "\\s+".join(quote(p) for p in alt.split(" "))
    return quote(alt)


def alternation_regex(alternatives, case_insensitive: bool = True, whole_word: bool = True,
                      regex: bool = False, normalize_ws: bool = False) -> str:
    """One regex matching if *any* alternative matches (union of match sets, I1).

    ``\\b(?:a|b)\\b`` finds a match exactly where ``\\ba\\b`` or ``\\bb\\b`` does,
    because the engine backtracks into the next alternative when a boundary fails.
    """
    body = "|".join(_body(a, regex, normalize_ws) for a in alternatives)
    core = f"(?:{body})"
    if whole_word:
        core = f"\\b{core}\\b"
    return flags(case_insensitive) + core


def python_regex(pattern: str, case_insensitive: bool = True) -> str:
    """A Python-flavour regex (as in the content filter) with the equivalent Java flags."""
    return flags(case_insensitive) + pattern


# ---------------------------------------------------------------------------
# Boolean bibliographic queries as a predicate tree (no string parser).
# A query is built from Python objects and compiled to one Spark Column.
# ---------------------------------------------------------------------------


class Query:
    def __and__(self, other: "Query") -> "Query":
        return And((self, other))

    def __or__(self, other: "Query") -> "Query":
        return Or((self, other))

    def __invert__(self) -> "Query":
        return Not(self)

    def to_column(self, fields: dict) -> Column:  # pragma: no cover - interface
        raise NotImplementedError


@dataclass(frozen=True)
class Phrase(Query):
    """A phrase in a text field (``[tiab]``); a trailing ``*`` means right truncation.

    ``fields`` maps a field tag to a list of string columns that are searched
    (e.g. ``{"tiab": [title, abstract]}``). Matching is word-bounded and
    case-insensitive; a truncated phrase ``term*`` becomes ``\\bterm\\w*``.
    """

    text: str
    field: str = "tiab"

    def regex(self) -> str:
        t = self.text
        if t.endswith("*"):
            return UNICODE_CI + "\\b" + quote(t[:-1]) + "\\w*"
        return UNICODE_CI + "\\b" + quote(t) + "\\b"

    def to_column(self, fields: dict) -> Column:
        cols = fields[self.field]
        rx = self.regex()
        return reduce(lambda a, b: a | b, [F.coalesce(c.rlike(rx), F.lit(False)) for c in cols])


@dataclass(frozen=True)
class Tag(Query):
    """Exact (case-insensitive) membership in an array field (``[pt]``, ``[MeSH Terms]``)."""

    value: str
    field: str = "pt"

    def to_column(self, fields: dict) -> Column:
        (arr,) = fields[self.field]
        v = self.value.lower()
        return F.coalesce(F.exists(arr, lambda x: F.lower(x) == F.lit(v)), F.lit(False))


@dataclass(frozen=True)
class And(Query):
    parts: tuple

    def to_column(self, fields: dict) -> Column:
        return reduce(lambda a, b: a & b, [p.to_column(fields) for p in self.parts])


@dataclass(frozen=True)
class Or(Query):
    parts: tuple

    def to_column(self, fields: dict) -> Column:
        return reduce(lambda a, b: a | b, [p.to_column(fields) for p in self.parts])


@dataclass(frozen=True)
class Not(Query):
    part: Query

    def to_column(self, fields: dict) -> Column:
        return ~self.part.to_column(fields)


def any_of(*parts: Query) -> Query:
    return Or(tuple(parts))


def all_of(*parts: Query) -> Query:
    return And(tuple(parts))
