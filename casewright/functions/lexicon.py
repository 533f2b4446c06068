"""Scoring text against lexicons."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.lexicons import COURTS, YEAR_WINDOW

_LITERAL_BREAK = re.compile(r"\[[^\]]*\]|\\.|[.^$]")


def term_regex(term: str) -> str:
    """Java expression for a lexicon entry, with Unicode word boundaries."""
    if term.endswith("*"):
        return rf"(?U)\b{term[:-1]}"
    return rf"(?U)\b{term}\b"


def required_literal(term: str) -> str | None:
    """Longest text every match of ``term`` must contain, if one is certain."""
    body = term.removesuffix("*")
    if re.search(r"[|?*+{}()]", body):
        return None
    return max(_LITERAL_BREAK.split(body), key=len) or None


def _sql_string(text: str) -> str:
    """Raw SQL literal, in which a backslash stands for itself."""
    quote = '"' if "'" in text else "'"
    return f"r{quote}{text}{quote}"


def term_hit_sql(lowered: str, term: str) -> str:
    """True where the entry occurs. The byte search spares most rows the regex."""
    hit = f"rlike({lowered}, {_sql_string(term_regex(term))})"
    literal = required_literal(term)
    return hit if literal is None else f"(contains({lowered}, {_sql_string(literal)}) AND {hit})"


def lexicon_hits(lowered: str, terms: Sequence[str]) -> Column:
    """Number of distinct entries in a lower-cased column; repeats count once.

    One SQL string per lexicon: built from Python columns, a lexicon takes
    several hundred calls into the JVM and longer to build than to run.
    """
    return F.expr(" + ".join(f"CAST({term_hit_sql(lowered, t)} AS INT)" for t in terms))


def matched_terms(lowered: str, terms: Sequence[str]) -> Column:
    """The entries that occur in a lower-cased column, in lexicon order."""
    found = [f"CASE WHEN {term_hit_sql(lowered, t)} THEN {_sql_string(t)} END" for t in terms]
    return F.expr(f"array_compact(array({', '.join(found)}))")


def extract_year(text: Column, window: int = YEAR_WINDOW) -> Column:
    """Most frequent 20xx near the start; ties go to the first seen."""
    year = F.lit(r"(?U)(?=20)\b(20[0-9]{2})\b")
    years = F.regexp_extract_all(F.substring(text, 1, window), year, 1)
    # 2,000 characters hold at most 400 years, so counting by filter stays cheap.
    ranked = F.transform(
        F.array_distinct(years),
        lambda y: F.struct(
            F.size(F.filter(years, lambda z: z == y)).alias("n"),
            (-F.array_position(years, y)).alias("first"),
            y.alias("year"),
        ),
    )
    return F.coalesce(F.array_max(ranked)["year"], F.lit("unknown"))


# Letters that match an ASCII letter once case is ignored, and those letters.
_CASE_VARIANTS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def fold_case(text: Column, lowered: Column | None = None) -> Column:
    """Lower case in which ASCII phrases are found as by a case-blind search.

    Rare letters aside this is the lower-cased text, which may be passed in.
    """
    unusual = reduce(or_, [text.contains(c) for c in _CASE_VARIANTS])
    plain = F.translate(text, "".join(_CASE_VARIANTS), "".join(_CASE_VARIANTS.values()))
    return F.when(unusual, F.lower(plain)).otherwise(F.lower(text) if lowered is None else lowered)


def detect_court(folded: Column, courts: dict[str, list[str]] = COURTS) -> Column:
    """First court named in case-folded text; else ``Other``."""
    chain = None
    for name, phrases in courts.items():
        named = reduce(or_, [folded.contains(p.lower()) for p in phrases])
        chain = F.when(named, F.lit(name)) if chain is None else chain.when(named, F.lit(name))
    return chain.otherwise(F.lit("Other"))


def flag_greenwash(folded: Column) -> Column:
    return folded.contains("greenwash").cast("int")


def flag_sustainability(score: Column) -> Column:
    return (score > 0).cast("int")
