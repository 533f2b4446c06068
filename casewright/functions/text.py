"""Decoding, cleaning and masking of document text.

The expressions carry Java flags: ``d`` so that only ``\\n`` ends a line, ``U``
for Unicode classes and case, ``i``, ``m`` and ``s`` as usual.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.lexicon import fold_case
from casewright.lexicons import OUTCOME_MASK, OUTCOME_TERMS, OUTCOME_TRIGGERS, TOKEN_LIMIT

# Unicode white space and the four ASCII separators that also split words. Spelt out, as a class
# of listed characters is tested several times faster than the Unicode property.
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NOWHERE = r"\A(?!)"

# --- Fixed values: boilerplate to remove, in this order. ---
HEADER_PATTERNS = [
    r"(?dmU)^.{3,60}\d{1,2}/\d{1,2}/\d{4}\s*$",                      # user and date stamp
    r"(?iU)For Educational Use Only",
    # Publisher notice. A run of blanks is entered at its first one only.
    r"(?isU)(?:©\s*|(?<!\s)\s+|)\d{4}\s*Thomson Reuters\..*?Works\.",
    r"(?dmU)^\d{4} WL \d+\s*$",                                      # citation line
    r"(?iU)Only the Westlaw citation is currently available\.",
    r"(?U)\d+\s+(?:F\.\d[a-z]*|S\.Ct\.|U\.S\.|F\.Supp\.\d*|L\.Ed\.\d*|U\.S\.\s*Dist\.\s*LEXIS)\s+\d+",
    r"(?iU)Case No\.?\s+[\w:\-]+",
    r"(?dmU)^\|\s*$",                                                # lone table bar
    r"(?dmU)^Signed\s+\d{2}/\d{2}/\d{4}\s*$",
    r"(?isU)Attorneys and Law Firms.*?(?=\n[A-Z]{2,}|\z)",           # attorney section
]
# --- End of fixed values. ---

# Letters without a blank that every match of these patterns holds, whatever their case.
_HELD = {HEADER_PATTERNS[i]: held for i, held in ((1, "educational"), (2, "reuters"), (4, "westlaw"), (6, "case"), (9, "attorneys"))}
# Of other patterns every match holds one of these as it stands.
_HELD_AS_IS = {HEADER_PATTERNS[i]: held for i, held in ((0, ["/"]), (3, ["WL"]), (5, ["F.", "S.Ct.", "U.S.", "L.Ed."]), (7, ["|"]), (8, ["Signed"]))}

_MASK = OUTCOME_MASK
_TERMS = "|".join(OUTCOME_TERMS)
# Written from the blank between trigger and term: few characters are blanks,
# so the alternatives are tried rarely. No outcome term ends in the beginning
# of a trigger, hence no earlier match can take part of a later trigger away.
# A trigger ends in a letter, so a run of blanks is entered at its first one only; the look
# at one character before that spares the others the look back.
_CONTEXT = rf"(?iU)(?=\s)(?<!\s)(?=\s+(?:{_TERMS}))(?<={'|'.join(OUTCOME_TRIGGERS)})(\s+)(?:{_TERMS})"
_INITIALS = "".join(sorted({t[0].upper() for t in OUTCOME_TERMS}))
_CAPS = rf"(?U)(?=[{_INITIALS}])\b(?:{_TERMS.upper()})\b"


def decode_utf8(content: Column) -> Column:
    """Text of a UTF-8 file: broken bytes dropped, line ends as ``\\n``."""
    repaired = F.make_valid_utf8(content.cast("string"))
    dropped = F.replace(repaired, F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(dropped, r"\r\n?", "\n")


def _where(needed: Column, pattern: str) -> Column:
    """The pattern for rows in which it can match; the byte search spares the others the regex."""
    return F.when(needed, F.lit(pattern)).otherwise(F.lit(_NOWHERE))


def strip_header_lines(text: Column) -> Column:
    """Replace each kind of boilerplate by a space, in order.

    What is replaced leaves a blank, so letters that stand together did so in the text as it was:
    there they are looked for, once for all patterns.
    """
    folded = fold_case(text)
    held = lambda p: folded.contains(_HELD[p]) if p in _HELD else reduce(or_, [text.contains(h) for h in _HELD_AS_IS[p]])
    return reduce(lambda t, p: F.regexp_replace(t, _where(held(p), p), F.lit(" ")), HEADER_PATTERNS, text)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def collapse_whitespace(text: Column, before: Column | None = None) -> Column:
    """At most one blank line, single blanks, no outer white space.

    ``before`` is the text as it was, if every three line ends that stand together did so there.
    """
    empty = (text if before is None else before).contains("\n\n\n")
    lines = F.regexp_replace(text, _where(empty, r"\n{3,}"), F.lit("\n\n"))
    return trim_space(F.regexp_replace(lines, r"[ \t]{2,}", " "))


def strip_headers(text: Column) -> Column:
    return collapse_whitespace(strip_header_lines(text), text)


def mask_outcome_context(text: Column) -> Column:
    """Mask an outcome term after a trigger word, keeping the trigger."""
    return F.regexp_replace(text, _CONTEXT, f"$1{_MASK}")


def _outcome_named(text: Column) -> Column:
    folded = fold_case(text)
    return reduce(or_, [folded.contains(max(t.lower().split(), key=len)) for t in OUTCOME_TERMS])


def mask_outcome_caps(text: Column) -> Column:
    """Mask outcome terms set in capitals."""
    return F.regexp_replace(text, _CAPS, _MASK)


def mask_outcomes(text: Column) -> Column:
    return mask_outcome_caps(mask_outcome_context(text))


def clean_text(text: Column) -> Column:
    # Outcome terms are letters that stand together, which stripping headers does not make.
    named = _outcome_named(text)
    context = F.regexp_replace(strip_headers(text), _where(named, _CONTEXT), F.lit(f"$1{_MASK}"))
    return F.regexp_replace(context, _where(named, _CAPS), F.lit(_MASK))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Number of white-space tokens, counted without building them."""
    # Printable ASCII is listed first, which settles most characters at once.
    return F.regexp_count(text, F.lit(r"(?U)[!-~[^\s\x1c-\x1f]]++"))


def exceeds_limit(count: Column, limit: int = TOKEN_LIMIT) -> Column:
    return (count > limit).cast("int")


def outcome_mask_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[OUTCOME\]"))


def analysis_text(text: Column) -> Column:
    """Cleaned text without masks and free-standing numbers, on one line."""
    unmasked = F.replace(text, F.lit(_MASK), F.lit(""))
    words = F.regexp_replace(unmasked, r"(?U)(?=\d)\b\d+\b", " ")
    return trim_space(F.regexp_replace(words, rf"(?U){_SPACE}+", " "))


def fill_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def chunk_rows(df: DataFrame, text: str, width: int, stride: int | None = None) -> DataFrame:
    """One row per run of ``width`` tokens, begun every ``stride`` tokens: ``chunk`` from 0, ``chunk_text``.

    A text without tokens has no chunk.
    """
    words = df.select("*", F.explode(F.array(tokens(fill_text(F.col(text))))).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(stride or width))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("_words", i + 1, width), " "))
    return words.select(*df.columns, F.posexplode(cut).alias("chunk", "chunk_text"))


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, limit), " ")
