"""Word tokens and n-grams as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\p{L}\p{N}]{2,}"), 0)


def alpha_tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two or more characters; inner ' and - stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z'\-]+\b"), 0)


def drop_words(terms: Column, words: Sequence[str]) -> Column:
    """Remove the given words, keeping order and repeats."""
    return F.filter(terms, lambda t: ~t.isin(list(words)))


def ngrams(terms: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring terms, joined by a blank."""
    if n == 1:
        return terms
    starts = F.slice(terms, F.lit(1), F.greatest(F.size(terms) - (n - 1), F.lit(0)))
    return F.transform(
        starts,
        lambda t, i: F.concat_ws(" ", t, *[F.get(terms, i + k) for k in range(1, n)]),
    )


def ngram_hashes(terms: Column, n: int) -> Column:
    """A 64-bit hash of each run of ``n`` neighbouring terms, without making the run."""
    starts = F.slice(terms, F.lit(1), F.greatest(F.size(terms) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda t, i: F.xxhash64(t, *[F.get(terms, i + k) for k in range(1, n)]))


def ngram_range(terms: Column, low: int, high: int) -> Column:
    return F.concat(*[ngrams(terms, n) for n in range(low, high + 1)])
