"""Rule-based labels and their encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.lexicons import CLASSES, LABEL_NAMES


def _argmax_label(scores: Sequence[tuple[str, Column]]) -> Column:
    top = F.greatest(*[score for _, score in scores])
    chain = F.when(top == 0, F.lit("Non-ESG"))
    for name, score in scores[:-1]:
        chain = chain.when(score == top, F.lit(name))
    return chain.otherwise(F.lit(scores[-1][0]))


def infer_pillar(e: Column, s: Column, g: Column) -> Column:
    """Highest score; ties E > S > G; all zero is Non-ESG."""
    return _argmax_label([("E", e), ("S", s), ("G", g)])


def assign_label(e: Column, s: Column, g: Column) -> Column:
    """Highest score; ties G > E > S; all zero is Non-ESG."""
    return _argmax_label([("G", g), ("E", e), ("S", s)])


def signal_strength(e: Column, s: Column, g: Column) -> Column:
    return F.greatest(e, s, g)


def noise_decision(noise_hits: Column, esg_hits: Column, override: int) -> Column:
    """``exclude`` noisy documents with few signals and those with none."""
    noisy = (noise_hits > 0) & (esg_hits < override)
    return F.when(noisy | (esg_hits == 0), F.lit("exclude")).otherwise(F.lit("retain"))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def label_encode(label: Column, classes: Sequence[str] = CLASSES) -> Column:
    """Index in alphabetical class order; null for an unknown label."""
    position = F.array_position(_literals(sorted(classes)), label)
    return F.when(position > 0, position - 1).cast("int")


def label_decode(index: Column, classes: Sequence[str] = CLASSES) -> Column:
    return F.get(_literals(sorted(classes)), index.cast("int"))


def label_display_name(label: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.create_map(*pairs)[label]


def label_slug(label: Column) -> Column:
    return F.replace(label, F.lit("-"), F.lit(""))
