"""A join on a key that a third of all rows may share, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000      # a key with fewer rows is never hot
HOT_KEYS = 10_000     # and no more keys than this are ever broadcast


def hot_bound(total: int) -> int:
    """Rows beyond which a key is hot; as ``total`` rows exist, at most ``HOT_KEYS`` keys are."""
    return max(HOT_ROWS, total // HOT_KEYS)


def left_join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per ``key``; null where it has none.

    ``facts[size]`` says how many of the ``total`` rows carry a key. The hot keys, at most
    ``HOT_KEYS`` by the bound, are broadcast and their rows stay where they are; only the
    others are shuffled, where none is large.
    """
    values = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(size) > hot_bound(total))
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*values).alias("_hot"))), key, "left")
    met = marked.filter("_hot is not null").select(*rows.columns, *[F.col(f"_hot.`{v}`").alias(v) for v in values])
    cold = facts.filter(F.col(size) <= hot_bound(total))
    rest = marked.filter("_hot is null").select(*rows.columns).join(cold, key, "left")
    return met.unionByName(rest.select(*met.columns))
