"""Several output rows from one input row, and columns computed once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def struct_rows(names: Sequence[str], *rows: Sequence[Column]) -> Column:
    """Array of structs with the given field names, for ``inline``."""
    return F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row)]) for row in rows])


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read and never recompute.

    The optimizer moves a filter below a projection and copies the projected
    expression into it, once per mention. For a score over a whole text that
    multiplies the work of the scan. The output of a generator stays where it is.
    """
    named = {f"_{name}": column for name, column in columns.items()}
    kept = df.columns
    computed = df.select(*kept, *[c.alias(n) for n, c in named.items()])
    row = struct_rows(list(columns), [F.col(n) for n in named])
    return computed.select(*kept, F.inline(row))
