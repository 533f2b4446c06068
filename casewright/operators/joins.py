"""Joins of corpus tables on the file name.

None carries a hint: Catalyst and AQE choose by measured size, and the file
name is unique on the looked-up side, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions.text import outcome_mask_count


def known_labels(df: DataFrame, label: str = "label", labels: Sequence[str] = tuple(lx.LABELS)) -> DataFrame:
    return df.filter(F.col(label).isin(list(labels)))


def class_slice(df: DataFrame, value: str, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == value)


def extension_filter(df: DataFrame, extension: str = ".md", column: str = "filename") -> DataFrame:
    return df.filter(F.col(column).endswith(extension))


def join_labels_inner(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with the labels of the label table; a label on the text side is dropped."""
    return texts.drop("label").join(labels.select("filename", "label"), "filename")


def join_labels_left(texts: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All texts; documents without a label row get empty strings."""
    looked_up = labels.select("filename", *[F.col(c).cast("string") for c in columns])
    joined = texts.join(looked_up, "filename", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def mask_counts(cleaned: DataFrame) -> DataFrame:
    """Audit columns and mask counts. Both come from one table, so one pass does."""
    return cleaned.select(
        "filename", "label", "is_sustainability", "is_greenwash", "token_count", "exceeds_512",
        outcome_mask_count(F.col("cleaned_text")).alias("outcome_mask_count"),
    )


def sorted_listing(df: DataFrame, column: str = "filename") -> DataFrame:
    return df.orderBy(column)
