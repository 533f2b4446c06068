"""Seeded splits, folds, samples and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.operators.ranking import seeded_hash, seeded_rank


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = "label",
    seed: int = lx.SEED,
    test_share: float = lx.TEST_SHARE,
    val_share: float = lx.VAL_SHARE,
) -> DataFrame:
    """Add ``split``: exact shares per class, the rest is training data."""
    n_test = F.round(F.col("size") * test_share)
    n_val = F.round(F.col("size") * val_share)
    split = (
        F.when(F.col("rank") <= n_test, F.lit("test"))
        .when(F.col("rank") <= n_test + n_val, F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return seeded_rank(df, [label], key, seed).withColumn("split", split).drop("rank", "size")


def stratified_kfold(
    df: DataFrame, key: str, label: str = "label", seed: int = lx.SEED, folds: int = lx.FOLDS
) -> DataFrame:
    """Add ``fold`` from 1, spread evenly within each class."""
    fold = ((F.col("rank") - 1) % folds + 1).cast("int")
    return seeded_rank(df, [label], key, seed).withColumn("fold", fold).drop("rank", "size")


def repeated_kfold(
    df: DataFrame,
    key: str,
    label: str = "label",
    seeds: Sequence[int] = tuple(lx.FOLD_SEEDS),
    folds: int = lx.FOLDS,
) -> DataFrame:
    """Folds for several seeds, one row per document and seed."""
    parts = [
        stratified_kfold(df, key, label, seed, folds).withColumn("seed", F.lit(seed)) for seed in seeds
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_membership(df: DataFrame, key: str, members: dict[str, DataFrame]) -> DataFrame:
    """Tag rows by which key list holds them; rows in none are ``unused``."""
    tagged = [keys.select(key, F.lit(name).alias("split")) for name, keys in members.items()]
    listed = tagged[0]
    for part in tagged[1:]:
        listed = listed.unionByName(part)
    joined = df.join(listed, key, "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("unused")))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class), from one row per class."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumn(
        "weight",
        F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")),
    )


def majority_class(train: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label; ties go to the smallest name."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(1)


def background_sample(df: DataFrame, key: str, size: int = 200, seed: int = lx.SEED) -> DataFrame:
    """A reproducible sample: the rows that come first in seeded order."""
    return df.orderBy(seeded_hash(seed, key), key).limit(size)
