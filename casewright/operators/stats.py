"""Corpus statistics and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions.rows import struct_rows


def corpus_totals(docs: DataFrame, size: str = "size_bytes") -> DataFrame:
    return docs.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum(size) / F.lit(1e6), F.lit(0.0)).alias("total_mb"),
        (F.avg(size) / F.lit(1e3)).alias("mean_kb"),
    )


def distribution(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Count and share per value. The window runs over the distinct values only."""
    name = alias or column
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") / total * 100)


def top_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(limit)


def label_distribution(
    df: DataFrame, label: str = "label", classes: Sequence[str] = tuple(lx.LABELS)
) -> DataFrame:
    """Count and share per class in the given order; empty classes show 0."""
    spark = df.sparkSession
    order = {c: i for i, c in enumerate(classes)}
    zeros = spark.range(len(classes)).select(
        F.get(F.array(*[F.lit(c) for c in classes]), F.col("id").cast("int")).alias("label"),
        F.lit(0).cast("long").alias("n"),
    )
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    position = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    merged = (
        counts.filter(F.col("label").isin(list(classes)))
        .unionByName(zeros)
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return merged.select(
        position[F.col("label")].alias("position"),
        "label",
        "n",
        F.coalesce(F.try_divide(F.col("n") * 100, total), F.lit(0.0)).cast("double").alias("pct"),
    )


def flag_sums(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(f).alias(f) for f in flags])


def token_audit(df: DataFrame, limit: int = lx.TOKEN_LIMIT) -> DataFrame:
    over = F.count_if(F.col("token_count") > limit)
    return df.agg(
        F.count("*").alias("n_docs"),
        over.alias("over_limit"),
        (over / F.count("*") * 100).alias("over_limit_pct"),
        F.avg("token_count").alias("mean_tokens"),
    )


def mask_audit(df: DataFrame, count: str = "outcome_mask_count") -> DataFrame:
    return df.agg(
        F.sum(count).alias("total_masks"),
        F.count_if(F.col(count) > 0).alias("docs_with_masks"),
    )


def skew_flags(df: DataFrame, label: str = "label") -> DataFrame:
    """Classes under the share limit, and classes with too few rows."""
    return distribution(df, label, "label").select(
        "label",
        "n",
        "pct",
        (F.col("pct") < lx.SKEW_SHARE_PCT).cast("int").alias("is_skewed"),
        (F.col("n") < lx.RARE_CASES).cast("int").alias("is_rare"),
        (F.col("n") < lx.LOW_SIGNAL_ROWS).cast("int").alias("is_low_signal"),
    )


def overlong_flag(audit: DataFrame) -> DataFrame:
    return audit.withColumn(
        "needs_long_model", (F.col("over_limit_pct") > lx.OVERLONG_PCT).cast("int")
    )


def stats_report(metadata: DataFrame, years: int = 10) -> DataFrame:
    """All corpus statistics as one long table ``(section, item, n, value)``."""
    def section(name: str, df: DataFrame, item: str, value: str | None = None) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"),
            F.col(item).alias("item"),
            F.col("n").cast("long").alias("n"),
            (F.col(value) if value else F.lit(None)).cast("double").alias("value"),
        )

    none = F.lit(None)
    totals = corpus_totals(metadata).select(
        F.inline(
            struct_rows(
                ["item", "n", "value"],
                [F.lit("files"), F.col("n_files"), none.cast("double")],
                [F.lit("total_mb"), none.cast("long"), F.col("total_mb")],
                [F.lit("mean_kb"), none.cast("long"), F.col("mean_kb")],
            )
        )
    )
    greenwash = metadata.agg(F.coalesce(F.sum("is_greenwash"), F.lit(0)).alias("n")).select(
        F.lit("greenwash").alias("item"), "n",
        (F.col("n") < lx.RARE_CASES).cast("double").alias("value"),
    )
    return (
        section("totals", totals, "item", "value")
        .unionByName(section("pillar", distribution(metadata, "inferred_pillar", "item"), "item", "pct"))
        .unionByName(section("year", top_values(metadata, "year", years), "year"))
        .unionByName(section("court", distribution(metadata, "court", "item"), "item"))
        .unionByName(section("imbalance", greenwash, "item", "value"))
    )


def describe_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and quartiles per score, two decimals.

    ``percentile`` is exact and keeps one counter per distinct value; a score
    never exceeds the size of its lexicon, so these stay few.
    """
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.percentile(c, [0.25, 0.5, 0.75]).alias("q"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = struct_rows(["score", "s"], *[[F.lit(c), F.col(c)] for c in columns])
    return stats.select(F.inline(rows)).select(
        "score",
        F.col("s.n").alias("count"),
        *[F.round(F.col(f"s.{k}"), 2).alias(k) for k in ("mean", "std", "min")],
        *[F.round(F.col("s.q")[i], 2).alias(k) for i, k in enumerate(("p25", "p50", "p75"))],
        F.round(F.col("s.max"), 2).alias("max"),
    )
