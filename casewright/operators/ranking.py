"""Exact ranks and running totals without one task holding a whole group.

A window over a class or a model would sort all its rows in one task. Here a
group is first cut into ordered buckets; the window runs inside a bucket and
the totals of the buckets before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources.storage import written


def seeded_hash(seed: int, key: str) -> F.Column:
    """Reproducible pseudo-random order of a key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def seeded_rank(
    df: DataFrame, strata: Sequence[str], key: str, seed: int, hex_digits: int = 3
) -> DataFrame:
    """Add ``rank`` (from 1, in seeded random order) and ``size`` per stratum.

    The first hash digits are evenly spread, so each of the 16^hex_digits
    buckets of a stratum holds about the same number of rows.
    """
    strata = list(strata)
    hashed = df.withColumn("_hash", seeded_hash(seed, key)).withColumn(
        "_bucket", F.substring("_hash", 1, hex_digits)
    )
    sizes = hashed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias("size"),
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*strata, "_bucket"])
        .withColumn("rank", (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_hash", "_bucket", "_inside", "_before")
    )


def running_totals(
    df: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str], descending: bool = False
) -> DataFrame:
    """Running totals of the measures over ``value`` within each group.

    ``df`` holds one row per (group, value), that is, equal values are already
    summed. Adds ``cum_<m>`` and ``total_<m>``. Rows are cut into parts by a
    range partitioning on group and value: its bounds are quantiles, so parts
    are even however the values crowd, and the totals do not depend on them.
    """
    groups, measures = list(groups), list(measures)
    # The totals and the rows below both read the cut table, so it is written.
    cut = written(
        df.select(*groups, value, *measures)
        .repartitionByRange(*groups, value)
        .withColumn("_part", F.spark_partition_id()),
        "running_totals",
    )
    parts = cut.groupBy(*groups, "_part").agg(*[F.sum(m).alias(f"_{m}") for m in measures])

    def order(name: str) -> F.Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    earlier = (
        Window.partitionBy(*groups)
        .orderBy(order("_part"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(
        *groups,
        "_part",
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_{m}").over(Window.partitionBy(*groups)).alias(f"total_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*groups, "_part")
        .orderBy(order(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.select(
            *groups, value, *measures, "_part",
            *[F.sum(m).over(inside).alias(f"_inside_{m}") for m in measures],
        )
        .join(offsets, [*groups, "_part"])
        .select(
            *groups,
            value,
            *measures,
            *[(F.col(f"_before_{m}") + F.col(f"_inside_{m}")).alias(f"cum_{m}") for m in measures],
            *[f"total_{m}" for m in measures],
        )
    )
