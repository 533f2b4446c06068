"""Additive attribution of linear models.

For a linear score the contribution of term j to class k is exactly
``coef[k, j] * (x_j - mean_j)``, and the contributions add up to the score
minus the score of the mean document. Absent terms contribute
``-coef[k, j] * mean_j``; their sum over a whole class is one number, so only
terms that occur need rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.rows import struct_rows
from casewright.operators.features import BROADCAST_ROWS
from casewright.sources.storage import written


def complement_coefficients(
    train_entries: DataFrame,
    vocabulary: DataFrame,
    n_train: Column,
    alpha: float = 0.5,
    label: str = "label",
    classes: Sequence[str] = (),
) -> DataFrame:
    """``(class, index, term, coef, mean_weight)`` of complement naive Bayes, in closed form.

    One aggregate over the training weights gives the sums per class, from
    which follow the coefficients and the mean of every term.
    """
    sums = train_entries.groupBy("index").pivot(label, list(classes)).agg(F.sum("weight"))
    filled = vocabulary.select("index", "term").join(sums, "index", "left")
    by_class = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in classes]
    total = reduce(add, by_class)
    rows = struct_rows(
        ["class", "rest", "mean_weight"],
        *[[F.lit(c), total - s + alpha, total / n_train] for c, s in zip(classes, by_class)],
    )
    long = filled.select("index", "term", F.inline(rows))
    # One row per class: a window would put a class's whole vocabulary in one task.
    whole = long.groupBy("class").agg(F.sum("rest").alias("whole"))
    return long.join(F.broadcast(whole), "class").select(
        "class", "index", "term", (-F.ln(F.col("rest") / F.col("whole"))).alias("coef"), "mean_weight"
    )


def linear_contributions(
    entries: DataFrame, coefficients: DataFrame, key: str, size: int
) -> DataFrame:
    """``(key, class, term, contribution, present)`` for the terms of each document.

    ``contribution`` is ``coef * (x - mean)``; ``present`` is ``coef * x``, whose
    sum with the intercept is the score. ``size`` is the number of rows of
    ``coefficients``, which decides whether they are broadcast.
    """
    table = F.broadcast(coefficients) if size <= BROADCAST_ROWS else coefficients
    return entries.join(table, "index").select(
        key,
        "class",
        "term",
        (F.col("coef") * (F.col("weight") - F.col("mean_weight"))).alias("contribution"),
        (F.col("coef") * F.col("weight")).alias("present"),
    )


def strongest_in_rows(
    rows: DataFrame, coefficients: DataFrame, vocabulary: DataFrame, key: str, classes: Sequence[str], limit: int = 20, digits: int = 6
) -> DataFrame:
    """``(key, class, rank, term, contribution)``: the largest rounded contributions by absolute value.

    The model is one row of arrays by term number, at most the vocabulary's length for each
    class, and every document ranks its own terms, so nothing but the result moves. Equal ones
    go by the term's number, which is alphabetical.
    """
    named = F.array_sort(F.collect_list(F.struct("index", "coef", "mean_weight")))
    arrays = coefficients.groupBy("class").agg(named.alias("m"))
    columns = [F.max(F.when(F.col("class") == c, F.col("m"))).alias(f"_m{i}") for i, c in enumerate(classes)]
    model = arrays.agg(*columns).select(
        F.lit(1).alias("_one"),
        *[F.transform(f"_m{i}", lambda e: e["coef"]).alias(f"_coef{i}") for i in range(len(classes))],
        F.transform("_m0", lambda e: e["mean_weight"]).alias("_mean"),
    )
    v = F.unwrap_udt("features")
    met = rows.select(key, F.arrays_zip(v["indices"].alias("index"), v["values"].alias("weight")).alias("_e"), F.lit(1).alias("_one")).join(
        F.broadcast(written(model, "linear-model")), "_one"
    )

    def best(i: int) -> Column:
        def one(e: Column) -> Column:
            value = F.get(F.col(f"_coef{i}"), e["index"]) * (e["weight"] - F.get(F.col("_mean"), e["index"]))
            return F.struct(e["index"].alias("index"), F.round(value, digits).alias("contribution"))

        told = F.transform("_e", one)
        ordered = F.array_sort(F.transform(told, lambda c: F.struct((-F.abs(c["contribution"])).alias("by"), c["index"].alias("index"), c["contribution"].alias("contribution"))))
        return F.transform(
            F.slice(ordered, 1, limit),
            lambda c, at: F.struct(F.lit(classes[i]).alias("class"), (at + 1).alias("rank"), c["index"].alias("index"), c["contribution"].alias("contribution")),
        )

    ranked = met.select(key, F.inline(F.concat(*[best(i) for i in range(len(classes))])))
    names = vocabulary.select("index", "term")
    return ranked.join(names, "index").select(key, "class", "rank", "term", "contribution")


def base_scores(coefficients: DataFrame) -> DataFrame:
    """Score of the mean document per class, without the intercept."""
    return coefficients.groupBy("class").agg(
        F.sum(F.col("coef") * F.col("mean_weight")).alias("base_score")
    )


def mean_absolute(contributions: DataFrame, coefficients: DataFrame, n_docs: Column) -> DataFrame:
    """Mean absolute contribution per class and term over all documents.

    Documents without the term add ``|coef * mean|`` each; they are counted,
    not listed.
    """
    seen = contributions.groupBy("class", "term").agg(
        F.sum(F.abs("contribution")).alias("_seen"), F.count("*").alias("_n")
    )
    absent = F.abs(F.col("coef") * F.col("mean_weight")) * (n_docs - F.col("_n"))
    return coefficients.join(seen, ["class", "term"]).select(
        "class", "term", ((F.col("_seen") + absent) / n_docs).alias("mean_abs")
    )


def strongest(contributions: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The largest contributions per document and class, by absolute value."""
    order = Window.partitionBy(key, "class").orderBy(F.desc(F.abs("contribution")), F.asc("term"))
    ranked = contributions.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)
