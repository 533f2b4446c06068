"""Quality rules: robust multivariate outliers per language and source.

Four rates of each text (word length, symbols, repeated lines, repeated words) are
transformed so that ordinary texts scatter about evenly. For each language and source
the minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps: keep the share of documents nearest to the present centre, estimate
again from these, until the determinant falls no more. Steps lead to the nearest hollow only, so
a few are made from three starts side by side (medians with median deviations, the classical
estimate, and the correlations of bounded scores), and those with the least determinant go on. A
document far from the centre of its group by Mahalanobis distance is rejected. All of it is
DataFrame expressions; texts are read once, and the steps run on a written table of one narrow row
per document.

Defined results: a null text is empty, a null language or source is the empty string.
Groups with fewer than ``MIN_GROUP`` documents are pooled within their language. Rows are
never merged: repeated rows give repeated results. An empty table gives an empty result.
Columns of the input other than the four named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import let, text_of, words_of, written

MIN_WORDS = 50            # base rule: shorter documents fail
MAX_REPEAT_PCT = 50       # base rule: a larger share of repeated words fails
MIN_GROUP = 50            # smaller groups are pooled within their language
CORE_SHARE = 0.75         # share of a group that the estimate is made from
FIRST_STEPS = 2           # concentration steps from every start
STEPS = 8                 # and at most in all, from the start that is best by then
SETTLED = 5e-3            # relative fall of a determinant below which its steps have settled
TAIL = 1e-9               # share of ordinary documents beyond the cut-off
POOLED = "\u0000pooled"

# Statistic -> least spread (in transformed units), so that a rate which is zero for
# almost all documents does not turn its first small value into an outlier.
SPREAD = {"s_length": 0.05, "s_symbols": 0.03, "s_lines": 0.15, "s_repeats": 0.15}
NAMES = list(SPREAD)


def _chi2_cdf_even(x: float, dims: int) -> float:
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def chi2_quantile_even(tail: float, dims: int) -> float:
    """Value that a chi-square variable of an even number of dimensions exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        half = mid / 2
        above = math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))
        low, high = (mid, high) if above > tail else (low, mid)
    return (low + high) / 2


def core_factor(share: float = CORE_SHARE, dims: int = len(NAMES)) -> float:
    """By how much the scatter of the nearest ``share`` falls short of the whole's, for normal data."""
    return share / _chi2_cdf_even(chi2_quantile_even(1 - share, dims), dims + 2)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(
                s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            )
            inside = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(inside))

        return let(ordered, positions)

    def checked(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, checked))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``stats`` of counts, each text read once."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        words_of(F.col("_text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.col("_text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    kept = [c for c in docs.columns]
    # The struct leaves a generator: filters and later columns cannot copy its expression.
    return docs.select(*kept, text_of(text).alias("_text")).select(*kept, F.explode(F.array(stats)).alias("_stats"))


def counts(stats: Column) -> list[Column]:
    n, rep = stats["n_words"], stats["n_repeat_words"]
    return [
        n.alias("n_words"), stats["word_chars"].alias("word_chars"), stats["n_symbols"].alias("n_symbols"),
        stats["lines"]["dup"].cast("long").alias("n_dup_lines"), rep.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PCT * n)).alias("base_failed"),
    ]


def transformed(stats: Column) -> list[Column]:
    """The vector: log word length and square roots of the three shares."""
    n = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    return [
        F.log(chars / n).alias("s_length"),
        F.sqrt(stats["n_symbols"] / chars).alias("s_symbols"),
        F.sqrt(stats["lines"]["dup"] / F.greatest(stats["lines"]["n"], F.lit(1))).alias("s_lines"),
        F.sqrt(stats["n_repeat_words"] / n).alias("s_repeats"),
    ]


def group_columns() -> list[Column]:
    return [text_of("lang").alias("_lang"), text_of("source").alias("_source")]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


STATE = [f"m{i}" for i in range(len(NAMES))] + [f"l{i}{j}" for i in range(len(NAMES)) for j in range(i + 1)] + ["det"]


def _with_factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor ``l`` of the covariance ``c``, column by column, and the determinant."""
    d = len(NAMES)
    for j in range(d):
        diagonal = F.col(f"c{j}{j}")
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") ** 2
        groups = groups.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(SPREAD[NAMES[j]] ** 2))))
        for i in range(j + 1, d):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    product = F.lit(1.0)
    for j in range(d):
        product = product * F.col(f"l{j}{j}") ** 2
    return groups.withColumn("det", product).select("_fit", "_start", *STATE)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _estimated(members: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor per ``_fit`` and ``_start``, one combined aggregation."""
    means = [F.avg(n).alias(f"m{i}") for i, n in enumerate(NAMES)]
    covs = [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i, j in _pairs()]
    groups = members.groupBy("_fit", "_start").agg(*means, *covs)
    spread = [
        (factor * F.col(f"c{i}{j}") + (SPREAD[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _pairs()
    ]
    return _with_factor(groups.select("_fit", "_start", *[f"m{i}" for i in range(len(NAMES))], *spread))


def _starts(members: DataFrame) -> DataFrame:
    """Three first estimates of every ``_fit``, written.

    Medians and deviations are one row per group, written so that Spark sees their size and
    sends them to the rows instead of shuffling these.
    """
    middle = written(
        members.groupBy("_fit").agg(*[F.percentile_approx(n, 0.5, 1000).alias(f"m{i}") for i, n in enumerate(NAMES)]), "mcd-middle"
    )
    deviation = members.join(middle, "_fit").groupBy("_fit").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(NAMES))],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, n in enumerate(NAMES)],
    )
    own = [F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + SPREAD[n] ** 2).alias(f"s{i}") for i, n in enumerate(NAMES)]
    scales = written(deviation.select("_fit", *[f"m{i}" for i in range(len(NAMES))], *own), "mcd-scales")
    alone = [(F.pow(F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()]
    medians = _with_factor(scales.select("_fit", F.lit(0).alias("_start"), *[f"m{i}" for i in range(len(NAMES))], *alone))
    classical = _estimated(members.withColumn("_start", F.lit(1)), 1.0)
    # Scores that no outlier can stretch: their correlations, at the robust scales.
    scores = members.join(scales, "_fit").select(
        "_fit", *[f"{x}{i}" for x in "ms" for i in range(len(NAMES))],
        *[F.tanh((F.col(n) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, n in enumerate(NAMES)],
    )
    bounded = scores.groupBy("_fit").agg(
        *[F.first(f"{x}{i}").alias(f"{x}{i}") for x in "ms" for i in range(len(NAMES))],
        *[F.covar_pop(f"z{i}", f"z{j}").alias(f"v{i}{j}") for i, j in _pairs()],
    )
    correlated = [
        (
            F.pow(F.col(f"s{i}"), 2)
            if i == j
            else F.coalesce(F.try_divide(F.col(f"v{i}{j}"), F.sqrt(F.col(f"v{i}{i}") * F.col(f"v{j}{j}"))), F.lit(0.0)) * F.col(f"s{i}") * F.col(f"s{j}")
        ).alias(f"c{i}{j}")
        for i, j in _pairs()
    ]
    joint = _with_factor(bounded.select("_fit", F.lit(2).alias("_start"), *[f"m{i}" for i in range(len(NAMES))], *correlated))
    return written(medians.unionByName(classical).unionByName(joint), "mcd-start")


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """``(_lang, _source, m.., l.., det)``: centre, Cholesky factor and determinant for each group of ``vectors``.

    ``vectors`` is a written table with ``_lang``, ``_source`` and the four statistics. The
    estimates are three rows per group; Spark joins them by broadcast while they are small.
    """
    sizes = vectors.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    fit = F.when(F.col("_n") >= MIN_GROUP, F.struct("_lang", "_source")).otherwise(
        F.struct("_lang", F.lit(POOLED).alias("_source"))
    )
    groups = written(sizes.select("_lang", "_source", fit.alias("_fit")), "mcd-groups")
    members = vectors.join(groups, ["_lang", "_source"]).select("_fit", *NAMES)
    estimates, keys = _starts(members), ["_fit", "_start"]
    for step in range(STEPS):
        placed = members.join(estimates, "_fit").withColumn("_d", _distance())
        # Every document is measured; the cut is its group's quantile of all distances.
        cuts = placed.groupBy(*keys).agg(F.percentile_approx("_d", CORE_SHARE, 1000).alias("_cut"))
        core = placed.join(written(cuts, f"mcd-cut-{step}"), keys).filter(F.col("_d") <= F.col("_cut"))
        found = written(_estimated(core.select(*keys, *NAMES), core_factor()), f"mcd-{step}")
        fall = found.join(estimates.select(*keys, F.col("det").alias("_before")), keys).agg(F.max(1 - F.col("det") / F.col("_before"))).first()[0]
        estimates = written(_least(found), "mcd-least") if step + 1 == FIRST_STEPS else found
        if step >= FIRST_STEPS and (fall is None or fall <= SETTLED):
            break
    return groups.join(estimates.drop("_start"), "_fit").drop("_fit")


def _least(estimates: DataFrame) -> DataFrame:
    """Of each group the estimate with the least determinant; of equal ones the first start's."""
    best = F.min(F.struct("det", "_start", *[c for c in STATE if c != "det"])).alias("_best")
    return estimates.groupBy("_fit").agg(best).select("_fit", *[F.col(f"_best.{c}").alias(c) for c in ("_start", *STATE)])


def with_verdict(placed: DataFrame) -> DataFrame:
    """Add ``distance`` and ``kept`` to rows that carry statistics and their group's estimate."""
    cut = chi2_quantile_even(TAIL, len(NAMES))
    return placed.withColumn("distance", _distance()).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    )


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, the base verdict, the distance and whether it is kept."""
    measured = text_statistics(docs.select("doc_id", "lang", "source", "text"))
    stats = F.col("_stats")
    vectors = written(
        measured.select("doc_id", *group_columns(), *counts(stats), *transformed(stats)), "quality-statistics"
    )
    return with_verdict(vectors.join(written(robust_estimates(vectors), "mcd"), ["_lang", "_source"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all columns and no shuffle of texts.

    The texts are measured twice, once for the estimates and once for the verdict, which
    is cheaper than sending every text through a join.
    """
    columns = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "lang", "source", "text")
    measured = text_statistics(named)
    stats = F.col("_stats")
    vectors = written(measured.select(*group_columns(), *transformed(stats)), "quality-statistics")
    estimates = written(robust_estimates(vectors), "mcd")
    rows = measured.select("_row", *group_columns(), *counts(stats), *transformed(stats))
    return with_verdict(rows.join(estimates, ["_lang", "_source"])).filter("kept").select("_row.*")
