"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixed corpus divided by its share of the input is the mean
number of copies of its documents. Each document draws its number of copies by inverting
the Poisson distribution of that mean at a point that a hash of seed and document id gives,
so a repeated or resumed run draws the same. Documents are exploded by their copies, and
all copies are put in the order of another hash, across the whole corpus.

Defined results: a null source is the empty string; a null text is empty (a text's size is
its length plus one, so that empty ones weigh something); rows that repeat an id draw the
same count; a source without a target weight is left out; an empty table gives an empty
result. Other columns pass through; input columns named ``copy`` or ``shuffle_key`` are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import text_of, written

SEED = 42
TEMPERATURE = 0.5          # without given weights a source weighs its size to this power
MEAN = 16                  # a larger mean is drawn as a sum of draws of at most this mean
STEPS = 80                 # a draw of mean 16 exceeds 80 once in 10^27
BROADCAST_SOURCES = 10_000  # with more sources the join is by key and salt
SALTS = 64


def source_of() -> Column:
    return F.coalesce("source", F.lit(""))


def mixing_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``(_source, rate, draws, cdf)``: mean copies of each source and their distribution.

    ``weights`` are target shares by source, of any sum; ``epochs`` is the size of the mixed
    corpus as a multiple of the input.
    """
    sizes = docs.groupBy(source_of().alias("_source")).agg(F.sum(F.length(text_of("text")) + 1).alias("_size"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), TEMPERATURE))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("_weight", F.coalesce(F.try_element_at(given, "_source").cast("double"), F.lit(0.0)))
    weighed = written(weighed, "mixing-sizes")
    # One row of totals.
    sizes_sum, weights_sum = weighed.agg(F.sum("_size"), F.sum("_weight")).first()
    rates = weighed.withColumn(
        "rate", F.lit(float(epochs)) * F.col("_weight") / F.lit(weights_sum or 1.0) * F.lit(float(sizes_sum or 0)) / F.col("_size")
    )
    drawn = rates.filter("rate > 0").withColumn("draws", F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), start,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf")
        ),
        lambda s: s["cdf"],
    )
    return drawn.select("_source", "rate", "draws", cdf.alias("cdf"))


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash."""
    return (F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, the number of the ``copy`` and its ``shuffle_key``."""
    rates = written(mixing_rates(docs, weights, epochs), "mixing-rates")
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    name = F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), source_of().alias("_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), "_source")
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"])
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda total, j: total + F.size(F.filter("cdf", lambda c: c < uniform(str(seed), name, j.cast("string")))),
    )
    drawn = joined.select("_doc", count.alias("_copies")).filter("_copies > 0")
    copies = drawn.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    keyed = copies.select(
        "_doc.*", "copy", _hash(str(seed), "order", name, F.col("copy").cast("string")).alias("shuffle_key")
    )
    # The key is a hash: by it copies fall on partitions at random, and in random order within.
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = f"""
WITH sizes AS (
    SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY 1
), rates AS (
    SELECT s, pow(size::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(size::DOUBLE, {TEMPERATURE})) FROM sizes)
        * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate FROM sizes
), means AS (
    SELECT s, greatest(ceil(rate / {MEAN}), 1)::INT AS draws, rate / greatest(ceil(rate / {MEAN}), 1) AS mean FROM rates
), cdf AS (
    SELECT s, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c
    FROM means, (SELECT unnest(range(0, {STEPS} + 1)) AS k)
), cdfs AS (
    SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s
), draws AS (
    SELECT d.*, cs, unnest(range(1, draws + 1)) AS j FROM documents d
    JOIN means ON means.s = coalesce(source, '') JOIN cdfs ON cdfs.s = means.s
), drawn AS (
    SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda c: c <
        ((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0
    )))::INT AS n FROM draws GROUP BY ALL
), copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM drawn)
SELECT *, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM copies
"""
