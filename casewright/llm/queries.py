"""The registered query of each operator, and the SQL that answers it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import (
    compression_classifier,
    exact_dedup,
    jaccard_join,
    license_rules,
    lp_packing,
    nn_descent,
    periodic_runs,
    prefix_trie,
    quality_rules,
    secret_links,
    source_mixing,
    suffix_dedup,
    warc_archives,
)
from casewright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query
def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.secrets(table(spark, sf_dir, "documents"))


@query
def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scanned(table(spark, sf_dir, "documents"))


@query
def op5_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp_packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archives.archived(spark, table(spark, sf_dir, "pages"))


@query
def op7_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_classifier.scored(docs, compression_classifier.fit(docs, table(spark, sf_dir, "labels")))


ORACLES["op3_source_mixing"] = source_mixing.ORACLE
ORACLES["op6_warc_archives"] = warc_archives.ORACLE


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


ORACLES["op1_jaccard_join"] = jaccard_join.ORACLE


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nn_descent.nearest(vectors, vectors.filter(vectors.vec_id % 20 == 0))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("in_history")


ORACLES["op13_exact_dedup"] = exact_dedup.ORACLE


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE
