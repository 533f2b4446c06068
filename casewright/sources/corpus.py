"""Reading corpora of text files and typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.text import decode_utf8

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("is_sustainability", T.IntegerType()),
        T.StructField("is_greenwash", T.IntegerType()),
        T.StructField("E_score", T.IntegerType()),
        T.StructField("S_score", T.IntegerType()),
        T.StructField("G_score", T.IntegerType()),
        T.StructField("sus_score", T.IntegerType()),
        T.StructField("signal_strength", T.IntegerType()),
    ]
)

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("year", T.StringType()),
        T.StructField("court", T.StringType()),
        T.StructField("pillar_E", T.IntegerType()),
        T.StructField("pillar_S", T.IntegerType()),
        T.StructField("pillar_G", T.IntegerType()),
        T.StructField("pillar_Sus", T.IntegerType()),
        T.StructField("noise_hits", T.IntegerType()),
        T.StructField("is_greenwash", T.IntegerType()),
        T.StructField("is_sustainability", T.IntegerType()),
        T.StructField("inferred_pillar", T.StringType()),
    ]
)

CLEANED_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("is_sustainability", T.IntegerType()),
        T.StructField("is_greenwash", T.IntegerType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("exceeds_512", T.IntegerType()),
        T.StructField("cleaned_text", T.StringType()),
    ]
)


def scan_files(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """One row per file: ``path, modificationTime, length, content``.

    Without ``content`` in the query Spark lists the files and reads none.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def file_name(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def decode_documents(files: DataFrame, with_path: bool = False) -> DataFrame:
    """``(filename, size_bytes, text)`` from scanned files; the path, on request, tells equal names apart."""
    return files.select(
        *(["path"] if with_path else []),
        file_name(F.col("path")).alias("filename"),
        F.col("length").alias("size_bytes"),
        decode_utf8(F.col("content")).alias("text"),
    )


def corpus_scan(
    spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False, with_path: bool = False
) -> DataFrame:
    return decode_documents(scan_files(spark, path, pattern, recursive), with_path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header under a declared schema; ``columns`` limits what is parsed."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.select(*columns) if columns else df
