"""Scoring of files as they arrive.

A second run over a folder skips what is complete; a file stream does the same
by document. The per-row scores keep no state, so a stream needs no watermark
and each file is scored exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from casewright.operators.curate import noise_filter
from casewright.sources.corpus import decode_documents

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.md", per_trigger: int = 10_000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .load(path)
    )


def start_filter(
    spark: SparkSession, path: str, output: str, checkpoint: str, pattern: str = "*.md"
) -> StreamingQuery:
    """Filter new files into ``output`` by decision, then stop when none are left.

    ``checkpoint`` remembers which files are done; a restart has to name the same one.
    """
    decided = noise_filter(decode_documents(stream_files(spark, path, pattern)))
    return (
        decided.writeStream.format("parquet")
        .partitionBy("decision")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
