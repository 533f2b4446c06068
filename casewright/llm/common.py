"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.sources.storage import scratch_path, written

__all__ = ["file_numbers", "let", "scratch_path", "table", "text_of", "with_places", "words_of", "written"]

FILES = 100_000      # file names sent to every task at most; beyond, they are joined by shuffle
ROW_BITS = 40        # of a row's number that tell its place in its file

SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def file_numbers(docs: DataFrame) -> DataFrame:
    """``(_file, _number)`` of the files that ``docs`` is read from, written; one row per file."""
    names = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("_file")).distinct()
    order = Window.partitionBy().orderBy("_file")
    return written(names.select("_file", (F.row_number().over(order) - 1).cast("bigint").alias("_number")), "file-numbers")


def with_places(docs: DataFrame, files: DataFrame, *columns: str | Column) -> DataFrame:
    """``(_row, columns...)``, where ``_row`` is the number of the file and the row's place in it.

    A row has the same number in every scan, however the files are split; ``docs`` has to be
    read from Parquet files.
    """
    place = docs.metadataColumn("_metadata")
    told = docs.select(place["file_path"].alias("_file"), place["row_index"].alias("_index"), *columns)
    few = F.broadcast(files) if files.count() <= FILES else files
    kept = [c for c in told.columns if c not in ("_file", "_index")]
    row = F.shiftleft("_number", ROW_BITS) + F.col("_index")
    return told.join(few, "_file").select(row.alias("_row"), *kept)
