"""The test documents as a case corpus.

The test tables hold invented words in which no lexicon fires. A sentence
chosen by document number is put before every text and a file name is made
from the number, so that all rules meet all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_PARTITIONS = "spark.casewright.testScanPartitions"

SENTENCES = [
    "The court granted the motion under the Clean Air Act on carbon emissions and climate "
    "disclosure in 2021. Motion granted. Southern District of New York.",
    "ERISA fiduciary duty and proxy voting. The appeal was affirmed and AFFIRMED in 2022 by the "
    "Second Circuit.",
    "Forced labor in the supply chain and OSHA worker safety. The judgment was vacated in 2019, "
    "2020 and 2019. Ninth Circuit.",
    "A Copyright Act claim, patent infringement and sustainability in 2020.",
    "Copyright infringement, securities fraud, disclosure and ERISA fiduciary claims. DISMISSED.",
    "Greenwashing, net zero claims, consumer protection and a fiduciary in 2023.",
    "Climate, fiduciary and OSHA in 2022 and 2021.",
    "Environmental governance and sustainability.",
    "",
    "For Educational Use Only. Case No. 2:11-cv-2288. 432 F.3d 201 on climate and is denied in 2018.",
]


def overlay_sentence(doc_id: Column) -> Column:
    sentences = F.array(*[F.lit(s) for s in SENTENCES])
    return F.get(sentences, (doc_id % len(SENTENCES)).cast("int"))


def overlay_filename(doc_id: Column) -> Column:
    number = F.lpad((doc_id % 40).cast("string"), 3, "0")
    case = F.floor(doc_id / 3).cast("string")
    return F.concat(number, F.lit("-Case"), case, F.lit(".md"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def overlay_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, filename, text)`` for every document.

    A test table is one row group, which one task reads. A caller that wants its rows dealt
    out says so in ``SCAN_PARTITIONS``; by itself the scan's own splits decide.
    """
    docs = table(spark, sf_dir, "documents")
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    docs = docs.repartition(int(wanted), "doc_id") if wanted else docs
    return docs.select(
        "doc_id",
        overlay_filename(F.col("doc_id")).alias("filename"),
        F.concat(overlay_sentence(F.col("doc_id")), F.lit(" "), F.col("text")).alias("text"),
    )
