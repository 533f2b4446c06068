"""The curation job: scan, de-duplicate, filter, score, label, clean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions import labels as lb
from casewright.functions import lexicon as lc
from casewright.functions import text as tx
from casewright.operators import curate, stats
from casewright.sources.corpus import corpus_scan
from casewright.sources.tables import materialize


PILLARS = ("pillar_E", "pillar_S", "pillar_G")
# Column -> the scores it is made of.
MADE_OF = {
    "decision": ("noise_terms", "esg_hits"),
    "label": PILLARS,
    "inferred_pillar": PILLARS,
    "is_sustainability": ("pillar_Sus",),
    "is_greenwash": (),
}


def with_labels(docs: DataFrame, text: str = "text", columns: Sequence[str] = tuple(MADE_OF)) -> DataFrame:
    """Documents with the wanted of noise decision, labels and flags, and their scores, in one pass."""
    wanted = {name for column in columns for name in MADE_OF[column]}
    names = [name for name in curate.LEXICONS if name in wanted]
    scored = curate.signal_scores(docs, text, greenwash="is_greenwash" in columns, names=names)
    pillars = [F.col(p) for p in PILLARS]
    made = {
        "decision": lambda: lb.noise_decision(F.col("noise_terms"), F.col("esg_hits"), lx.NOISE_OVERRIDE),
        "label": lambda: lb.assign_label(*pillars),
        "inferred_pillar": lambda: lb.infer_pillar(*pillars),
        "is_sustainability": lambda: lc.flag_sustainability(F.col("pillar_Sus")),
    }
    return scored.withColumns({name: make() for name, make in made.items() if name in columns})


def labelled_corpus(docs: DataFrame) -> DataFrame:
    """Retained documents with their label and cleaned text."""
    kept = with_labels(docs, columns=("decision", "label")).filter(F.col("decision") == "retain")
    return kept.select("filename", "label", tx.clean_text(F.col("text")).alias("cleaned_text"))


def retained_label_distribution(docs: DataFrame) -> DataFrame:
    """Label distribution of the retained corpus, the flagship query."""
    return stats.label_distribution(
        with_labels(docs, columns=("decision", "label")).filter(F.col("decision") == "retain")
    )


def curate_corpus(
    spark: SparkSession, input_dir: str, output_dir: str, force: bool = False
) -> dict[str, DataFrame]:
    """Run all curation steps over a folder of files, skipping completed ones.

    Each step writes its table and a manifest row, so a run can be repeated
    after a failure. The text is read three times, from the written tables,
    and every other table is narrow.
    """
    manifest = f"{output_dir}/run_manifest"

    def step(name, build, metrics=None, partition_by=()):
        return materialize(
            name, build, f"{output_dir}/{name}", manifest, spark, metrics, partition_by, force
        )

    status = F.col("status")
    deduped = step(
        "01_deduplicate",
        lambda: curate.canonical_dedup(corpus_scan(spark, input_dir, with_path=True), key="path"),
        {
            "canonical_count": F.count_if(status == "canonical"),
            "duplicate_count": F.count_if(status == "duplicate"),
        },
        ["status"],
    )
    decision = F.col("decision")
    filtered = step(
        "02_filter_noise",
        lambda: curate.noise_filter(deduped.filter(status == "canonical").drop("status")),
        {
            "retained_count": F.count_if(decision == "retain"),
            "excluded_count": F.count_if(decision == "exclude"),
        },
        ["decision"],
    )
    retained = filtered.filter(decision == "retain").select("filename", "size_bytes", "text")
    metadata = step(
        "03_pillar_metadata",
        lambda: curate.pillar_metadata(retained),
        {"greenwash_count": F.sum("is_greenwash")},
    )
    labels = step(
        "04_labels",
        lambda: curate.label_table(metadata),
        {"sustainability_flagged": F.sum("is_sustainability"), "greenwash_count": F.sum("is_greenwash")},
    )
    cleaned = step(
        "05_cleaned",
        lambda: curate.cleaned_labelled(
            with_labels(retained, columns=("label", "is_sustainability", "is_greenwash"))
        ),
        {"over_512_count": F.sum("exceeds_512"), "avg_token_count": F.avg("token_count")},
    )
    return {
        "deduped": deduped,
        "filtered": filtered,
        "metadata": metadata,
        "labels": labels,
        "cleaned": cleaned,
        "report": stats.stats_report(metadata),
    }
