"""Key-based de-duplication, noise filtering and per-document scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions import labels as lb
from casewright.functions import lexicon as lc
from casewright.functions import text as tx
from casewright.functions.rows import computed_once, struct_rows


def case_key(filename: Column) -> Column:
    """Name of the case: the file name without extension and number prefix."""
    stem = F.regexp_replace(filename, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    return F.regexp_replace(stem, r"\A[0-9]+-", "")


def numeric_prefix(filename: Column) -> Column:
    """Leading number of the file name; null if it has none."""
    return F.regexp_extract(filename, r"\A([0-9]+)", 1).try_cast("decimal(38,0)")


def canonical_files(docs: DataFrame, key: str = "filename", file: str = "filename") -> DataFrame:
    """One row per case: the key of the file with the lowest number prefix.

    A ``min`` per case is combined before the shuffle, so a case with very
    many copies needs no sort of all of them in one task.
    """
    prefix = numeric_prefix(F.col(file))
    first = F.min(F.struct(prefix.isNull().alias("no_prefix"), prefix.alias("prefix"), F.col(key)))
    return docs.groupBy(case_key(F.col(file)).alias("case_name")).agg(first[key].alias(key))


def canonical_dedup(docs: DataFrame, key: str = "filename", file: str = "filename") -> DataFrame:
    """Tag every document ``canonical`` or ``duplicate``.

    The winners are matched back on the unique document key, not on the case
    name, so that a large case does not meet in one task here either.
    """
    winners = canonical_files(docs, key, file).select(key, F.lit(True).alias("_winner"))
    return (
        docs.join(winners, key, "left")
        .withColumn("case_name", case_key(F.col(file)))
        .withColumn(
            "status", F.when(F.col("_winner"), F.lit("canonical")).otherwise(F.lit("duplicate"))
        )
        .drop("_winner")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tag every document ``canonical``, or ``duplicate`` if one of a lower key has the same text.

    The lowest key of a text is combined before the shuffle and matched back on the key, so a
    text with very many copies meets in no task. Empty texts are no copies of each other.
    """
    filled = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    first = docs.filter(filled).groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min(key).alias(key))
    winners = first.select(key, F.lit(True).alias("_winner"))
    status = F.when(F.col("_winner") | ~filled, F.lit("canonical")).otherwise(F.lit("duplicate"))
    return docs.join(winners, key, "left").withColumn("status", status).drop("_winner")


def dedup_counts(tagged: DataFrame) -> DataFrame:
    canonical = F.count_if(F.col("status") == "canonical")
    return tagged.agg(
        canonical.alias("canonical_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
        F.count("*").alias("total_input"),
    )


def dedup_status_union(tagged: DataFrame, kept: str, quarantined: str) -> DataFrame:
    """Listing of both outcomes with the corpus each file belongs to."""
    def listing(status: str, corpus: str) -> DataFrame:
        return tagged.filter(F.col("status") == status).select(
            "filename", F.lit(status).alias("status"), F.lit(corpus).alias("corpus")
        )

    return listing("canonical", kept).unionByName(listing("duplicate", quarantined))


LEXICONS = {
    "noise_terms": lx.NOISE_TERMS,
    "esg_hits": lx.ESG_SIGNAL_TERMS,
    "pillar_E": lx.PILLAR_E_TERMS,
    "pillar_S": lx.PILLAR_S_TERMS,
    "pillar_G": lx.PILLAR_G_TERMS,
    "pillar_Sus": lx.SUSTAINABILITY_TERMS,
    "noise_hits": lx.NOISE_DOMAIN_TERMS,
}


def _lowered(docs: DataFrame, text: str) -> DataFrame:
    """Add the text in lower case and folded for case-blind search, each made once."""
    low = docs.withColumn("_low", F.lower(text))
    return low.withColumn("_folded", lc.fold_case(F.col(text), F.col("_low")))


def signal_scores(
    docs: DataFrame, text: str = "text", greenwash: bool = False, names: Sequence[str] = tuple(LEXICONS)
) -> DataFrame:
    """Add the named lexicon scores (all seven by default), and the greenwash flag on request.

    Scores stay where they are computed, out of the optimizer's reach, so ask for those
    that are used.
    """
    columns = {name: lc.lexicon_hits("_low", LEXICONS[name]) for name in names}
    if greenwash:
        columns["is_greenwash"] = lc.flag_greenwash(F.col("_folded"))
    return computed_once(_lowered(docs, text), columns).drop("_low", "_folded")


def noise_filter(docs: DataFrame, text: str = "text", override: int = lx.NOISE_OVERRIDE) -> DataFrame:
    """Add ``noise_hits``, ``esg_hits`` and ``decision``."""
    low = "_low"
    scored = computed_once(
        docs.withColumn("_low", F.lower(text)),
        {
            "noise_hits": lc.lexicon_hits(low, lx.NOISE_TERMS),
            "esg_hits": lc.lexicon_hits(low, lx.ESG_SIGNAL_TERMS),
        },
    ).drop("_low")
    return scored.withColumn(
        "decision", lb.noise_decision(F.col("noise_hits"), F.col("esg_hits"), override)
    )


def filter_counts(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(F.col("decision") == "retain").alias("retained_count"),
        F.count_if(F.col("decision") == "exclude").alias("excluded_count"),
    )


def pillar_metadata(docs: DataFrame, text: str = "text", size: str = "size_bytes") -> DataFrame:
    """Scores, year, court and flags of each document; the text is dropped."""
    low, folded = "_low", F.col("_folded")
    scored = computed_once(
        _lowered(docs.select("filename", size, text), text),
        {
            "year": lc.extract_year(F.col(text)),
            "court": lc.detect_court(folded),
            "pillar_E": lc.lexicon_hits(low, lx.PILLAR_E_TERMS),
            "pillar_S": lc.lexicon_hits(low, lx.PILLAR_S_TERMS),
            "pillar_G": lc.lexicon_hits(low, lx.PILLAR_G_TERMS),
            "pillar_Sus": lc.lexicon_hits(low, lx.SUSTAINABILITY_TERMS),
            "noise_hits": lc.lexicon_hits(low, lx.NOISE_DOMAIN_TERMS),
            "is_greenwash": lc.flag_greenwash(folded),
        },
    ).drop(text, "_low", "_folded")
    e, s, g = F.col("pillar_E"), F.col("pillar_S"), F.col("pillar_G")
    return scored.withColumns(
        {
            "is_sustainability": lc.flag_sustainability(F.col("pillar_Sus")),
            "inferred_pillar": lb.infer_pillar(e, s, g),
        }
    )


def label_table(metadata: DataFrame) -> DataFrame:
    """Labels from pillar metadata, in the published column order."""
    e, s, g = F.col("pillar_E"), F.col("pillar_S"), F.col("pillar_G")
    return metadata.select(
        "filename",
        lb.assign_label(e, s, g).alias("label"),
        "is_sustainability",
        "is_greenwash",
        e.alias("E_score"),
        s.alias("S_score"),
        g.alias("G_score"),
        F.col("pillar_Sus").alias("sus_score"),
        lb.signal_strength(e, s, g).alias("signal_strength"),
    )


def cleaned_table(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned and masked text with token counts, labels looked up by file name."""
    cleaned = docs.select("filename", tx.clean_text(F.col(text)).alias("cleaned_text"))
    counted = computed_once(cleaned, {"token_count": tx.token_count(F.col("cleaned_text"))})
    flags = labels.select("filename", "label", "is_sustainability", "is_greenwash")
    return counted.join(flags, "filename", "left").select(
        "filename",
        F.coalesce("label", F.lit("")).alias("label"),
        "is_sustainability",
        "is_greenwash",
        "token_count",
        tx.exceeds_limit(F.col("token_count")).alias("exceeds_512"),
        "cleaned_text",
    )


def cleaned_labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same table from documents that carry their labels: one pass over the text, no join."""
    cleaned = docs.withColumn("cleaned_text", tx.clean_text(F.col(text)))
    counted = computed_once(cleaned, {"token_count": tx.token_count(F.col("cleaned_text"))})
    return counted.select(
        "filename", "label", "is_sustainability", "is_greenwash", "token_count",
        tx.exceeds_limit(F.col("token_count")).alias("exceeds_512"), "cleaned_text",
    )


def lexicon_matches(docs: DataFrame, lexicons: dict[str, list[str]], text: str = "text") -> DataFrame:
    """One row per document and lexicon entry found in it.

    Every entry is a constant, so the match is a projection followed by an
    explode; documents and entries need no join.
    """
    low = "_low"
    found = struct_rows(
        ["lexicon", "terms"],
        *[[F.lit(name), lc.matched_terms(low, terms)] for name, terms in lexicons.items()],
    )
    matched = docs.select("filename", F.lower(text).alias("_low")).select("filename", F.inline(found))
    return matched.select("filename", "lexicon", F.explode("terms").alias("term"))
