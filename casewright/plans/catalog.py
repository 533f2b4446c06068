"""Named queries over the test tables, one per operator.

Each takes a session and the folder of the tables and returns a DataFrame over
all their rows. Floating sums are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions import labels as lb
from casewright.functions import lexicon as lc
from casewright.functions import terms as tm
from casewright.functions import text as tx
from casewright.functions.rows import struct_rows
from casewright.operators import attribution, curate, features, joins, kernel, metrics, models, near_dup, split, stats, tree_paths
from casewright.plans import baseline, folds
from casewright.plans.corpus import PILLARS, labelled_corpus, retained_label_distribution, with_labels
from casewright.plans.overlay import overlay_corpus, overlay_filename, table
from casewright.sources import corpus as src
from casewright.sources import tables as tb
from casewright.sources.storage import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str, alias: str | None = None) -> F.Column:
    return F.round(F.col(column).cast("double"), 6).alias(alias or column)


# --- shared inputs ---------------------------------------------------------


def _scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return with_labels(overlay_corpus(spark, d), columns=columns)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return overlay_corpus(spark, d).select("filename", lc.fold_case(F.col("text")).alias("folded"))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = overlay_corpus(spark, d).withColumn("size_bytes", F.octet_length("text").cast("long"))
    return curate.pillar_metadata(docs)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return curate.label_table(_metadata(spark, d))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned documents with label columns, all from one scan."""
    return curate.cleaned_labelled(_scored(spark, d, "label", "is_sustainability", "is_greenwash"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three rules as models, with a score per class, for every document.

    Written once, as every metric reads it again.
    """
    scored = written(
        _scored(spark, d, "label", "inferred_pillar", "is_greenwash").select(
            "filename", "label", "inferred_pillar", "is_greenwash", "pillar_E", "pillar_S", "pillar_G",
            F.length("text").alias("n_text"),
        ),
        "rule_scores",
    )
    e, s, g = (F.col(f"pillar_{p}") for p in "ESG")
    top = split.majority_class(scored).select("label").scalar()
    keyword = (
        F.when((F.col("is_greenwash") == 1) | (e >= 2), F.lit("E"))
        .when(g > 0, F.lit("G"))
        .when(s > 0, F.lit("S"))
        .otherwise(F.lit("Non-ESG"))
    )
    mass = e + s + g + 2.0
    length = F.least(F.col("n_text") / 100000.0, F.lit(1.0))
    rules = struct_rows(
        ["model", "predicted", "p_0", "p_1", "p_2", "p_3"],
        [
            F.lit("pillar_rule"), F.col("inferred_pillar"),
            (e + 0.5) / mass, (g + 0.5) / mass, 0.5 / mass, (s + 0.5) / mass,
        ],
        [
            F.lit("keyword_rule"), keyword,
            (e + length) / mass, (g + length) / mass, length / mass, (s + length) / mass,
        ],
        [F.lit("majority_class"), top, *[(top == F.lit(c)).cast("double") for c in lx.CLASSES]],
    )
    return scored.select("filename", F.col("label").alias("actual"), F.inline(rules))


_PROBABILITIES = {c: f"p_{i}" for i, c in enumerate(lx.CLASSES)}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Class scores of the rules, and text length as a score for quality."""
    rules = metrics.class_scores(_predictions(spark, d), _PROBABILITIES)
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    quality = table(spark, d, "labels").join(docs, "doc_id").select(
        F.lit("length").alias("model"), F.lit("quality").alias("class"),
        F.col("quality").alias("y"), "score",
    )
    return rules.unionByName(quality)


def _tokens_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Alphabetic tokens without stop words, of every document."""
    cleaned = _scored(spark, d, "label").select("filename", "label", tx.clean_text(F.col("text")).alias("c"))
    words = cleaned.select("filename", "label", tm.alpha_tokens(tx.analysis_text(F.col("c"))).alias("t"))
    return words.select(
        "filename", "label", tm.drop_words(F.col("t"), lx.STOP_WORDS).alias("tokens")
    )


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return written(labelled_corpus(overlay_corpus(spark, d)), "labelled")


def _fitted(spark: SparkSession, d: str) -> baseline.Features:
    return baseline.fit_features(_labelled(spark, d))


# --- sources and sinks -----------------------------------------------------


@query
def corpus_scan(spark, d):
    docs = overlay_corpus(spark, d)
    files = docs.select(
        F.concat(F.lit("/corpus/"), F.col("filename")).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )
    return src.decode_documents(files)


@query
def csv_typed_scan(spark, d):
    path = scratch_path(spark, "labels_csv")
    tb.write_table(_labels(spark, d), path, "csv")
    return src.read_csv(spark, path, src.LABEL_SCHEMA, ["filename", "label", "E_score", "signal_strength"])


@query
def table_sink(spark, d):
    path = scratch_path(spark, "filter_log")
    log = curate.noise_filter(overlay_corpus(spark, d)).select("decision", "filename", "noise_hits", "esg_hits")
    tb.write_table(log, path)
    return spark.read.schema(log.schema).parquet(path)


@query
def quarantine_split(spark, d):
    log = curate.noise_filter(overlay_corpus(spark, d)).select("filename", "decision", F.md5("text").alias("text_md5"))
    return tb.quarantine_split(log, scratch_path(spark, "quarantine"))


@query
def run_manifest(spark, d):
    folder = scratch_path(spark, "run")
    decision = F.col("decision")
    # The second call finds the completed run and must not build again.
    for build in (lambda: curate.noise_filter(overlay_corpus(spark, d)).drop("text"), lambda: None):
        tb.materialize(
            "02_filter_noise", build, f"{folder}/02_filter_noise", f"{folder}/manifest", spark,
            {
                "retained_count": F.count_if(decision == "retain"),
                "excluded_count": F.count_if(decision == "exclude"),
            },
        )
    done = tb.read_manifest(spark, f"{folder}/manifest").filter("status = 'complete'")
    return done.select("step", "status", "rows", "details")


@query
def stats_report(spark, d):
    meta = written(_metadata(spark, d), "metadata")
    return stats.stats_report(meta).withColumn("value", F.round("value", 6))


@query
def snapshot_write(spark, d):
    return tb.write_snapshot(
        _labels(spark, d), 4, "label_construction", "v1", "4232026",
        scratch_path(spark, "snapshots"), {"tiebreaker": "G > E > S"},
    )


@query
def file_hashes(spark, d):
    docs = overlay_corpus(spark, d).select("filename", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    # The customers of the order table ask for files; many have none.
    expected = table(spark, d, "customer").select(overlay_filename(F.col("c_custkey")).alias("filename"))
    return tb.file_hashes(docs, expected)


@query
def table_fingerprint(spark, d):
    return tb.table_fingerprint(_cleaned(spark, d))


@query
def integrity_check(spark, d):
    raw = overlay_corpus(spark, d)
    expected = raw.select("filename", F.sha2("text", 256).alias("sha256"))
    actual = raw.select("filename", F.sha2(tx.clean_text(F.col("text")), 256).alias("sha256"))
    return tb.integrity_check(expected, actual)


def _fold_scores(spark: SparkSession, d: str) -> DataFrame:
    labelled = written(
        _scored(spark, d, "label", "inferred_pillar").select("filename", "label", "inferred_pillar"), "fold_labels"
    )
    folds = split.repeated_kfold(labelled, "filename")
    keys = ["seed", "fold"]
    judged = folds.select(*keys, F.col("label").alias("actual"), F.col("inferred_pillar").alias("predicted"))
    report = metrics.class_report(metrics.confusion_matrix(judged, keys), keys)
    return metrics.macro_f1(report, keys).select(*keys, r6("macro_f1"))


@query
def fold_results_flatten(spark, d):
    folds = _fold_scores(spark, d)
    seeds = folds.groupBy(F.col("seed").cast("string").alias("seed")).agg(
        F.struct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("fold", "macro_f1"))), lambda x: x["macro_f1"]
            ).alias("fold_f1s"),
            F.round(F.avg("macro_f1"), 6).alias("mean"),
            F.round(F.stddev_pop("macro_f1"), 6).alias("std"),
        ).alias("r")
    )
    document = seeds.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("seed", "r")))).alias("per_seed_results")
    )
    return tb.fold_results_flatten(document)


# --- scalar functions ------------------------------------------------------


@query
def case_key(spark, d):
    return overlay_corpus(spark, d).select("filename", curate.case_key(F.col("filename")).alias("case_name"))


@query
def numeric_prefix(spark, d):
    return overlay_corpus(spark, d).select(
        "filename", curate.numeric_prefix(F.col("filename")).cast("long").alias("prefix")
    )


@query
def lexicon_hits(spark, d):
    low = overlay_corpus(spark, d).select("filename", F.lower("text").alias("low"))
    return low.select("filename", lc.lexicon_hits("low", lx.ESG_SIGNAL_TERMS).alias("esg_hits"))


@query
def signal_scores(spark, d):
    return curate.signal_scores(overlay_corpus(spark, d)).drop("doc_id", "text")


@query
def extract_year(spark, d):
    return overlay_corpus(spark, d).select("filename", lc.extract_year(F.col("text")).alias("year"))


@query
def detect_court(spark, d):
    return _folded(spark, d).select("filename", lc.detect_court(F.col("folded")).alias("court"))


@query
def flag_greenwash(spark, d):
    return _folded(spark, d).select("filename", lc.flag_greenwash(F.col("folded")).alias("is_greenwash"))


@query
def flag_sustainability(spark, d):
    low = overlay_corpus(spark, d).select("filename", F.lower("text").alias("low"))
    score = lc.lexicon_hits("low", lx.SUSTAINABILITY_TERMS)
    return low.select("filename", lc.flag_sustainability(score).alias("is_sustainability"))


@query
def infer_pillar(spark, d):
    return _scored(spark, d, "inferred_pillar").select("filename", "pillar_E", "pillar_S", "pillar_G", "inferred_pillar")


@query
def assign_label(spark, d):
    return _labels(spark, d)


@query
def signal_strength(spark, d):
    scored = _scored(spark, d, "label")
    return scored.select("filename", lb.signal_strength(*[F.col(p) for p in PILLARS]).alias("signal_strength"))


@query
def strip_headers(spark, d):
    return overlay_corpus(spark, d).select("filename", tx.strip_headers(F.col("text")).alias("stripped"))


@query
def collapse_whitespace(spark, d):
    return overlay_corpus(spark, d).select("filename", tx.collapse_whitespace(F.col("text")).alias("collapsed"))


@query
def mask_outcome_context(spark, d):
    return overlay_corpus(spark, d).select("filename", tx.mask_outcome_context(F.col("text")).alias("masked"))


@query
def mask_outcome_caps(spark, d):
    return overlay_corpus(spark, d).select("filename", tx.mask_outcomes(F.col("text")).alias("masked"))


@query
def token_count(spark, d):
    counted = overlay_corpus(spark, d).select("filename", tx.token_count(F.col("text")).alias("token_count"))
    return counted.withColumn("exceeds_512", tx.exceeds_limit(F.col("token_count")))


@query
def outcome_mask_count(spark, d):
    return overlay_corpus(spark, d).select(
        "filename", tx.outcome_mask_count(tx.clean_text(F.col("text"))).alias("outcome_mask_count")
    )


@query
def analysis_text(spark, d):
    return overlay_corpus(spark, d).select(
        "filename", tx.analysis_text(tx.clean_text(F.col("text"))).alias("analysis_text")
    )


@query
def fill_text(spark, d):
    users = table(spark, d, "conversations").select("conv_id", "turn", F.nullif("text", F.lit("")).alias("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"))
    return docs.join(users, "conv_id", "left").select(
        "conv_id", "turn", F.md5(tx.fill_text(F.col("text"))).alias("text_md5")
    )


@query
def label_encode(spark, d):
    return _labels(spark, d).select("filename", "label", lb.label_encode(F.col("label")).alias("label_index"))


@query
def label_decode(spark, d):
    encoded = _labels(spark, d).select("filename", lb.label_encode(F.col("label")).alias("label_index"))
    return encoded.withColumn("label", lb.label_decode(F.col("label_index")))


@query
def one_vs_rest_flags(spark, d):
    return metrics.one_vs_rest_flags(_labels(spark, d), ["filename"])


@query
def label_display_name(spark, d):
    return _labels(spark, d).select(
        "filename",
        lb.label_display_name(F.col("label")).alias("display_name"),
        lb.label_slug(F.col("label")).alias("slug"),
    )


@query
def truncate_tokens(spark, d):
    return overlay_corpus(spark, d).select(
        "filename", tx.truncate_tokens(tx.clean_text(F.col("text")), lx.TOKEN_LIMIT).alias("truncated")
    )


@query
def chunk_tokens(spark, d):
    docs = overlay_corpus(spark, d).select("filename", tx.clean_text(F.col("text")).alias("c"))
    return tx.chunk_rows(docs, "c", lx.TOKEN_LIMIT, 384).select("filename", "chunk", "chunk_text")


# --- filters ---------------------------------------------------------------


@query
def noise_filter(spark, d):
    return curate.noise_filter(overlay_corpus(spark, d)).select("decision", "filename", "noise_hits", "esg_hits")


@query
def known_labels(spark, d):
    # Event types and class labels in one column; only the labels pass.
    labels = _labels(spark, d).select("filename", "label")
    other = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("filename"), F.col("event_type").alias("label")
    )
    return joins.known_labels(labels.unionByName(other))


@query
def class_slice(spark, d):
    return joins.class_slice(_labels(spark, d), "S").select("filename", "label", "S_score")


@query
def skew_flag(spark, d):
    return stats.skew_flags(_labels(spark, d)).withColumn("pct", F.round("pct", 6))


@query
def extension_filter(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("filename"))
    docs = overlay_corpus(spark, d).select("filename")
    return joins.extension_filter(docs.unionByName(pages))


# --- joins -----------------------------------------------------------------


@query
def join_labels_inner(spark, d):
    texts = overlay_corpus(spark, d).select(
        "filename", F.lit("stale").alias("label"), F.length("text").alias("n_chars")
    )
    return joins.join_labels_inner(texts, _labels(spark, d))


@query
def join_labels_left(spark, d):
    texts = table(spark, d, "customer").select(overlay_filename(F.col("c_custkey")).alias("filename"))
    return joins.join_labels_left(texts, _labels(spark, d), ["label", "is_sustainability", "is_greenwash"])


@query
def join_mask_counts(spark, d):
    return joins.mask_counts(_cleaned(spark, d))


@query
def split_membership(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    covered = table(spark, d, "labels")
    members = {
        "train": covered.filter(F.col("quality") == 1),
        "test": covered.filter(F.col("quality") == 0),
    }
    return split.split_membership(docs, "doc_id", members)


@query
def attach_predictions(spark, d):
    docs = overlay_corpus(spark, d).select("filename")
    rules = _predictions(spark, d)
    labels = rules.select("filename", F.col("actual").alias("label")).distinct()
    test = split.stratified_split(labels, "filename").filter(F.col("split") == "test").select("filename")
    predicted = rules.join(test, "filename", "left_semi").select("filename", "model", "predicted")
    columns = {"majority_class": "majority_pred", "pillar_rule": "pillar_pred", "keyword_rule": "keyword_pred"}
    return metrics.attach_predictions(docs, predicted, "filename", columns)


def _word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = overlay_corpus(spark, d).select(tm.alpha_tokens(F.col("text")).alias("terms"))
    return features.term_counts(words, [])


def _word_list(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "term string")


@query
def stopword_anti_join(spark, d):
    listed = features.stop_word_union(
        _word_list(spark, lx.GENERAL_STOP_WORDS), _word_list(spark, lx.LEGAL_STOP_WORDS)
    )
    return features.stop_word_anti_join(_word_counts(spark, d), listed)


@query
def stopword_union(spark, d):
    """The union of both lists, each word with its use in the corpus."""
    listed = features.stop_word_union(
        _word_list(spark, lx.GENERAL_STOP_WORDS), _word_list(spark, lx.LEGAL_STOP_WORDS)
    )
    used = listed.join(_word_counts(spark, d), "term", "left")
    return used.select("term", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("count", "df")])


@query
def lexicon_theta_join(spark, d):
    return curate.lexicon_matches(
        overlay_corpus(spark, d),
        {
            "noise": lx.NOISE_TERMS, "signal": lx.ESG_SIGNAL_TERMS, "E": lx.PILLAR_E_TERMS,
            "S": lx.PILLAR_S_TERMS, "G": lx.PILLAR_G_TERMS,
        },
    )


@query
def hash_left_join(spark, d):
    hashed = file_hashes(spark, d)
    return hashed.groupBy((F.col("sha256") == tb.MISSING).cast("int").alias("missing")).agg(
        F.count("*").alias("n"), F.min("filename").alias("first_file")
    )


# --- aggregates ------------------------------------------------------------


@query
def canonical_dedup(spark, d):
    return curate.canonical_dedup(overlay_corpus(spark, d)).select("filename", "case_name", "status")


@query
def exact_dedup(spark, d):
    return curate.exact_dedup(table(spark, d, "documents")).select("doc_id", "status")


@query
def near_dup_pairs(spark, d):
    """Pairs of distinct term vectors; copies are represented by the least of them."""
    vectors, _ = near_dup.term_vectors(table(spark, d, "documents"))
    return near_dup.near_dup_pairs(vectors).select("a", "b", r6("cosine"))


@query
def near_dup_clusters(spark, d):
    return near_dup.near_dup_clusters(table(spark, d, "documents"))


@query
def dedup_counts(spark, d):
    return curate.dedup_counts(canonical_dedup(spark, d))


@query
def dedup_status_union(spark, d):
    return curate.dedup_status_union(canonical_dedup(spark, d), "corpus_deduped", "corpus_dupes")


@query
def filter_counts(spark, d):
    return curate.filter_counts(curate.noise_filter(overlay_corpus(spark, d)))


@query
def corpus_totals(spark, d):
    docs = overlay_corpus(spark, d).select(F.octet_length("text").alias("size_bytes"))
    return stats.corpus_totals(docs).select("n_files", r6("total_mb"), r6("mean_kb"))


@query
def pillar_distribution(spark, d):
    return stats.distribution(_scored(spark, d, "inferred_pillar"), "inferred_pillar").withColumn("pct", F.round("pct", 6))


@query
def year_distribution(spark, d):
    return stats.top_values(extract_year(spark, d), "year", 10)


@query
def court_distribution(spark, d):
    return stats.distribution(detect_court(spark, d), "court").withColumn("pct", F.round("pct", 6))


@query
def label_distribution(spark, d):
    return retained_label_distribution(overlay_corpus(spark, d)).withColumn("pct", F.round("pct", 6))


@query
def flag_sums(spark, d):
    return stats.flag_sums(_labels(spark, d), ["is_sustainability", "is_greenwash"])


@query
def token_audit(spark, d):
    audit = stats.overlong_flag(stats.token_audit(_cleaned(spark, d)))
    return audit.withColumns({c: F.round(c, 6) for c in ("over_limit_pct", "mean_tokens")})


@query
def mask_audit(spark, d):
    return stats.mask_audit(joins.mask_counts(_cleaned(spark, d)))


@query
def describe_scores(spark, d):
    return stats.describe_scores(_labels(spark, d), ["E_score", "S_score", "G_score", "sus_score"])


@query
def class_weights(spark, d):
    parts = stratified_split(spark, d).filter(F.col("split") == "train")
    return split.class_weights(parts).select("label", "n", r6("weight"))


@query
def majority_class(spark, d):
    return split.majority_class(_labels(spark, d))


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_predictions(spark, d))


@query
def class_report(spark, d):
    report = metrics.class_report(confusion_matrix(spark, d))
    return report.select("model", "class", r6("precision"), r6("recall"), r6("f1"), "support")


@query
def macro_f1(spark, d):
    return metrics.macro_f1(metrics.class_report(confusion_matrix(spark, d))).select("model", r6("macro_f1"))


@query
def mcc_multiclass(spark, d):
    return metrics.mcc_multiclass(confusion_matrix(spark, d)).select("model", r6("mcc"))


@query
def auc_ovr(spark, d):
    return metrics.auc_ovr(_scores(spark, d)).select("model", "class", r6("auc"))


@query
def roc_points(spark, d):
    points = metrics.roc_points(_scores(spark, d))
    return points.select("model", "class", r6("threshold"), r6("fpr"), r6("tpr"))


@query
def evaluate_models(spark, d):
    predictions = _predictions(spark, d)
    scores = metrics.class_scores(predictions, _PROBABILITIES)
    out = metrics.evaluate_models(predictions, scores)
    return out.select("model", r6("macro_f1"), r6("mcc"), r6("auc_macro"))


@query
def best_model(spark, d):
    report = metrics.class_report(confusion_matrix(spark, d))
    return metrics.best_model(metrics.macro_f1(report)).select("model", r6("macro_f1"))


@query
def fold_summary(spark, d):
    return metrics.fold_summary(_fold_scores(spark, d)).select("seed", "folds", r6("mean"), r6("std"))


@query
def top_confidence_case(spark, d):
    scores = _predictions(spark, d).filter(F.col("model") == "keyword_rule").select(
        "filename", "actual", "predicted", r6("p_0", "score")
    )
    return metrics.top_confidence_case(scores, "filename")


# --- listing and samples ---------------------------------------------------


@query
def sorted_listing(spark, d):
    docs = overlay_corpus(spark, d).select("filename", F.octet_length("text").cast("long").alias("size_bytes"))
    return joins.sorted_listing(docs)


@query
def background_sample(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return split.background_sample(vectors, "vec_id", 200)


@query
def stratified_split(spark, d):
    labels = written(_labels(spark, d).select("filename", "label"), "labels")
    return split.stratified_split(labels, "filename")


@query
def stratified_kfold(spark, d):
    labels = written(_labels(spark, d).select("filename", "label"), "labels")
    return split.repeated_kfold(labels, "filename")


# --- text features ---------------------------------------------------------


@query
def tokenize_words(spark, d):
    words = overlay_corpus(spark, d).select("filename", tm.word_tokens(F.col("text")).alias("t"))
    return words.select("filename", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query
def tokenize_alpha(spark, d):
    tokens = _tokens_by_label(spark, d)
    return tokens.select("filename", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query
def ngrams(spark, d):
    tokens = _tokens_by_label(spark, d)
    return tokens.select(
        "filename",
        F.array_join(tm.ngrams(F.col("tokens"), 2), "|").alias("bigrams"),
        F.array_join(tm.ngrams(F.col("tokens"), 3), "|").alias("trigrams"),
    )


@query
def term_counts(spark, d):
    counts = features.term_counts(_tokens_by_label(spark, d), ["label"], "tokens")
    return counts.filter(F.col("df") >= lx.NGRAM_MIN_DF)


@query
def top_ngrams(spark, d):
    # Read twice, once by hash and once spelt out, but cleaned once.
    return features.ngram_tables(written(_tokens_by_label(spark, d).select("label", "tokens"), "label_tokens"))


@query
def vocab_top_k(spark, d):
    words = overlay_corpus(spark, d).select(tm.word_tokens(F.col("text")).alias("terms"))
    return features.vocab_top_k(features.term_counts(words, []), lx.MIN_DF, lx.MAX_FEATURES)


@query
def cloud_frequencies(spark, d):
    counts = written(features.term_counts(_tokens_by_label(spark, d), ["label"], "tokens"), "term_counts")
    overall = counts.groupBy("term").agg(F.sum("count").alias("count")).withColumn("label", F.lit("all"))
    per_label = features.cloud_frequencies(counts.select("label", "term", "count"), ["label"], 150)
    clouds = per_label.unionByName(features.cloud_frequencies(overall, ["label"], 150))
    return clouds.select("label", "term", "count", r6("frequency"))


@query
def tfidf_fit(spark, d):
    return _fitted(spark, d).vocabulary.select("term", "count", "df", r6("idf"))


@query
def tfidf_transform(spark, d):
    return _fitted(spark, d).weights().select("filename", "term", r6("weight"))


@query
def class_mean_tfidf(spark, d):
    fitted = _fitted(spark, d)
    sizes = fitted.docs.groupBy("label").agg(F.count("*").alias("n"))
    means = features.class_mean_tfidf(fitted.entries(), sizes, fitted.vocabulary, fitted.n_terms)
    return means.select("label", "term", r6("mean_weight"))


@query
def top_class_terms(spark, d):
    fitted = _fitted(spark, d)
    sizes = fitted.docs.groupBy("label").agg(F.count("*").alias("n"))
    means = features.class_mean_tfidf(fitted.entries(), sizes, fitted.vocabulary, fitted.n_terms)
    means = means.withColumn("mean_weight", F.round("mean_weight", 6))
    return features.top_terms(means, ["label"], "mean_weight", 80).select("label", "rank", "term", "mean_weight")


@query
def class_term_sums(spark, d):
    fitted = _fitted(spark, d)
    sums = (
        fitted.entries("train").filter(F.col("label") == "S")
        .groupBy("index")
        .agg(F.round(F.sum("weight"), 6).alias("total"))
    )
    sums = features.with_terms(sums, fitted.vocabulary, fitted.n_terms).select("term", "total")
    return sums.orderBy(F.desc("total"), F.asc("term")).limit(5)


@query
def class_signal_check(spark, d):
    """Top terms of every class beside its number of training rows."""
    fitted = _fitted(spark, d)
    train = fitted.part("train")
    sums = (
        fitted.entries("train")
        .groupBy("label", "index")
        .agg(F.round(F.sum("weight"), 6).alias("total"))
    )
    sums = features.with_terms(sums, fitted.vocabulary, fitted.n_terms).drop("index")
    top = features.top_terms(sums, ["label"], "total", 5)
    flags = stats.skew_flags(train).select("label", F.col("n").alias("n_train"), "is_low_signal")
    return top.join(F.broadcast(flags), "label").select(
        "label", "rank", "term", "total", "n_train", "is_low_signal"
    )


@query
def outcome_leak_terms(spark, d):
    vocabulary = _fitted(spark, d).vocabulary.select("term")
    leaks = features.outcome_leaks(vocabulary, [*lx.OUTCOME_TERMS, "outcome"])
    return leaks.select("term", F.array_join("leaks", ",").alias("leaks"))


# --- models ----------------------------------------------------------------

def _model_query(spark: SparkSession, d: str, name: str) -> DataFrame:
    data = baseline.vectors(_fitted(spark, d))
    fitted = baseline.train_models(data, names=(name,))
    test = data.filter(F.col("split") == "test")
    out = models.predict(fitted[name], test, name, "filename")
    return out.select("model", "filename", "actual", "predicted", *[r6(f"p_{i}") for i in range(4)])


@query
def tfidf_vectors(spark, d):
    v = F.unwrap_udt("features")
    return _fitted(spark, d).rows.select(
        "filename",
        "label_index",
        v["size"].alias("size"),
        F.size(v["indices"]).alias("entries"),
        F.round(F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"),
    )


@query
def lr_bow(spark, d):
    return _model_query(spark, d, "bow_logistic_regression")


@query
def lr_tuned(spark, d):
    return _model_query(spark, d, "logistic_regression")


@query
def complement_nb(spark, d):
    return _model_query(spark, d, "complement_naive_bayes")


@query
def random_forest(spark, d):
    return _model_query(spark, d, "random_forest")


@query
def boosted_trees(spark, d):
    return _model_query(spark, d, "boosted_trees")


def _forest_importance(spark: SparkSession, d: str) -> DataFrame:
    fitted = _fitted(spark, d)
    train = baseline.vectors(fitted).filter(F.col("split") == "train")
    forest = models.random_forest(train)
    return models.feature_importance(forest, fitted.vocabulary)


@query
def feature_importance(spark, d):
    return _forest_importance(spark, d).select("term", r6("importance"))


@query
def top_features(spark, d):
    return models.top_features(_forest_importance(spark, d)).select("rank", "term", r6("importance"))


@query
def leakage_audit(spark, d):
    top = models.top_features(_forest_importance(spark, d))
    leaks = features.outcome_leaks(top, [*lx.OUTCOME_TERMS, "outcome"])
    return leaks.select("rank", "term", F.array_join("leaks", ",").alias("leaks"))


# --- fitted models, judged and explained ---------------------------------------

CLOSED_FORM = ("bow_logistic_regression", "logistic_regression", "complement_naive_bayes")


def _fitted_predictions(spark: SparkSession, d: str) -> tuple[baseline.Features, DataFrame]:
    """Test-row predictions of the linear models, Bayes and the majority; the tree models have queries of their own."""
    fitted = _fitted(spark, d)
    data = baseline.vectors(fitted)
    return fitted, written(baseline.predict_all(baseline.train_models(data, names=CLOSED_FORM), data), "model_predictions")


@query
def model_evaluation(spark, d):
    out = baseline.evaluate(_fitted_predictions(spark, d)[1])
    return out.select("model", r6("macro_f1"), r6("mcc"), r6("auc_macro"))


@query
def model_best(spark, d):
    best = metrics.best_model(baseline.evaluate(_fitted_predictions(spark, d)[1]))
    return best.select("model", r6("macro_f1"))


@query
def model_documents(spark, d):
    """Every document with its split, and the predictions beside each other on the test rows."""
    fitted, predictions = _fitted_predictions(spark, d)
    names = {m: baseline.PREDICTED[m] for m in ("majority_class", *CLOSED_FORM)}
    return metrics.attach_predictions(fitted.docs, predictions, "filename", names)


@query
def fold_models(spark, d):
    """Macro-F1 of the linear model on every fold of every seed, fitted on the other folds."""
    done = folds.cross_validate(spark, _labelled(spark, d), scratch_path(spark, "folds"))
    return done["scores"].select("seed", "fold", r6("macro_f1"))


def _explained_forest(spark: SparkSession, d: str):
    fitted = _fitted(spark, d)
    data = baseline.vectors(fitted)
    forest = models.random_forest(data.filter(F.col("split") == "train"))
    return fitted, data, forest, tree_paths.forest_nodes(forest, len(lx.CLASSES))


@query
def forest_class_terms(spark, d):
    """For each class the 20 terms that move the forest most over the background rows, and their spread."""
    fitted, data, _, nodes = _explained_forest(spark, d)
    sample = written(split.background_sample(data.filter(F.col("split") == "train"), "filename"), "background")
    found = tree_paths.forest_contributions(sample, nodes, "filename")
    spread = tree_paths.mean_by_class(found, fitted.vocabulary, sample.count())
    top = features.top_terms(spread.withColumn("mean_abs", F.round("mean_abs", 6)), ["class"], "mean_abs", 20)
    return top.select("class", "rank", "term", "mean_abs", r6("least"), r6("greatest"), "n")


@query
def forest_waterfall(spark, d):
    """From the base to the forest's score: the 20 strongest terms of the surest environmental test row."""
    fitted, data, forest, nodes = _explained_forest(spark, d)
    scored = models.predict(forest, data.filter(F.col("split") == "test"), "random_forest", "filename")
    case = scored.orderBy(F.desc("p_0"), "filename").limit(1).select("filename", F.col("p_0").alias("score"))
    row = written(data.join(F.broadcast(case), "filename").select("filename", "features", "score"), "surest-case")
    found = tree_paths.forest_contributions(row, nodes, "filename").filter(F.col("class") == "E").drop("class")
    named = features.with_terms(found, fitted.vocabulary, fitted.n_terms).withColumn("size", F.round(F.abs("contribution"), 6))
    top = features.top_terms(named, ["filename"], "size", 20)
    base = tree_paths.base_shares(nodes).filter(F.col("class") == "E").select("base")
    return top.join(row.select("filename", "score"), "filename").select(
        "filename", "rank", "term", r6("contribution"), r6("score"), F.round(base.scalar(), 6).alias("base")
    )


@query
def linear_attribution(spark, d):
    """The 20 strongest terms for every test document and class."""
    return baseline.strongest_contributions(_fitted(spark, d))


@query
def global_attribution(spark, d):
    """Mean absolute contribution of the 20 strongest terms of each class."""
    fitted = _fitted(spark, d)
    coefficients, rows = baseline.contributions(fitted)
    n_test = fitted.part("test").agg(F.count("*")).scalar()
    overall = attribution.mean_absolute(rows, coefficients, n_test)
    rounded = overall.withColumn("mean_abs", F.round("mean_abs", 6))
    return features.top_terms(rounded, ["class"], "mean_abs", 20).select("class", "rank", "term", "mean_abs")


@query
def embedding_svm(spark, d):
    """A machine with a Gaussian kernel as probe: what it says of the vectors it was fitted on."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("label_index"), "embedding")
    found = kernel.fit_kernel_machines(vectors).transform(vectors, "vec_id", "label_index")
    return found.select("vec_id", F.col("label_index").cast("int").alias("actual"), "predicted")


@query
def embedding_pca_2d(spark, d):
    vectors = table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    out = models.embedding_pca_2d(vectors, "vec_id", "embedding", "label")
    return out.select("vec_id", "label", r6("x"), r6("y"))
