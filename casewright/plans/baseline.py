"""The model job: split, TF-IDF, six classifiers, evaluation, attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions.labels import label_encode
from casewright.operators import attribution, features, joins, metrics, models, ngram_vectors, split
from casewright.operators.ranking import seeded_hash
from casewright.sources.storage import written
from casewright.sources.tables import materialize

KEY = "filename"


@dataclass
class Features:
    """Split documents, their vocabulary and one sparse vector each, all written tables."""

    docs: DataFrame          # key, label, split
    vocabulary: DataFrame    # term, count, df, idf, index
    rows: DataFrame          # key, label, split, label_index, features
    n_terms: int
    key: str

    def part(self, name: str) -> DataFrame:
        return self.docs.filter(F.col("split") == name)

    def vectors(self, name: str | None = None) -> DataFrame:
        """The vectors of one split or of all; the choice is made at the scan."""
        return self.rows if name is None else self.rows.filter(F.col("split") == name)

    def entries(self, name: str | None = None) -> DataFrame:
        """``(key, label, split, index, weight)``."""
        return features.vector_entries(self.vectors(name), [self.key, "label", "split"])

    def weights(self, name: str | None = None) -> DataFrame:
        """``(key, label, split, index, weight, term)``."""
        return features.with_terms(self.entries(name), self.vocabulary, self.n_terms)


def split_documents(labelled: DataFrame, key: str = KEY) -> DataFrame:
    """``(key, label, split)``: ranks need no text, so only two columns are shuffled."""
    return split.stratified_split(joins.known_labels(labelled.select(key, "label")), key)


def split_bounds(docs: DataFrame, key: str = KEY, seed: int = lx.SEED) -> DataFrame:
    """Last hash of the test rows, and of test and validation rows, per label: one row per class.

    The seeded split is an order by hash, so these bounds say where a row belongs.
    """
    hashed = docs.withColumn("_hash", seeded_hash(seed, key))
    last = lambda *names: F.max(F.when(F.col("split").isin(*names), F.col("_hash")))
    return hashed.groupBy("label").agg(last("test").alias("_test"), last("test", "val").alias("_val"))


def with_split(df: DataFrame, bounds: DataFrame, key: str = KEY, seed: int = lx.SEED) -> DataFrame:
    """Add ``split`` to rows with a known label, without moving them."""
    placed = df.join(F.broadcast(bounds), "label").withColumn("_hash", seeded_hash(seed, key))
    split = (
        F.when(F.col("_hash") <= F.col("_test"), F.lit("test"))
        .when(F.col("_hash") <= F.col("_val"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return placed.withColumn("split", split).drop("_hash", "_test", "_val")


def fit_features(
    labelled: DataFrame,
    min_df: int = lx.MIN_DF,
    max_features: int = lx.MAX_FEATURES,
    text: str = "cleaned_text",
    key: str = KEY,
) -> Features:
    """Fit TF-IDF on the training rows and weigh all rows.

    Texts are tokenised once: the split and the words of each document, one row per document,
    are written. The vocabulary reads them, and so do the vectors, in which terms are numbers.
    """
    docs = written(split_documents(labelled, key), "split_docs")
    texts = labelled.select(key, "label", ngram_vectors.word_text(F.col(text)).alias("words"))
    placed = with_split(texts, split_bounds(docs, key), key)
    doc_words = written(placed.select(key, "label", "split", "words"), "doc_words")
    n_train = docs.filter(F.col("split") == "train").agg(F.count("*")).scalar()
    return weigh_words(docs, doc_words, n_train, min_df, max_features, key)


def weigh_words(
    docs: DataFrame, doc_words: DataFrame, n_train: F.Column,
    min_df: int = lx.MIN_DF, max_features: int = lx.MAX_FEATURES, key: str = KEY,
) -> Features:
    """Vocabulary of the training rows of ``doc_words(key, label, split, words)``, and a vector for each row."""
    train = doc_words.filter(F.col("split") == "train")
    per_term = ngram_vectors.term_candidates(train, min_df, max_features)
    return _numbered(docs, doc_words, per_term, n_train, min_df, max_features, key, ngram_vectors.tfidf_vectors)


def weigh(
    docs: DataFrame, doc_terms: DataFrame, per_term: DataFrame, n_train: F.Column,
    min_df: int = lx.MIN_DF, max_features: int = lx.MAX_FEATURES, key: str = KEY,
) -> Features:
    """Vocabulary from the counts of the training rows, and a vector for each row of ``doc_terms``."""
    return _numbered(docs, doc_terms, per_term, n_train, min_df, max_features, key, features.tfidf_rows)


def _numbered(docs, terms, per_term, n_train, min_df, max_features, key, weighed) -> Features:
    keep = [key, "label", "split"]
    vocabulary = written(
        features.with_index(features.tfidf_fit(per_term, n_train, min_df, max_features)), "vocabulary"
    )
    n_terms = vocabulary.count()
    rows = weighed(terms, vocabulary, keep, n_terms)
    numbered = rows.select(*keep, label_encode(F.col("label")).cast("double").alias("label_index"), "features")
    return Features(docs, vocabulary, models.written_vectors(numbered), n_terms, key)


def vectors(fitted: Features) -> DataFrame:
    """Model input with balanced class weights from the training rows."""
    return models.with_weights(fitted.rows, split.class_weights(fitted.part("train")))


def train_models(
    table: DataFrame,
    trees: int = 500,
    depth: int = 30,
    rounds: int = 500,
    boost_depth: int = 6,
    names: tuple[str, ...] = (
        "bow_logistic_regression", "logistic_regression", "complement_naive_bayes",
        "random_forest", "boosted_trees",
    ),
) -> dict[str, object]:
    """Fit the named models on the training rows."""
    train = table.filter(F.col("split") == "train")
    makers = {
        "bow_logistic_regression": lambda: models.logistic(train, 1.0, 1000),
        "logistic_regression": lambda: models.logistic(train, 0.1, 2000),
        "complement_naive_bayes": lambda: models.complement_nb(train, 0.5),
        "random_forest": lambda: models.random_forest(train, trees, depth),
        "boosted_trees": lambda: models.boosted_trees(train, rounds, depth=boost_depth),
    }
    return {name: makers[name]() for name in names}


def predict_all(fitted_models: dict[str, object], table: DataFrame, key: str = KEY) -> DataFrame:
    """Test-row predictions of all models and of the majority baseline, as one long table."""
    test = table.filter(F.col("split") == "test")
    train = table.filter(F.col("split") == "train")
    out = models.majority_predictions(train, test, key)
    for name, model in fitted_models.items():
        out = out.unionByName(models.predict(model, test, name, key))
    return out


def evaluate(predictions: DataFrame) -> DataFrame:
    scores = metrics.class_scores(predictions, {c: f"p_{i}" for i, c in enumerate(lx.CLASSES)})
    return metrics.evaluate_models(predictions, scores)


PREDICTED = {
    "majority_class": "majority_pred",
    "bow_logistic_regression": "bow_pred",
    "logistic_regression": "lr_pred",
    "complement_naive_bayes": "nb_pred",
    "random_forest": "rf_pred",
    "boosted_trees": "gbt_pred",
}


def train_baseline(
    spark: SparkSession, labelled: DataFrame, output_dir: str, force: bool = False, **settings: int
) -> dict[str, DataFrame]:
    """Train the six models, predict the test rows and judge the predictions.

    ``settings`` are those of the tree models (see ``train_models``; 500 trees and rounds by
    default). Tables: ``predictions`` with a row per model and test document, ``documents``
    with the split and one column per model (empty off the test rows), ``metrics`` and
    ``best``. Each is a step of the manifest, and a completed step is not run again.
    """
    manifest = f"{output_dir}/run_manifest"
    # Trained only if a step asks for it.
    made: dict[str, object] = {}

    def features_once() -> Features:
        if "features" not in made:
            made["features"] = fit_features(labelled)
        return made["features"]

    def step(name, build, metrics_=None):
        return materialize(name, build, f"{output_dir}/{name}", manifest, spark, metrics_, (), force)

    def predictions() -> DataFrame:
        data = vectors(features_once())
        return predict_all(train_models(data, **settings), data)

    predicted = step("06_predictions", predictions, {"test_rows": F.count_if(F.col("model") == "majority_class")})
    wide = step("06_documents", lambda: metrics.attach_predictions(features_once().docs, predicted, KEY, PREDICTED))
    judged = step("06_metrics", lambda: evaluate(predicted))
    best = step("06_best", lambda: metrics.best_model(judged))
    return {"predictions": predicted, "documents": wide, "metrics": judged, "best": best}


def coefficients(fitted: Features) -> DataFrame:
    """The complement naive Bayes model as a written table."""
    n_train = fitted.part("train").agg(F.count("*")).scalar()
    table = attribution.complement_coefficients(fitted.entries("train"), fitted.vocabulary, n_train, classes=tuple(lx.CLASSES))
    return written(table, "coefficients")


def contributions(fitted: Features) -> tuple[DataFrame, DataFrame]:
    """That table, and its contributions on the test rows."""
    table = coefficients(fitted)
    size = fitted.n_terms * len(lx.CLASSES)
    return table, attribution.linear_contributions(fitted.entries("test"), table, fitted.key, size)


def strongest_contributions(fitted: Features, limit: int = 20) -> DataFrame:
    """``(key, class, rank, term, contribution)``: the strongest terms of every test document and class."""
    table = coefficients(fitted)
    size = fitted.n_terms * len(lx.CLASSES)
    if size <= features.BROADCAST_ROWS:
        return attribution.strongest_in_rows(fitted.vectors("test"), table, fitted.vocabulary, fitted.key, lx.CLASSES, limit)
    # A model that is not sent to every task is joined by term.
    rows = attribution.linear_contributions(fitted.entries("test"), table, fitted.key, size)
    return attribution.strongest(rows.withColumn("contribution", F.round("contribution", 6)), fitted.key, limit).select(
        fitted.key, "class", "rank", "term", "contribution"
    )
