"""Baseline classifiers on TF-IDF vectors and on embeddings."""

from __future__ import annotations

from pyspark.ml.classification import (
    LogisticRegression,
    NaiveBayes,
)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import lexicons as lx
from casewright.functions.labels import label_decode
from casewright.operators import boosting, forest
from casewright.sources.storage import scratch_path


def written_vectors(rows: DataFrame, name: str = "tfidf_vectors") -> DataFrame:
    """Rows whose ``features`` have the layout of a sparse vector, written and read back as vectors.

    Every model reads the table many times, and a lost executor then costs a re-read and no
    re-tokenising.
    """
    schema = T.StructType([T.StructField(f.name, VectorUDT()) if f.name == "features" else f for f in rows.schema.fields])
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def with_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Add the class weight to each row; one row per class is broadcast."""
    return df.join(F.broadcast(weights.select(label, "weight")), label)


def logistic(train: DataFrame, c: float, max_iter: int = 1000, weighted: bool = True):
    """Multinomial logistic regression with an L2 penalty of strength 1/c.

    Spark averages the loss over the summed weights, hence the divisor.
    """
    total = train.agg(F.sum("weight") if weighted else F.count("*")).first()[0]
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="label_index",
        family="multinomial",
        regParam=1.0 / (c * float(total)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    )
    if weighted:
        lr = lr.setWeightCol("weight")
    return lr.fit(train)


def complement_nb(train: DataFrame, alpha: float = 0.5):
    return NaiveBayes(
        featuresCol="features", labelCol="label_index", modelType="complement", smoothing=alpha
    ).fit(train)


def random_forest(train: DataFrame, trees: int = 500, depth: int = 30, seed: int = lx.SEED) -> forest.Forest:
    return forest.fit(train, len(lx.CLASSES), trees, depth, seed)


def boosted_trees(train: DataFrame, rounds: int = 500, rate: float = 0.05, depth: int = 6) -> boosting.BoostedTrees:
    """One softmax over all classes, a tree per class and round."""
    return boosting.fit(train, len(lx.CLASSES), rounds, rate, depth)


def embedding_pca_2d(df: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """Embeddings projected on their first two principal components."""
    vectors = df.select(key, label, array_to_vector(F.col(embedding)).alias("features"))
    projected = PCA(k=2, inputCol="features", outputCol="xy").fit(vectors).transform(vectors)
    xy = vector_to_array("xy")
    return projected.select(key, label, xy[0].alias("x"), xy[1].alias("y"))


def predict(model, df: DataFrame, name: str, key: str, label: str = "label") -> DataFrame:
    """Predictions with one score column ``p_<index>`` per class.

    Probabilities where the model gives them, else its raw scores.
    """
    out = model.transform(df)
    scores = "probability" if "probability" in out.columns else "rawPrediction"
    p = vector_to_array(scores)
    return out.select(
        F.lit(name).alias("model"),
        key,
        F.col(label).alias("actual"),
        label_decode(F.col("prediction")).alias("predicted"),
        *[F.get(p, F.lit(i)).alias(f"p_{i}") for i in range(len(lx.CLASSES))],
    )


def majority_predictions(train: DataFrame, test: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Every test row gets the most frequent training label, with certainty."""
    from casewright.operators.split import majority_class

    top = majority_class(train, label).select(label).scalar()
    return test.select(
        F.lit("majority_class").alias("model"),
        key,
        F.col(label).alias("actual"),
        top.alias("predicted"),
    ).withColumns(
        {
            f"p_{i}": (F.col("predicted") == F.lit(c)).cast("double")
            for i, c in enumerate(lx.CLASSES)
        }
    )


def feature_importance(model, vocabulary: DataFrame) -> DataFrame:
    """Tree importances by term, zero importances left out; of a forest or of boosted trees.

    A model holds at most one value per vocabulary entry, so the list is as
    bounded as the vocabulary.
    """
    spark = vocabulary.sparkSession
    pairs = sorted(model.importance().items())
    values = spark.createDataFrame(pairs, "index int, importance double")
    return vocabulary.select("index", "term").join(values, "index").select("term", "importance")


def top_features(importance: DataFrame, limit: int = 20) -> DataFrame:
    ordered = importance.orderBy(F.desc("importance"), F.asc("term")).limit(limit)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("importance"), F.asc("term")))
    return ordered.withColumn("rank", rank)
