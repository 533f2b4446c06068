"""Cross-validation: rows equal to single fits, and finished folds are not fitted again."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import metrics, split
from casewright.plans import baseline, folds

OWN = {"E": ["carbon", "climate"], "S": ["labor", "safety"], "G": ["proxy", "board"], "Non-ESG": ["patent", "brand"]}
COMMON = ["matter", "review", "party", "record", "ruling", "order"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows = [(f"{i}.md", label, " ".join(rng.choices(OWN[label] + COMMON, k=25))) for i, label in enumerate(rng.choices(list(OWN), k=120))]
    return spark.createDataFrame(rows, "filename string, label string, cleaned_text string")


def test_folds_equal_single_fits(spark, labelled, tmp_path):
    out = str(tmp_path / "cv")
    got = folds.cross_validate(spark, labelled, out, seeds=(42, 7), folds=3)
    rows = got["predictions"].collect()
    assert len(rows) == 2 * 120
    # A single fit, from the texts, with the fold as test rows.
    placed = split.stratified_kfold(labelled, "filename", seed=7, folds=3)
    docs = placed.select("filename", "label", F.when(F.col("fold") == 2, "test").otherwise("train").alias("split"))
    from casewright.functions import terms as tm
    from casewright.operators import features

    terms = tm.ngram_range(tm.word_tokens(F.col("cleaned_text")), 1, 2)
    doc_terms = features.doc_term_arrays(labelled.join(docs.select("filename", "split"), "filename").withColumn("terms", terms), ["filename", "label", "split"])
    per_term = doc_terms.filter("split = 'train'").select(F.inline("entries")).groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df"))
    n_train = docs.filter("split = 'train'").agg(F.count("*")).scalar()
    data = baseline.vectors(baseline.weigh(docs, doc_terms, per_term, n_train))
    from casewright.operators import models

    alone = models.predict(folds.linear(data.filter("split = 'train'")), data.filter("split = 'test'"), "m", "filename")
    expected = {r["filename"]: r for r in alone.collect()}
    found = {r["filename"]: r for r in rows if (r["seed"], r["fold"]) == (7, 2)}
    assert set(found) == set(expected)
    for name, row in found.items():
        assert row["predicted"] == expected[name]["predicted"]
        assert [row[f"p_{i}"] for i in range(4)] == pytest.approx([expected[name][f"p_{i}"] for i in range(4)], abs=1e-4)
    # Scores and summary are those of the predictions.
    scores = {(r["seed"], r["fold"]): r["macro_f1"] for r in got["scores"].collect()}
    one = metrics.macro_f1(metrics.class_report(metrics.confusion_matrix(alone))).first()["macro_f1"]
    assert len(scores) == 6 and scores[7, 2] == pytest.approx(one)
    summary = {r["seed"]: r["mean"] for r in got["summary"].collect()}
    assert any(m == pytest.approx(sum(scores[7, f] for f in (1, 2, 3)) / 3) for m in summary.values())

    # A second run fits nothing.
    def broken(train):
        raise RuntimeError("fitted again")

    again = folds.cross_validate(spark, labelled, out, seeds=(42, 7), folds=3, fit=broken)
    assert again["predictions"].count() == 240
