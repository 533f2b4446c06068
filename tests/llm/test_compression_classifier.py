"""Held-out accuracy of the compression classifier, and its odd inputs."""

import random
import zlib

from casewright.llm import compression_classifier as cc

LABELS = "doc_id bigint, quality int, toxic int"
DOCS = "doc_id bigint, text string, score string"


def corpus(n=600, seed=2):
    r = random.Random(seed)
    good = ["river", "stone", "window", "letter", "garden", "quiet", "the", "and", "of", "under"]
    bad = ["BUY!!", "###", "$$$", "click", "NOW!!", "%%%", "win|", "|free"]
    docs, labels = [], []
    for i in range(n):
        q = int(i % 4 != 0)
        words = r.choices(good if q else bad + good[:3], k=r.randrange(20, 400))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, q, 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, DOCS)
    model = cc.fit(table, spark.createDataFrame(labels, LABELS))
    rows = {r["doc_id"]: r for r in cc.scored(table, model).collect()}
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    hits = [rows[i]["predicted"] == q for i, q, _ in labels if rows[i]["held_out"]]
    assert sum(hits) >= 0.97 * len(hits)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(200)
    table = spark.createDataFrame(docs, DOCS)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    one, other = (cc.fit(table, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one == other


def test_nulls_long_texts_and_missing_classes(spark):
    docs, labels = corpus(120)
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "river " * 200_000, "b")], DOCS)
    model = cc.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    rows = cc.scored(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    good = spark.createDataFrame([x for x in labels if x[1] == 1], LABELS)
    assert {r["score"] for r in cc.scored(odd, cc.fit(spark.createDataFrame(docs, DOCS), good)).collect()} == {1.0}
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in cc.scored(odd, cc.fit(odd, none)).collect()} == {0.5}
    assert cc.scored(spark.createDataFrame([], DOCS), model).count() == 0
