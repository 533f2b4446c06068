"""Splits, ranks, metrics and features against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.operators import attribution, features, metrics, split
from casewright.operators.ranking import running_totals
from casewright.plans import baseline

SIZES = {"G": 171, "Non-ESG": 134, "E": 92, "S": 47}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"{label}-{i}.md", label) for label, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "filename string, label string")


def test_split_has_published_sizes(labelled):
    parts = split.stratified_split(labelled, "filename")
    counts = {(r["split"], r["label"]): r["count"] for r in parts.groupBy("split", "label").count().collect()}
    totals = Counter()
    for (name, _), n in counts.items():
        totals[name] += n
    assert totals == {"train": 310, "val": 67, "test": 67}
    assert [counts["test", c] for c in ("E", "G", "Non-ESG", "S")] == [14, 26, 20, 7]
    assert parts.select("filename").distinct().count() == 444


def test_folds_are_even_per_class(labelled):
    folds = split.repeated_kfold(labelled, "filename")
    for row in folds.groupBy("seed", "label", "fold").count().collect():
        assert abs(row["count"] - SIZES[row["label"]] / 3) < 1
    assert folds.count() == 3 * 444


def test_class_weights_and_majority(labelled):
    weights = {r["label"]: r["weight"] for r in split.class_weights(labelled).collect()}
    assert weights["S"] == pytest.approx(444 / (4 * 47))
    assert split.majority_class(labelled).first()["label"] == "G"


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_crowded_bins(spark, descending):
    rng = random.Random(1)
    # Nearly all values in a sliver of the range, and one far away.
    values = sorted({rng.random() * 1e-6 for _ in range(500)} | {5.0})
    rows = [("m", v, rng.randint(0, 3)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    out = running_totals(df, ["g"], "v", ["n"], descending)
    got = {r["v"]: (r["cum_n"], r["total_n"]) for r in out.collect()}
    total, run = sum(n for _, _, n in rows), 0
    for _, v, n in (reversed(rows) if descending else rows):
        run += n
        assert got[v] == (run, total)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics_against_brute_force(spark):
    rng = random.Random(7)
    classes = lx.CLASSES
    rows = []
    for i in range(300):
        actual = rng.choice(classes)
        p = [round(rng.random(), 1) for _ in classes]
        rows.append(("m", i, actual, rng.choice([actual, "E", "G"]), *p))
    df = spark.createDataFrame(rows, "model string, k int, actual string, predicted string, p_0 double, p_1 double, p_2 double, p_3 double")
    got = baseline.evaluate(df).first()
    f1s, aucs = [], []
    for i, c in enumerate(classes):
        hits = sum(r[2] == r[3] == c for r in rows)
        f1s.append(2 * hits / (sum(r[2] == c for r in rows) + sum(r[3] == c for r in rows)))
        aucs.append(brute_auc([(r[2] == c, r[4 + i]) for r in rows]))
    assert got["macro_f1"] == pytest.approx(sum(f1s) / 4)
    assert got["auc_macro"] == pytest.approx(sum(aucs) / 4)
    n = len(rows)
    t, p = Counter(r[2] for r in rows), Counter(r[3] for r in rows)
    correct = sum(r[2] == r[3] for r in rows)
    top = correct * n - sum(t[c] * p[c] for c in classes)
    bottom = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    assert got["mcc"] == pytest.approx(top / bottom)


def test_single_predicted_class(spark):
    df = spark.createDataFrame([("m", "E", "E", 1.0), ("m", "G", "E", 1.0)], "model string, actual string, predicted string, s double")
    confusion = metrics.confusion_matrix(df)
    assert confusion.count() == 16
    assert metrics.mcc_multiclass(confusion).first()["mcc"] == 0.0
    report = {r["class"]: r for r in metrics.class_report(confusion).collect()}
    assert report["S"]["precision"] == 0.0 and report["S"]["f1"] == 0.0
    scores = metrics.class_scores(df, {"E": "s"})
    assert metrics.auc_ovr(scores).first()["auc"] == 0.5


def test_fold_summary_population_deviation(spark):
    rows = [(42, 0.4265), (42, 0.3842), (42, 0.4270)]
    out = {r["seed"]: r for r in metrics.fold_summary(spark.createDataFrame(rows, "seed int, macro_f1 double")).collect()}
    assert round(out["42"]["mean"], 4) == 0.4126 and round(out["42"]["std"], 4) == 0.0201


def documents(n=60):
    rng = random.Random(3)
    words = ["air", "law", "duty", "fund", "mine", "wage", "note", "plan", "code", "bond"]
    return [(f"d{i}", rng.choice(lx.LABELS), [rng.choice(words[: 3 + i % 8]) for _ in range(rng.randint(0, 30))]) for i in range(n)]


def test_term_counts(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "filename string, label string, terms array<string>")
    count, df_ = Counter(), Counter()
    for _, label, terms in rows:
        count.update((label, t) for t in terms)
        df_.update((label, t) for t in set(terms))
    got = {(r["label"], r["term"]): (r["count"], r["df"]) for r in features.term_counts(df, ["label"]).collect()}
    assert got == {k: (count[k], df_[k]) for k in count}
    tf = {(r["filename"], r["term"]): r["tf"] for r in features.doc_term_counts(df, ["filename"]).collect()}
    assert tf == {(f, t): n for f, _, terms in rows for t, n in Counter(terms).items()}


def test_tfidf_nb_and_attribution_agree(spark):
    rows = [(f, label, " ".join(t)) for f, label, t in documents(120)]
    labelled = spark.createDataFrame(rows, "filename string, label string, cleaned_text string")
    fitted = baseline.fit_features(labelled, min_df=2, max_features=40)
    part = {r["filename"]: (r["split"], r["label"]) for r in fitted.docs.collect()}
    grams = {}
    for f, _, text in rows:
        w = text.split()
        grams[f] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    train = [f for f, (s, _) in part.items() if s == "train"]
    total, df = Counter(), Counter()
    for f in train:
        total.update(grams[f])
        df.update(set(grams[f]))
    vocabulary = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:40]
    assert {r["term"] for r in fitted.vocabulary.collect()} == set(vocabulary)
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in vocabulary}
    expected = defaultdict(dict)
    for f, counts in grams.items():
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected[f] = {t: v / norm for t, v in raw.items()}
    got = defaultdict(dict)
    for r in fitted.weights().collect():
        got[r["filename"]][r["term"]] = r["weight"]
    for f in grams:
        assert got[f] == pytest.approx(expected[f])

    # Coefficients in closed form equal the fitted model; contributions add up to the score.
    table = baseline.vectors(fitted)
    model = baseline.train_models(table, names=("complement_naive_bayes",))["complement_naive_bayes"]
    coefficients, contributions = baseline.contributions(fitted)
    order = {r["term"]: r["index"] for r in fitted.vocabulary.collect()}
    for r in coefficients.collect():
        assert r["coef"] == pytest.approx(model.theta.toArray()[lx.CLASSES.index(r["class"])][order[r["term"]]])
    coef = {(r["class"], r["term"]): r["coef"] for r in coefficients.collect()}
    mean = {r["term"]: r["mean_weight"] for r in coefficients.collect()}
    base = {r["class"]: r["base_score"] for r in attribution.base_scores(coefficients).collect()}
    sums = {(r["filename"], r["class"]): r["s"] for r in contributions.groupBy("filename", "class").agg(F.sum("contribution").alias("s")).collect()}
    for (f, c), s in sums.items():
        score = sum(w * coef[c, t] for t, w in expected[f].items())
        absent = sum(-coef[c, t] * mean[t] for t in vocabulary if t not in expected[f])
        assert s + absent == pytest.approx(score - base[c])


def test_model_job_end_to_end(spark, tmp_path):
    """Six models trained, their predictions written and judged, and not trained twice."""
    from casewright.plans import baseline

    rng = random.Random(3)
    own = {"E": ["carbon", "climate"], "S": ["labor", "safety"], "G": ["proxy", "board"], "Non-ESG": ["patent", "brand"]}
    common = ["matter", "review", "party", "record", "ruling"]
    rows = [
        (f"{i}.md", label, " ".join(rng.choices(own[label] + common, k=40)))
        for i, label in enumerate(rng.choices(list(own), k=160))
    ]
    labelled = spark.createDataFrame(rows, "filename string, label string, cleaned_text string")
    out = str(tmp_path / "models")
    tables = baseline.train_baseline(spark, labelled, out, trees=5, depth=4, rounds=2, boost_depth=2)
    documents = tables["documents"].collect()
    assert len(documents) == 160
    for row in documents:
        filled = [row[c] != "" for c in baseline.PREDICTED.values()]
        assert all(filled) if row["split"] == "test" else not any(filled)
    scores = {r["model"]: r["macro_f1"] for r in tables["metrics"].collect()}
    assert set(scores) == set(baseline.PREDICTED)
    assert scores["logistic_regression"] > scores["majority_class"]
    assert scores[tables["best"].first()["model"]] == max(scores.values())
    again = baseline.train_baseline(spark, None, out)
    assert again["predictions"].count() == tables["predictions"].count()


def test_split_by_bounds_is_the_ranked_split(spark):
    from casewright.plans import baseline

    docs = spark.range(500).select(F.col("id").cast("string").alias("filename"), F.element_at(F.array(*map(F.lit, "ESG")), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    ranked = split.stratified_split(docs, "filename")
    placed = baseline.with_split(docs, baseline.split_bounds(ranked))
    assert placed.select("filename", "label", "split").exceptAll(ranked.select("filename", "label", "split")).count() == 0
