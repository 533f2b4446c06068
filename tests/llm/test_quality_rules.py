"""Counts against a plain scan, verdicts against minimum-covariance-determinant steps in numpy."""

import random
import re

import numpy as np

from casewright.llm import quality_rules as qr

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(f"[^{SPACE}]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


TEXTS = [
    None, "", " \t\n", "a b c", "a b c a b c", "x " * 70, "é𝄞 ü z " * 20, "line\nline\n\nother\nline", "#*$%&|<> a",
    "w " * 30_000, " ".join(f"w{i}" for i in range(20_000)), "a a a a b a a a", "\x0bq\x0cr\x85s",
]


def corpus(seed=3, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdefghi") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(60, 200))]
        if i % 29 == 0:
            words = [w + r.choice(["###", "%%%", "&&&"]) for w in words]
        lang, source = ("en", "hot") if i % 3 else ("de", f"s{i % 4}")
        rows.append((i, " ".join(words), None if i % 50 == 1 else lang, source, 1))
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, kept int"


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(TEXTS)], SCHEMA)
    rows = {r["doc_id"]: r for r in qr.judged(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text), i
        assert not (r["base_failed"] and r["kept"])


def estimate(x):
    """The three starts and their steps on one group, and the estimate of least determinant."""
    floor = np.diag([s * s for s in qr.SPREAD.values()])
    lower = lambda v: np.sort(v, axis=0)[(len(x) + 1) // 2 - 1]
    middle = lower(x)
    scale = np.sqrt((1.4826 * lower(np.abs(x - middle))) ** 2 + np.diag(floor))
    z = np.cov(np.tanh((x - middle) / scale).T, bias=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        bounded = np.nan_to_num(z / np.sqrt(np.outer(np.diag(z), np.diag(z)))) * np.outer(scale, scale)
    np.fill_diagonal(bounded, scale**2)
    def steps(centre, scatter, count):
        for _ in range(count):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            core = x[d <= np.sort(d)[int(np.ceil(qr.CORE_SHARE * len(d))) - 1] + 1e-12]
            centre, scatter = core.mean(axis=0), qr.core_factor() * np.cov(core.T, bias=True) + floor
        return np.linalg.det(scatter), centre, scatter

    starts = (middle, np.diag(scale**2)), (x.mean(axis=0), np.cov(x.T, bias=True) + floor), (middle, bounded)
    _, centre, scatter = min((steps(*s, qr.FIRST_STEPS) for s in starts), key=lambda f: f[0])
    return steps(centre, scatter, qr.STEPS - qr.FIRST_STEPS)


def distances(x):
    _, centre, scatter = estimate(x)
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)


def test_least_determinant_against_numpy(spark):
    """Groups with a third of outliers in one place, where starts end in different hollows."""
    rng = np.random.default_rng(1)
    groups = {}
    for name, (share, far) in {"clean": (0, 0), "few": (0.1, 3), "third": (0.24, 1.0), "wide": (0.2, 0.4)}.items():
        x = rng.normal(0, [0.2, 0.1, 0.3, 0.2], (400, 4))
        x[:, 1] += 0.8 * x[:, 0]
        bad = rng.random(400) < share
        x[bad] = rng.normal(far, 0.02, (int(bad.sum()), 4))
        groups[name] = x
    rows = [("", name, *map(float, v)) for name, x in groups.items() for v in x]
    vectors = spark.createDataFrame(rows, "_lang string, _source string, " + ", ".join(f"{n} double" for n in qr.NAMES))
    got = {r["_source"]: r for r in qr.robust_estimates(vectors).collect()}
    for name, x in groups.items():
        det, centre, _ = estimate(x)
        assert got[name]["det"] <= det * 1.01 and got[name]["det"] >= det * 0.9, name
        assert np.allclose([got[name][f"m{i}"] for i in range(4)], centre, atol=0.02), name


def test_outliers_against_numpy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in qr.judged(docs).collect()}
    hot = [(i, t) for i, t, lang, source, _ in rows if source == "hot" and lang == "en"]
    stats = []
    for _, t in hot:
        n, chars, symbols, dup, rep, _ = plain(t)
        stats.append([np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / 1), np.sqrt(rep / n)])
    for (i, _), d in zip(hot, distances(np.array(stats))):
        assert abs(got[i]["distance"] - d) < 0.02 * max(d, 1), i
    rejected = {i for i, r in got.items() if not r["kept"]}
    assert rejected == {i for i, *_ in rows if i % 29 == 0}


def test_kept_documents(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = qr.kept_documents(docs)
    assert kept.columns == docs.columns
    judged = qr.judged(docs).filter("kept").select("doc_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in judged.collect())
    twice = docs.union(docs)
    assert qr.kept_documents(twice).count() == 2 * kept.count()


def test_empty_and_quantile(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert qr.judged(empty).count() == 0 and qr.kept_documents(empty).count() == 0
    # Tail probabilities of the chi-square distribution with four dimensions.
    assert abs(qr.chi2_quantile_even(0.05, 4) - 9.4877) < 1e-3
    assert abs(qr.chi2_quantile_even(0.001, 4) - 18.4668) < 1e-3
