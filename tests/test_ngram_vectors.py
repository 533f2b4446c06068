"""Vocabulary and vectors from word texts against the terms spelt out, and cleaning beside plain patterns."""

import random
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.functions import terms as tm
from casewright.functions import text as tx
from casewright.operators import features
from casewright.operators import ngram_vectors as nv
from casewright.sources.storage import written


def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["x", "Ünï", "a_b", "日本", "9"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(200)]
    return spark.createDataFrame([*rows, (None, "w1 w2 w1 w2"), (3, "w1 w2"), (900, None), (901, "")], "id bigint, text string")


def spelt_out(docs):
    terms = tm.ngram_range(tm.word_tokens(tx.fill_text(F.col("text"))), 1, 2)
    return features.doc_term_arrays(written(docs.select("id", terms.alias("terms")), "terms"), ["id"])


@pytest.mark.parametrize("min_df, limit, known", [(3, 50, 10_000), (1, 10_000, 10_000), (3, 50, 3)])
def test_terms_and_vectors(spark, min_df, limit, known):
    docs = corpus(spark)
    texts = docs.select("id", nv.word_text(F.col("text")).alias("words"))
    plain = spelt_out(docs)
    counts = plain.select(F.inline("entries")).groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df"))
    expected = features.with_index(features.tfidf_fit(counts, F.lit(204), min_df, limit)).orderBy("index").collect()
    found = nv.term_candidates(texts, min_df, limit, known=known)
    vocabulary = features.with_index(features.tfidf_fit(found, F.lit(204), min_df, limit))
    assert vocabulary.orderBy("index").collect() == expected and len(expected) > 40
    n = len(expected)
    key = lambda r: repr(r)
    rows = sorted(nv.tfidf_vectors(texts, vocabulary, ["id"], n).collect(), key=key)
    assert rows == sorted(features.tfidf_rows(plain, vocabulary, ["id"], n).collect(), key=key)


def test_terms_that_share_a_hash(spark):
    """With 32 hashes the bound of the first pass is too high, and is lowered."""
    texts = corpus(spark).select(nv.word_text(F.col("text")).alias("words"))
    found = nv.term_candidates(texts, 3, 20, bits=5)
    counts = spelt_out(corpus(spark)).select(F.inline("entries")).groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df"))
    top = lambda c: features.vocab_top_k(c, 3, 20).select("term", "count", "df").collect()
    assert top(found) == top(counts)


def test_slices_add_up(monkeypatch):
    texts = pa.RecordBatch.from_pydict({"words": ["ab cd ab", "", "cd ab cd", "x ab ab ab"] * 5})

    def total():
        sums = {}
        for part in nv._counter(None)(iter([texts])):
            for h, count, df in zip(*(c.to_pylist() for c in part.columns)):
                old = sums.get(h, (0, 0))
                sums[h] = old[0] + count, old[1] + df
        return sums

    whole = total()
    monkeypatch.setattr(nv, "SLICE_BYTES", 9)
    assert total() == whole and sorted(whole.values()) == [(10, 5), (10, 10), (10, 10), (15, 10), (30, 15)]


def test_empty(spark):
    texts = corpus(spark).select("id", nv.word_text(F.lit("")).alias("words"))
    found = nv.term_candidates(texts, 3, 20)
    assert found.collect() == []
    vocabulary = features.with_index(features.tfidf_fit(found, F.lit(1)))
    assert {tuple(r["features"]["indices"]) for r in nv.tfidf_vectors(texts, vocabulary, ["id"], 0).collect()} == {()}


def test_terms_are_counted_without_spelling_them_out(spark, monkeypatch):
    """Before, every n-gram of every document became a string; now only those of the vocabulary do."""
    from casewright.plans import baseline

    def broken(*args, **kwargs):
        raise AssertionError("all terms spelt out")

    monkeypatch.setattr(features, "doc_term_arrays", broken)
    docs = corpus(spark).filter("id < 200").select(F.col("id").cast("string").alias("filename"), F.lit("E").alias("label"), F.col("text").alias("cleaned_text"))
    assert baseline.fit_features(docs, 2, 30).n_terms == 30


def test_cleaning_equals_plain_patterns(spark):
    rng = random.Random(5)
    parts = [
        "  ", "Thomson", " Reuters. x Works.", " 2019 ", "© 2020 Thomson Reuters. No Works.", "FOR EDUCATIONAL UſE ONLY", "\n\n\n\n", " ",
        " Only the Weſtlaw citation is currently available. ", "12/3/2020", "was granted", "DENIED", " motion iſ diſmiſſed ", " \t",
        "Attorneys and Law Firms foo\nBAR", "\x1c", "court  affirmed", "　", "\x85", "is denied ", "order vacateD",
    ]
    rows = [("".join(rng.choices(parts, k=rng.randrange(12))),) for _ in range(2_000)]
    docs = spark.createDataFrame([*rows, (None,), ("",), (" ",)], "text string")
    space = r"[\s\x1c-\x1f]"
    stripped = reduce(lambda t, p: F.regexp_replace(t, p, " "), tx.HEADER_PATTERNS, F.col("text"))
    blanks = F.regexp_replace(F.regexp_replace(stripped, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    plain = tx.mask_outcomes(F.regexp_replace(blanks, rf"(?U)\A{space}+|(?<!{space}){space}+\z", ""))
    assert docs.filter(~tx.clean_text(F.col("text")).eqNullSafe(plain)).count() == 0


def test_tasks_send_arrays_and_no_row_per_term(spark, monkeypatch):
    """Before, the first pass sent a row for every term of four megabytes of text."""
    texts = pa.RecordBatch.from_pydict({"words": [f"aa{i} bb{i} aa{i}" for i in range(3_000)]})
    monkeypatch.setattr(nv, "SLICE_BYTES", 1_000)
    rows = [r for part in nv._bucket_counter(10, 6)(iter([texts])) for r in part.to_pylist()]
    assert len(rows) == 16
    assert sum(sum(memoryview(r["counts"]).cast("I")) for r in rows) == 5 * 3_000
    # The counts by hash are for buckets that are too evenly filled.
    monkeypatch.setattr(nv, "_by_hashes", None)
    found = nv.term_candidates(corpus(spark).select(nv.word_text(F.col("text")).alias("words")), 3, 50)
    assert features.vocab_top_k(found, 3, 50).count() == 50


@pytest.mark.parametrize("bits", [3, 7])
def test_full_buckets_lower_the_bound(spark, monkeypatch, bits):
    monkeypatch.setattr(nv, "BUCKET_BITS", bits)
    texts = corpus(spark).select(nv.word_text(F.col("text")).alias("words"))
    counts = spelt_out(corpus(spark)).select(F.inline("entries")).groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df"))
    top = lambda c: features.vocab_top_k(c, 3, 40).select("term", "count", "df").collect()
    for known in (4, 10_000):
        assert top(nv.term_candidates(texts, 3, 40, known=known)) == top(counts)


def test_header_patterns_run_only_where_they_can_match(spark):
    """Before, six of the ten ran over every text."""
    assert {*tx._HELD, *tx._HELD_AS_IS} == {*tx.HEADER_PATTERNS}
    rng = random.Random(6)
    parts = [
        "J. Doe 1/2/2020", "\n", "2019 WL 33", "12 F.3d 4", "5 S.Ct. 6", "7 U.S. 8", "9 L.Ed.2d 1", "3 F.Supp.2 44", "2 U.S. Dist. LEXIS 7", "| ",
        "|", "Signed 01/02/2020", "caſe No. a:b-1", "CASE NO 7", "For Educational Use Only", "F", ".", "W", "L 4", "Sig", "ned", " ", "\t", "\n\n",
        "is", "GRANTED", " granted", " vacated", "order", "x",
    ]
    rows = [("".join(rng.choices(parts, k=rng.randrange(14))),) for _ in range(3_000)]
    docs = spark.createDataFrame([*rows, (None,)], "text string")
    stripped = reduce(lambda t, p: F.regexp_replace(t, p, " "), tx.HEADER_PATTERNS, F.col("text"))
    blanks = tx.trim_space(F.regexp_replace(F.regexp_replace(stripped, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))
    context = tx._CONTEXT.replace(r"(?=\s)(?<!\s)", r"(?<!\s)")
    masked = F.regexp_replace(F.regexp_replace(blanks, context, "$1[OUTCOME]"), tx._CAPS, "[OUTCOME]")
    assert docs.filter(~tx.strip_headers(F.col("text")).eqNullSafe(blanks)).count() == 0
    assert docs.filter(~tx.clean_text(F.col("text")).eqNullSafe(masked)).count() == 0
    assert docs.filter(masked.contains("[OUTCOME]")).count() > 20 and docs.filter(blanks != tx.collapse_whitespace(F.col("text"))).count() > 200
