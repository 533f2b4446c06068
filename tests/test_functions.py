"""Edge cases of the column functions, one row each."""

import time

import pytest
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions import labels as lb
from casewright.functions import lexicon as lc
from casewright.functions import terms as tm
from casewright.functions import text as tx
from casewright.functions.rows import computed_once
from casewright.operators import curate


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


T = None


@pytest.fixture(scope="module", autouse=True)
def text_column(spark):
    global T
    T = F.col("t")  # columns need a running session


@pytest.mark.parametrize(
    "text, lexicon, expected",
    [
        ("carbon carbon", lx.PILLAR_E_TERMS, 1),
        ("sustainability", lx.SUSTAINABILITY_TERMS, 1),
        ("scope 2 and scope 4", lx.PILLAR_E_TERMS, 1),
        ("dodd-frank", lx.PILLAR_G_TERMS, 1),
        ("hypocarbon carbonate", lx.PILLAR_E_TERMS, 0),
        ("see 17 u.s.c 101", lx.NOISE_TERMS, 1),
        ("écarbon", lx.PILLAR_E_TERMS, 0),
    ],
)
def test_lexicon_hits(spark, text, lexicon, expected):
    assert value(spark, text, lc.lexicon_hits("t", lexicon)) == expected


def test_term_with_quote_and_no_literal(spark):
    assert value(spark, "the board's duty", lc.lexicon_hits("t", ["board's"])) == 1
    assert value(spark, "colour", lc.lexicon_hits("t", ["colou?r"])) == 1
    assert lc.required_literal("colou?r") is None
    assert lc.required_literal(r"17 u\.s\.c") == "17 u"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2019, 2020 and 2019", "2019"),
        ("2022 then 2021", "2022"),
        ("1999 and 20215", "unknown"),
        ("x" * 2001 + " 2021", "unknown"),
    ],
)
def test_extract_year(spark, text, expected):
    assert value(spark, text, lc.extract_year(T)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("the SECOND circuit", "2nd Cir"),
        ("Ninth Circuit, S.D. New York", "SDNY"),
        ("Nİnth Circuit", "9th Cir"),
        ("a circuit", "Other"),
    ],
)
def test_detect_court(spark, text, expected):
    assert value(spark, text, lc.detect_court(lc.fold_case(T))) == expected


def test_flag_greenwash(spark):
    assert value(spark, "AntiGreenWaſhing", lc.flag_greenwash(lc.fold_case(T))) == 1


@pytest.mark.parametrize(
    "scores, pillar, label",
    [((0, 0, 0), "Non-ESG", "Non-ESG"), ((1, 1, 1), "E", "G"), ((2, 2, 1), "E", "E"), ((0, 1, 0), "S", "S"),
     ((0, 2, 2), "S", "G")],
)
def test_label_rules(spark, scores, pillar, label):
    e, s, g = (F.lit(x) for x in scores)
    row = spark.range(1).select(lb.infer_pillar(e, s, g).alias("p"), lb.assign_label(e, s, g).alias("l")).first()
    assert (row["p"], row["l"]) == (pillar, label)


def test_encoding_is_alphabetical(spark):
    assert [value(spark, c, lb.label_encode(T)) for c in ("E", "G", "Non-ESG", "S", "?")] == [0, 1, 2, 3, None]
    assert value(spark, "Non-ESG", lb.label_decode(lb.label_encode(T))) == "Non-ESG"
    assert value(spark, "Non-ESG", lb.label_slug(T)) == "NonESG"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("this granted", "this [OUTCOME]"),
        ("granted alone", "granted alone"),
        ("GRANTED", "[OUTCOME]"),
        ("ungranted GRANTEDLY", "ungranted GRANTEDLY"),
        ("motion \n Denieds", "motion \n [OUTCOME]s"),
        ("has been  affirmed", "has been  [OUTCOME]"),
        ("court is granted", "court is [OUTCOME]"),
        ("is vacated", "is [OUTCOME]"),
        ("order dİsmissed", "order [OUTCOME]"),
    ],
)
def test_mask_outcomes(spark, text, expected):
    masked = value(spark, text, tx.mask_outcomes(T))
    assert masked == expected
    assert value(spark, masked, tx.mask_outcomes(T)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Doe, Jane 4/13/2026\nbody", "body"),
        ("see 432 F.3d 201 here", "see here"),
        ("Case No. 2:11-cv-2288 filed", "filed"),
        ("a\n2017 WL 11679600\nb", "a\n \nb"),
        ("x © 2020 Thomson Reuters. No claim to\nWorks. y", "x y"),
        ("Attorneys and Law Firms x\nJane Roe\nOPINION y", "Jane Roe\nOPINION y"),
        ("a\n\n\n\nb  \t c", "a\n\nb c"),
        ("  padded \x1c", "padded"),
    ],
)
def test_strip_headers(spark, text, expected):
    assert value(spark, text, tx.strip_headers(T)) == expected


def test_decode_drops_broken_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xffc\r\nq\rz"),)], "c binary")
    assert df.select(tx.decode_utf8(F.col("c"))).first()[0] == "abc\nq\nz"


@pytest.mark.parametrize("text, n", [("a b", 2), ("", 0), (" é  x\x1fy ", 3), ("w " * 512, 512)])
def test_token_count(spark, text, n):
    assert value(spark, text, tx.token_count(T)) == n
    assert len(value(spark, text, tx.tokens(T))) == n
    assert value(spark, text, tx.exceeds_limit(tx.token_count(T))) == 0


def test_analysis_text(spark):
    assert value(spark, "is [OUTCOME]  in 2020 a1 1 2\n3", tx.analysis_text(T)) == "is in a1"


def test_tokens_and_ngrams(spark):
    assert value(spark, "Don't año-bar x well-known-", tm.alpha_tokens(T)) == ["don't", "bar", "well-known"]
    assert value(spark, "Über a b_1", tm.word_tokens(T)) == ["über", "b_1"]
    tokens = tm.drop_words(tm.alpha_tokens(T), ["of"])
    assert value(spark, "fiduciary of duty", tm.ngrams(tokens, 2)) == ["fiduciary duty"]
    assert value(spark, "one", tm.ngrams(tm.alpha_tokens(T), 3)) == []


def test_file_names(spark):
    assert [value(spark, f, curate.case_key(T)) for f in ("001-A.b.md", "02-X", ".md", "9.md")] == ["A.b", "X", ".md", "9"]
    assert value(spark, "FoovBar.md", curate.numeric_prefix(T)) is None


def test_scores_are_not_copied_into_filters(spark):
    docs = spark.createDataFrame([("climate",)], "t string")
    scored = computed_once(docs, {"n": lc.lexicon_hits("t", ["climate"])}).filter("n > 0 AND n < 9")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") == 1
    assert scored.count() == 1


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n " * 500_000, "x" + " \t" * 500_000 + "y"])
def test_long_blank_runs_take_linear_time(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    start = time.perf_counter()
    out = df.select(tx.mask_outcomes(F.col("t")), tx.strip_header_lines(F.col("t")), tx.trim_space(F.col("t"))).first()
    assert time.perf_counter() - start < 20
    assert out[2] == text.strip()


def test_publisher_notice_takes_the_blanks_before_it(spark):
    rows = {"a  2020 Thomson Reuters. No Works. b": "a  b", "a © 2020 Thomson Reuters. X Works.b": "a  b", "a2020 Thomson Reuters. Works.": "a "}
    for text, expected in rows.items():
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(tx.strip_header_lines(F.col("t"))).first()[0] == expected


def test_only_the_wanted_scores_are_computed(spark):
    from casewright.plans.corpus import with_labels

    df = spark.createDataFrame([("f", "climate")], "filename string, text string")
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    few = with_labels(df, columns=("label",)).select("label")
    assert few.first()[0] == "E"
    assert 0 < count(few) < count(with_labels(df).select("label"))
