"""Copies by source, determinism, and the distribution of draws."""

from collections import Counter

from casewright.llm import source_mixing as sm

SCHEMA = "doc_id bigint, text string, source string, copy string"


def docs_of(spark, n=3000):
    rows = [(i, "x" * 99, "hot" if i % 3 else f"s{i % 9}", "clash") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_reach_the_weights(spark):
    out = sm.mixed(docs_of(spark), {"hot": 1, "s0": 1, "s3": 2}, epochs=2.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    rows = out.collect()
    counts = Counter(r["source"] for r in rows)
    assert set(counts) == {"hot", "s0", "s3"}
    for source, share in (("hot", 0.25), ("s0", 0.25), ("s3", 0.5)):
        assert abs(counts[source] / 6000 - share) < 0.03
    # Copies of a document are numbered from 1, and the order is that of the key within each partition.
    by_doc = Counter(r["doc_id"] for r in rows)
    assert all(r["copy"] <= by_doc[r["doc_id"]] for r in rows)
    assert sm.mixed(docs_of(spark), {"hot": 1, "s0": 1, "s3": 2}, epochs=2.0).count() == len(rows)


def test_draws_are_poisson(spark):
    docs = spark.createDataFrame([(i, "y", "a", "") for i in range(4000)], SCHEMA)
    for mean in (0.5, 40.0):
        counts = Counter(Counter(r["doc_id"] for r in sm.mixed(docs, epochs=mean).select("doc_id").collect()).values())
        draws = [k for k, n in counts.items() for _ in range(n)]
        draws += [0] * (4000 - len(draws))
        average = sum(draws) / 4000
        variance = sum((d - average) ** 2 for d in draws) / 4000
        assert abs(average - mean) < 0.05 * mean + 0.02 and abs(variance - mean) < 0.1 * mean + 0.02


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None), (1, "", "s", "x"), (1, "", "s", "x"), (2, "t" * 100_000, "s", None)]
    out = sm.mixed(spark.createDataFrame(rows, SCHEMA), {"": 1.0, "s": 1.0}).collect()
    assert {r["doc_id"] for r in out} <= {None, 1, 2}
    assert sm.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_join_by_salt_gives_the_same(spark, monkeypatch):
    key = lambda df: sorted((r["doc_id"], r["copy"]) for r in df.collect())
    direct = key(sm.mixed(docs_of(spark, 300)))
    monkeypatch.setattr(sm, "BROADCAST_SOURCES", 0)
    assert key(sm.mixed(docs_of(spark, 300))) == direct
