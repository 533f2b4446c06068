"""Every query against its SQL statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert {r["label"]: r["n"] for r in entry_point.entry(spark).collect()} == {"E": 60, "S": 20, "G": 60, "Non-ESG": 20}


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


def test_top_ngrams_cleans_texts_once(spark, monkeypatch):
    """The tokens are read for the hashes and again for the winners; both read a table, not the texts."""
    from casewright.operators import features
    from casewright.plans import catalog

    seen = []
    monkeypatch.setattr(features, "ngram_tables", lambda docs: seen.append(docs) or docs)
    catalog.top_ngrams(spark, "/root/testdata/sf0.001")
    assert not any("documents.parquet" in f for f in seen[0].inputFiles())
