"""Links and classes against all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

from casewright.llm import jaccard_join as jj

SCHEMA = "doc_id bigint, text string, _row int, class_id string"


def shingles(text):
    w = (text or "").split()
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(jj.WORDS)))) if len(w) >= jj.WORDS else frozenset([tuple(w)])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(5000))
    passage = [word() for _ in range(60)]
    rows = [None, "", "  ", "a b", "a b", "a b c"]
    for _ in range(25):
        base = [word() for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, 8)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([*passage, *[word() for _ in range(100)]]) for _ in range(40)]
    # A large group of near copies.
    hot = [word() for _ in range(150)]
    for _ in range(90):
        copy = list(hot)
        copy[r.randrange(150)] = word()
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("limit", [1024, 16])
def test_against_all_pairs(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(jj, "LIMIT", limit)  # a small limit splits buckets and compares blocks
    rows = corpus()
    docs = table(spark, tmp_path, rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.joined(docs).collect()}
    assert got == plain(rows)
    kept = jj.deduplicated(docs)
    assert kept.columns == docs.columns
    # Texts without words are no copies of anything.
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (c, _) in plain(rows).items() if d == c)


def test_shuffled_instead_of_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_ROWS", 0)
    rows = corpus(7)[:60]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.joined(table(spark, tmp_path, rows)).collect()}
    assert got == plain(rows)


def test_empty_and_runs(spark, tmp_path):
    docs = table(spark, tmp_path, [])
    assert jj.joined(docs).count() == 0 and jj.deduplicated(docs).count() == 0
    assert jj.runs_for(0.999) < jj.runs_for(0.99999)


def test_pairs_of_a_shared_passage_and_a_tail(spark, tmp_path, monkeypatch):
    """Most of a text is a passage that many share, its near copy has a tail of its own, J = 0.8."""
    monkeypatch.setattr(jj, "LIMIT", 16)
    r = random.Random(3)
    word = lambda: "w" + str(r.randrange(10**9))
    rows = []
    for _ in range(12):
        passage = [word() for _ in range(54)]
        for _ in range(40):
            first = [*passage, *[word() for _ in range(50)]]
            rows += [first, [*first, *[word() for _ in range(25)]]]
    rows = list(enumerate(map(" ".join, rows)))
    assert {len(shingles(rows[0][1])), len(shingles(rows[1][1]))} == {100, 125}
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jj.joined(table(spark, tmp_path, rows)).collect()}
    assert got == plain(rows) and {n for _, n in got.values()} == {1}


def test_buckets_of_a_pair_with_large_buckets(spark, monkeypatch):
    """Keys in large buckets are split for every set, whatever their share of its keys."""
    monkeypatch.setattr(jj, "LIMIT", 16)
    # Sets 0 and 1 share one key of four, which 20 sets have, and one key under it.
    rows = [(i, 10, 1, [7, 100 + 3 * i, 101 + 3 * i, 102 + 3 * i], [50 if i < 2 else 1000 + i], [0]) for i in range(20)]
    reps = spark.createDataFrame(rows, "_row bigint, _n int, _copies bigint, _keys array<bigint>, _under array<bigint>, _parent array<bigint>")
    assert {(x["_key"], x["_row"]) for x in jj.bucket_rows(reps).collect()} == {(50, 0), (50, 1)}


def test_recall_with_large_buckets_only():
    """Drawn key counts of a pair at the threshold whose shared keys are all in large buckets."""
    rng, n, runs = np.random.default_rng(5), 4_000_000, jj.runs_for()
    shared, a, b = rng.poisson(runs * jj.RATE * 0.8, n), rng.poisson(runs * jj.RATE * 0.2, n), rng.poisson(runs * jj.RATE * 0.2, n)
    met = rng.poisson(shared * jj.SPLIT_RATE * 0.8) > 0
    compared = shared >= np.maximum(1, jj.LEAST_SHARED * (shared + np.minimum(a, b)))
    assert (~(met & compared)).mean() < 1e-5


def test_packed_shingles():
    hashes = np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64)
    assert np.array_equal(jj._unpack(jj._pack(hashes)), np.unique(hashes >> np.uint64(16)))
    assert len(jj._unpack(jj._pack(hashes[:0]))) == 0


def test_intersections_by_blocks_of_values():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    got = jj._common(sets, 64)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_a_bucket_of_many_keys_takes_little_memory():
    """2,048 sets that share 40,000 keys: a column for each of them would take 330 MB."""
    rng = np.random.default_rng(3)
    met = [np.unique(rng.integers(0, 40_000, 60)) + 10 for _ in range(2048)]
    keys = [np.unique(rng.integers(100_000, 100_400, 8)) for _ in range(2048)]
    n, block = np.full(2048, 50.0), np.zeros(2048, int)
    tracemalloc.start()
    found = jj._candidates(50_000, False, block, n, keys, met)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6
    few = [set(k.tolist()) for k in keys]
    before = [set(m.tolist()) for m in met]
    expected = {
        (a, b) for a in range(60) for b in range(a + 1, 2048)
        if len(few[a] & few[b]) >= max(1, jj.LEAST_SHARED * min(len(few[a]), len(few[b]))) and not before[a] & before[b]
    }
    assert {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(found))) if a < 60} == expected and expected
    # Lists without a value share nothing.
    assert not jj._candidates(0, False, block[:3], n[:3], keys[:3], [np.zeros(0, np.int64)] * 3)[np.tril_indices(3)].any()


def test_keys_under_buckets_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Tables that are made by joins leave the many keys under the buckets, and whose they are, where they are."""
    monkeypatch.setattr(jj, "LIMIT", 8)
    tables, write = {}, jj.written
    monkeypatch.setattr(jj, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "one two three four five six " + "x" * (i % 3)) for i in range(40)], "doc_id bigint, text string").write.parquet(path)
    assert jj.joined(spark.read.parquet(path)).count() == 40
    assert {"_under", "_parent"} <= set(tables["jaccard-sketches"].columns)
    assert not {"_under", "_parent"} & set(tables["jaccard-representatives"].columns)
