"""Repeated passages against all windows of the texts."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import suffix_dedup as sd


def plain(texts):
    """Spans of each text by a table of all its windows."""
    words = [(t or "").split() for t in texts]
    seen = defaultdict(set)
    for i, w in enumerate(words):
        for at in range(len(w) - sd.PASSAGE + 1):
            seen[tuple(w[at : at + sd.PASSAGE])].add(i)
    spans = set()
    for i, w in enumerate(words):
        at = [a for a in range(len(w) - sd.PASSAGE + 1) if len(seen[tuple(w[a : a + sd.PASSAGE])]) > 1]
        while at:
            start, end = at[0], at[0] + sd.PASSAGE
            while at and at[0] <= end:
                end = at.pop(0) + sd.PASSAGE
            spans.add((i, start, end))
    return spans


def corpus(seed=5, n=60):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    passages = [[word() for _ in range(k)] for k in (49, 50, 51, 64, 120, 400)]
    texts = [None, "", "short text", "x " * 300, "x " * 300]
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [word() for _ in range(r.randrange(0, 80))]
            p = r.choice(passages)
            cut = r.randrange(0, 20)
            parts += p[cut:] if r.random() < 0.3 else p
        texts.append(" ".join(parts))
    texts += texts[-3:]
    return texts


def test_minimisers_against_plain():
    values = np.random.default_rng(1).integers(0, 40, 500).astype(np.uint64)
    for span in (1, 2, 7, 16):
        expected = sorted({a + int(values[a : a + span].argmin()) for a in range(len(values) - span + 1)})
        assert sd.minimisers(values, span).tolist() == expected


def test_spans_against_plain(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, _row int").repartition(5).write.parquet(f"{tmp_path}/docs")
    rows = sd.repeated_passages(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} == plain(texts)
    assert all(0 <= r["later_words"] <= r["end_word"] - r["start_word"] for r in rows)
    # Of two equal texts one comes first: the other can be cut whole.
    copies = [r for r in rows if r["doc_id"] >= len(texts) - 6]
    assert any(r["later_words"] == r["end_word"] - r["start_word"] for r in copies)


def plain_flags(rows):
    """``(row, at, first)`` of sorted rows whose key another document has."""
    docs = defaultdict(set)
    for key, row, _ in rows:
        docs[key].add(row)
    least = {}
    for key, row, at in rows:
        least.setdefault(key, (row, at))
    return sorted((row, at, least[key] == (row, at)) for key, row, at in rows if len(docs[key]) > 1)


@pytest.mark.parametrize("seed", range(40))
def test_runs_over_batches_and_parts(seed):
    """Sorted rows cut anywhere into parts and batches, a key with a third of all rows among them."""
    r = random.Random(seed)
    keys = [-5, 7, 7, 7, *range(10, 10 + r.randrange(1, 12))]
    rows = sorted({(r.choice(keys), r.randrange(r.choice((1, 2, 30))), r.randrange(50)) for _ in range(r.randrange(1, 120))})
    cuts = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(r.randrange(5)))})
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        inner = sorted({a, b, *(r.randrange(a, b) for _ in range(r.randrange(6)))})
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[x:y])], ["_key", "_row", "_at"]) for x, y in zip(inner[:-1], inner[1:])
        ]
        out += [x for t in sd._told(iter(batches), []) for x in t.to_pylist()]
    edges = defaultdict(list)
    for x in out:
        if x["_edge"] is not None:
            edges[x["_edge"]].append(x)
    got = []
    for x in out:
        at = edges.get(x["_edge"], [])
        joined = len({e["_row"] for e in at}) > 1 or any(e["_shared"] for e in at) if at else x["_shared"]
        first = min((e["_row"], e["_at"]) for e in at) == (x["_row"], x["_at"]) if at else x["_first"]
        if not x["_mark"] and joined:
            got.append((x["_row"], x["_at"], first))
    assert sorted(got) == plain_flags(rows)


def test_hot_run_is_not_held():
    """Of a run with many documents only the rows of the first one are ever held."""
    batch = lambda i: pa.RecordBatch.from_arrays(
        [pa.array(np.full(1000, 4)), pa.array(np.arange(1000 * i, 1000 * i + 1000)), pa.array(np.zeros(1000, np.int32))], ["_key", "_row", "_at"]
    )
    opening = pa.RecordBatch.from_arrays([pa.array([1, 4]), pa.array([0, 0]), pa.array([0, 0], pa.int32())], ["_key", "_row", "_at"])
    sizes = [t.num_rows for t in sd._told(iter([opening, *map(batch, range(1, 200))]), [])]
    assert max(sizes) <= 1001 and sum(sizes) == 1 + 1 + 199_000 + 1


def test_long_texts_and_splits(spark, tmp_path, monkeypatch):
    """Texts across slices, one of 5 MB, and a second scan that cuts the files otherwise."""
    monkeypatch.setattr(sd, "SLICE_BYTES", 1 << 10)
    r = random.Random(3)
    shared = [f"s{r.randrange(10**6)}" for _ in range(70)]
    long = [f"u{i}" for i in range(600_000)]
    texts = [" ".join(long[:400_000] + shared + long[400_000:]), " ".join(shared), *corpus(9, 20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    extended = sd._extended

    def cut_otherwise(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        return extended(*args)

    monkeypatch.setattr(sd, "_extended", cut_otherwise)
    try:
        found = {(r["doc_id"], r["start_word"], r["end_word"]) for r in sd.repeated_passages(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == plain(texts)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    assert sd.repeated_passages(spark.read.parquet(f"{tmp_path}/docs")).count() == 0
