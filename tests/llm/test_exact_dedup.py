"""Exact duplicates: the perfect hash itself, and verdicts against a plain version."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from casewright.llm import exact_dedup as ed
from casewright.llm import hot_join

SCHEMA = "doc_id bigint, text string, digest string, n int, _copy string"


def plain(rows):
    """What the operator must say, by a dictionary."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        stayed = False
        for i in ids:
            kept = i == least and not stayed
            stayed |= kept
            out.append((i, least, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def judged(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)
    return [tuple(r) for r in ed.deduplicated(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_perfect_hash():
    """Every digest has its own slot, all slots are used, and strangers never pass the byte check."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 500, 5000):
        words = rng.integers(0, 2**63, (n, 4)).astype("<u8")
        sizes, bits = ed._levels(words)
        assert sorted(ed.slots(words, sizes, bits).tolist()) == list(range(n))
        strangers = rng.integers(0, 2**63, (100, 4)).astype("<u8")
        found = ed.slots(strangers, sizes, bits)
        assert found.max(initial=-1) < n


def test_digests_that_differ_in_one_byte():
    """Digests with equal halves are told apart as well."""
    words = np.zeros((256, 4), "<u8")
    words[:, 3] = np.arange(256, dtype=np.uint64) << np.uint64(56)
    sizes, bits = ed._levels(words)
    assert sorted(ed.slots(words, sizes, bits).tolist()) == list(range(256))


def test_edges(spark):
    rows = [
        (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, " a b"), (7, None), (2, ""), (None, ""), (8, "\n"), (1, " "),
        (6, "x" * 3_000_000), (11, "x" * 3_000_000), (12, "a b"), (12, "a b"), (12, "other"), (None, "alone"), (None, "alone"),
    ]
    assert sorted(judged(spark, rows), key=repr) == plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_against_plain(spark, monkeypatch, seed):
    """Small buckets and a low bound of hot keys, with one text in a third of all rows."""
    monkeypatch.setattr(ed, "BUCKET", 16)
    monkeypatch.setattr(hot_join, "HOT_ROWS", 20)
    rng = random.Random(seed)
    rows = [(i, "hot  text" if rng.random() < 0.33 else f"w{rng.randrange(300)} {rng.choice(['', ' '])}end") for i in range(1000)]
    rng.shuffle(rows)
    assert sorted(judged(spark, rows), key=repr) == plain(rows)


def test_index_takes_later_batches(spark):
    """The index answers for any later batch: members by locator, the others among themselves."""
    key = lambda t: hashlib.sha256(t.encode()).digest()
    past = spark.createDataFrame([(key(f"t{i}"), i, 1) for i in range(100)], "digest binary, locator bigint, n bigint")
    index = ed.build_index(past, 7)
    asked = spark.createDataFrame([(key("t5"), 200, 2), (key("new"), 201, 3)], "digest binary, locator bigint, n bigint")
    got = {bytes(r["digest"]): tuple(r)[1:] for r in ed.looked_up(asked, index, 7).collect()}
    assert len(got) == 101
    assert got[key("t5")] == (5, 3, True) and got[key("new")] == (201, 3, False) and got[key("t6")] == (6, 1, True)


def test_empty(spark):
    assert judged(spark, []) == []
