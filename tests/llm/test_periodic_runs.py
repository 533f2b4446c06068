"""Runs against a plain search of all periods, and whole documents against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from casewright.llm import periodic_runs as pr
from casewright.llm.suffix_tree import Extensions, SuffixTree

SCHEMA = "doc_id bigint, text string, start string, n_runs int"


def plain_runs(words, least=pr.LEAST, fold=pr.FOLD):
    """Every period, every maximal stretch; a stretch belongs to its smallest period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, fold * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_extensions_agree_with_counting():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(2, 60)
        words = [rng.randrange(1, 4) for _ in range(n)]
        ext = Extensions(*SuffixTree([*words, 0], 4).tour())
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = ext(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        for (i, j), k in zip(pairs, got.tolist()):
            expected = 0
            while max(i, j) + expected < n and words[i + expected] == words[j + expected]:
                expected += 1
            assert k == expected


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    """Also runs of two periods and more, which are far more frequent than those of four."""
    rng = random.Random(letters)
    for _ in range(150):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 60))]
        for least, fold in ((6, 4), (2, 2), (3, 3)):
            got = [tuple(r) for r in pr.runs(np.array(words, np.int64), least, fold).tolist()]
            assert got == plain_runs(words, least, fold), words


def planted(rng, n):
    """Words with repeated parts of all lengths in them, some cut short or damaged."""
    words = []
    while len(words) < n:
        part = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 30))]
        words += (part * rng.randrange(1, 8))[: rng.randrange(1, 200)]
        if rng.random() < 0.5:
            words += [f"x{rng.randrange(100)}" for _ in range(rng.randrange(6))]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_documents(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), rng.choice([" ", "\n", " \t\v"]).join(planted(rng, rng.randrange(1, 150)))) for _ in range(60)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, "a a a a a a a"), (4, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a")]
    rows += [(i, " ".join(f"w{k}" for k in range(200))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in pr.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_long_text():
    """One stretch of 300,000 words, and one word repeated."""
    part = [f"w{i}" for i in range(50_000)]
    import pyarrow as pa

    (row,) = list(pr._judged([None], pa.array([" ".join(part * 6)])))
    assert row[1:6] == (1, 0, 300_000, 50_000, 6000)
    (row,) = list(pr._judged([None], pa.array(["a " * 100_000])))
    assert row[1:6] == (1, 0, 100_000, 1, 100_000_000)
    assert row[7] == hashlib.sha256(b"a").hexdigest()


def test_white_space_is_ascii(spark):
    docs = spark.createDataFrame([(None, "a b a b a b a b a b a b ")], "doc_id bigint, text string")
    assert pr.periodic_runs(docs).first()["n_runs"] == 0


def test_empty(spark):
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
