"""The trie against one built turn by turn in plain Python, with small blocks and bounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from casewright.llm import hot_join
from casewright.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n int"


def plain(rows):
    """Every node as a tuple of its first turns."""
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = f"{len(role)}:{role}{text}"
            told[conv].append(((turn is not None, turn), hashlib.sha256(said.encode()).digest(), (role, text)))
    turns = {c: [t for _, _, t in sorted(ts, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))] for c, ts in told.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    longer = {k[:-1] for k in nodes if k}
    for k, members in nodes.items():
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in longer
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].split()) if k else 0
    return sorted(
        (
            (m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
             hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(k)).encode()).hexdigest())
            for k, m in nodes.items()
        ),
        key=repr,
    )


def trie(spark, rows):
    return sorted((tuple(r) for r in pt.prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()), key=repr)


def random_rows(rng, convs, longest, texts):
    rows = []
    for c in convs:
        copied = rng.random() < 0.4
        for t in range(rng.randrange(1, longest)):
            text = f"w{t % 3} hot" if copied and rng.random() < 0.95 else " ".join("ab" for _ in range(rng.randrange(texts)))
            rows.append((c, t, rng.choice(["user", "user", "assistant"]) if not copied else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(hot_join, "HOT_ROWS", 5)
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    monkeypatch.setattr(pt, "BLOCK", 2 + seed)
    rng = random.Random(seed)
    rows = random_rows(rng, rng.sample(range(200), 90), 12, 3)
    assert trie(spark, rows) == plain(rows)


def test_edges(spark):
    """Null and repeated turns, nulls and empty texts, a family without its first, turnless conversations."""
    rows = [
        (20, None, None, None), (20, 0, "user", ""), (20, 0, "user", ""), (20, 0, "user", "b c"),
        (21, 3, "user", "a"), (21, None, "", "z\t\ny"), (45, 0, "user", "lone"), (47, 0, "user", "lone"),
        (None, 0, "user", "nobody's"), (22, 0, "us", "er"), (23, 0, "use", "r"), (24, 0, None, None), (24, 1, "user", "x " * 100_000),
        *[(c, 0, "user", "only") for c in range(100, 140)],
    ]
    assert trie(spark, rows) == plain(rows)


def test_one_conversation_with_most_turns(spark):
    rows = [(7, t, "user", f"t{t % 5}") for t in range(600)] + [(8, t, "user", f"t{t % 5}") for t in range(590)] + [(0, 0, "user", "q")]
    assert trie(spark, rows) == plain(rows)


def test_only_turnless(spark):
    """All turns are skipped and nothing can be borrowed: the root is the only node, and a leaf."""
    skipping = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "gone") for c in skipping if c // 20 * 20 not in skipping][:10]
    assert trie(spark, rows) == plain(rows)
    assert len(plain(rows)) == 1


def test_empty(spark):
    assert trie(spark, []) == []
