"""Packing: the same ids as the tokenizer alone, every piece once, sequences without gaps."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import lp_packing as lp
from casewright.llm.encoding import Encoder, default_tokenizer, encoder

TEXTS = [
    None, "", " ", "a  b", " lead", "x \n y", "foo.\n bar\n\n  baz  ", "tab\t x", "\n\n", "a \nb", "q\n \nz",
    "<|endoftext|> z", "it's we'll 'S", "日本 語  x", "same text", "same text", "word " * 2047, "word " * 9000,
]


def ids_of(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [lp.END_ID]


def test_pieces_and_sequences(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, piece string")
    rows = [r.asDict() for r in lp.pack_documents(docs, keep_ids=True).collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS):
        ids, parts = ids_of(text), sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum((p["ids"] for p in parts), []) == ids
        assert all(p["length"] == lp.CAPACITY for p in parts[1:]) and parts[0]["start"] == 0
        for p in parts:
            cut = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(cut.tobytes())
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= lp.CAPACITY


def test_empty_table(spark):
    assert lp.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=30))
def test_patterns_use_every_piece_once(histogram):
    patterns = lp.patterns_for(histogram, 64, 60)
    used = Counter()
    for p in patterns:
        assert sum(x * k for x, k in p.lengths.items()) <= 64
        for x, k in p.lengths.items():
            used[x] += k * p.times
    assert used == Counter(histogram)
    total, large = sum(x * n for x, n in histogram.items()), sum(n for x, n in histogram.items() if x > 32)
    # First fit decreasing never needs more than 11/9 of the best; a best needs at least these.
    assert sum(p.times for p in patterns) <= max(total / 64, large) * 1.5 + len(histogram)


def test_pricing_packs_every_piece_close_to_the_bound():
    drawn = np.random.default_rng(1).lognormal(5.5, 1.2, 30_000).astype(int) % lp.CAPACITY + 1
    histogram = dict(Counter(drawn[drawn < lp.CAPACITY].tolist()))
    placed = Counter()
    for use, chosen in lp.whole_uses(histogram, lp.CAPACITY):
        for x, k in chosen.items():
            placed[x] += k * use
    assert placed == Counter(histogram)
    assert sum(p.times for p in lp.patterns_for(histogram)) <= 1.001 * lp.lp_bound(histogram, lp.CAPACITY) + 1
    # Pieces of just over a third: no sequence is full.
    assert sum(p.times for p in lp.patterns_for({700: 1000, 1100: 500})) == 750


def test_words_before_marks_are_encoded_once():
    coder = Encoder(default_tokenizer())
    texts = [
        "x word word. word, word; word: word! word?", "a.b. c.. d., e.\nf 'g. it's. h's, é. ß, 日. ª. µ, 5. _. . ,", "tail é.", " . ! x.",
        "ſ. K. ǆ, İ. ..a a.. a.? \u00ad. \xa0. x\xa0. ﬁ, e\u0301.",
    ]
    ids, bounds = coder.encode(texts, lp.END_ID)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(t)
    assert [k for k in coder.known if k.startswith(" word")] == [" word"]


def test_few_encodings_are_held_at_a_time(monkeypatch):
    """Before, all new pieces of two megabytes of text were encoded by one call, whose results take a hundred times the ids."""
    from casewright.llm import encoding

    class Counting:
        def __init__(self, inner):
            self.inner, self.most = inner, 0

        def encode_batch_fast(self, texts, **kwargs):
            self.most = max(self.most, sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **kwargs)

    texts = [" ".join(f"w{i}x{j}" for j in range(4_000)) for i in range(20)] + [f"a{i}\n b" for i in range(700)] + [""]
    plain = encoder(default_tokenizer()).tokenizer
    expected = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    coder = Encoder(default_tokenizer())
    coder.tokenizer = Counting(coder.tokenizer)
    monkeypatch.setattr(encoding, "GATHERED", 1_000)
    ids, bounds = coder.encode(texts, 0)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expected
    assert coder.tokenizer.most <= encoding.HELD_CHARS + 2 * encoding.JOINED_CHARS
    assert [b - a for a, b in encoding.slices(pa.array(["x" * 300_000] * 8))] == [3, 3, 2]
