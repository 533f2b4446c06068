"""Periodic runs of words: stretches that repeat themselves at least four times.

``runs`` finds the maximal repetitions of a sequence as the runs theorem has it (Bannai, I,
Inenaga, Nakashima, Takeda and Tsuruta 2017). Ukkonen trees of the sequence and of its
reversal are toured (Euler), and the lowest common ancestor of two leaves, a range minimum
over the tour, tells in constant time how far two places agree to the right and to the left.
The leaf order gives the longest Lyndon word that starts at each place, under the order of the
words and under its reverse: one of them is a root of every run. So each place and order is a
candidate period, and the candidate is extended in both directions.

Before that, ``stretches`` narrows whole texts, many at a time, to where a run can be. A run
of period q in [Q, 2Q) and length of at least 4q repeats every group of min(Q, 4) words within
less than 2Q words, for more than 2Q places on end. Stretches with this property, widened by what
the run may exceed them and joined where they meet, hold every run with its neighbours, so the trees
are built of them and of nothing else, and nothing is lost. Texts stay where they are read; there is
no shuffle. A worker needs about 600 bytes for each word of the longest stretch.

Defined results: a null or empty text has no words and no runs, and collapses to nothing; a null id
is text as it is; repeated rows are judged each by itself; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from casewright.llm.encoding import slices
from casewright.llm.shingling import mix
from casewright.llm.suffix_tree import Extensions, SuffixTree, ranks

LEAST = 6            # words of a run, at least
FOLD = 4             # and so many periods
GRAM = 4             # words of the groups that stretches are found by, at most
_PLACE_BITS = 24     # of the sorted numbers; the rest is hash
SLICE_BYTES = 1 << 20

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


# --- runs of one sequence ---------------------------------------------------------


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word from each place: the next suffix that is smaller."""
    order = rank.tolist()
    ends = [0] * (len(order) - 1)
    smaller = [len(order) - 1]
    for i in range(len(order) - 2, -1, -1):
        while order[smaller[-1]] > order[i]:
            smaller.pop()
        ends[i] = smaller[-1]
        smaller.append(i)
    return np.array(ends, np.int64)


def runs(words: np.ndarray, least: int = LEAST, fold: int = FOLD) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs of at least ``least`` words and ``fold`` periods."""
    n = len(words)
    if n < least:
        return np.zeros((0, 3), np.int64)
    ids = np.unique(words, return_inverse=True)[1] + 1   # 0 ends the text
    size = int(ids.max()) + 1
    tree = SuffixTree([*ids.tolist(), 0], size)
    leaves, turns = tree.tour()
    upward, downward = ranks(leaves), ranks(tree.tour(descending=True)[0])
    right = Extensions(leaves, turns)
    place = np.arange(n)
    found = []
    for rank in (upward, downward):
        period = lyndon_ends(rank) - place
        found.append(np.stack([place, period])[:, fold * period <= n])
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    del tree
    end = start + period
    end = end + right(start, end)
    del right
    left = Extensions(*SuffixTree([*ids[::-1].tolist(), 0], size).tour())
    start = start - left(n - start, n - start - period)
    long = end - start >= np.maximum(least, fold * period)
    return np.unique(np.stack([start, end - start, period], axis=1)[long], axis=0)


# --- where runs can be --------------------------------------------------------------


def _gaps(hashes: np.ndarray) -> np.ndarray:
    """Distance to the next place with the same hash, or less; very large if there is none.

    Places are sorted below the upper bits of the hash. Where two hashes agree in these, the
    distance is too small, which only makes a stretch longer.
    """
    n = len(hashes)
    bits = np.uint64(max(_PLACE_BITS, n.bit_length()))
    keyed = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (keyed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = keyed[1:] >> bits == keyed[:-1] >> bits
    gaps = np.full(n, np.iinfo(np.int64).max)
    gaps[place[:-1][same]] = (place[1:] - place[:-1])[same]
    return gaps


def stretches(words: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of disjoint stretches that hold all runs with their neighbours.

    ``words`` are those of many texts, each followed by a number of its own; ``bounds`` are
    where texts start, and ``longest`` is the length of the longest one.
    """
    hashes = mix(words.astype(np.uint64) + np.uint64(1))
    starts, ends = [], []
    gram, reach, gaps = 1, 1, _gaps(hashes)
    while FOLD * reach <= longest:
        if gram < min(reach, GRAM):
            wider = np.zeros(len(hashes), np.uint64)
            wider[: len(hashes) - gram] = hashes[gram:]
            hashes = mix(hashes + wider * np.uint64(0x9E3779B97F4A7C15))
            gram *= 2
            gaps = _gaps(hashes)
        near = np.zeros(len(gaps) + 2, np.int8)
        near[1:-1] = gaps < 2 * reach
        edge = np.diff(near)
        a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = b - a >= max(2 * reach + 1, LEAST - 2 * reach + 2 - gram)
        starts.append(a[long] - 1)
        ends.append(b[long] + 2 * reach + gram + 1)
        reach *= 2
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(starts), np.concatenate(ends)
    # Within its own text: a stretch has no place of the number that ends one.
    text = np.searchsorted(bounds, a + 1, "right")
    a = np.maximum(a, bounds[text - 1])
    b = np.minimum(b, np.append(bounds[1:], len(words))[text - 1] - 1)
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] >= b[:-1]
    return a[new], b[np.append(np.nonzero(new)[0][1:] - 1, len(b) - 1)] if len(b) else b


# --- texts ---------------------------------------------------------------------------


def _rebuilt(doc_id: int | None, n: int) -> np.ndarray:
    """Word numbers of a text as it is judged: a tenth of the ids repeat a part of it to the end."""
    place = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the bounds of each text's among them."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    # A text without words is split into one empty string.
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pc.not_equal(flat, ""))
        counts[empty] = 0
    return flat, np.concatenate([[0], np.cumsum(counts)])


def _best(found: np.ndarray) -> tuple:
    """Start, length, period and thousandths of the run that repeats most often."""
    start, length, period = min(found.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return start, length, period, 1000 * length // period


def _judged(ids: list, texts: pa.Array) -> Iterator[tuple]:
    flat, bounds = _split(texts)
    sizes = np.diff(bounds)
    order = np.concatenate([a + _rebuilt(i, n) for i, a, n in zip(ids, bounds[:-1].tolist(), sizes.tolist())] or [bounds[:0]])
    coded = flat.dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    # Each text is followed by a number that is no word.
    rows = np.arange(len(ids))
    apart = np.insert(words, bounds[1:], len(coded.dictionary) + rows)
    heads = bounds[:-1] + rows
    runs_of: dict[int, list[np.ndarray]] = {}
    for a, b in zip(*(x.tolist() for x in stretches(apart, heads, int(sizes.max(initial=0))))):
        found = runs(apart[a:b])
        if len(found):
            row = int(np.searchsorted(heads, a, "right")) - 1
            found[:, 0] += a - heads[row]
            runs_of.setdefault(row, []).append(found)
    kept = np.ones(len(order), bool)
    for row, parts in runs_of.items():
        for start, length, period in np.concatenate(parts).tolist():
            kept[bounds[row] + start + period : bounds[row] + start + length] = False
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.take(pa.array(order[kept])))
    collapsed = pc.binary_join(lists, " ").to_pylist()
    for row, (doc_id, text) in enumerate(zip(ids, collapsed)):
        whole = hashlib.sha256(text.encode()).hexdigest()
        if row not in runs_of:
            yield doc_id, 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), whole
            continue
        found = np.concatenate(runs_of[row])
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        yield doc_id, len(found), *_best(found), hashlib.sha256(listed.encode()).hexdigest(), whole


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its runs, the one that repeats most often, and the text without repeats."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    fields = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts, SLICE_BYTES):
                rows = [dict(zip(names, r)) for r in _judged(ids[a:b], texts.slice(a, b - a))]
                yield pa.RecordBatch.from_pylist(rows, fields)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
