"""Vocabulary and TF-IDF vectors of terms of one and two words, from texts of blank-separated words.

Words are numbered batch by batch, so a term is a number and one sort of numbers counts the terms
of many rows. The vocabulary is found in two passes: all terms are counted in 2^22 buckets by their
hash, in one array per task, and only those whose bucket reaches the count of the last place are
spelt out and counted again. The count of a bucket is no less than that of its terms, so every winner
is among them; if terms that share a bucket made the bound too high, it is lowered. Where too many
buckets are as full as the last place, terms are counted by a 64-bit hash each. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import terms as tm
from casewright.functions.text import fill_text
from casewright.operators.features import BROADCAST_ROWS, VECTOR, doc_term_arrays, tfidf_rows
from casewright.sources.storage import written

SLICE_BYTES = 4 << 20   # text worked on at a time; a longer text is a slice of its own
BUCKET_BITS = 22        # of a hash that tell a term's bucket
CHUNK_BITS = 14         # of a bucket's number within the buckets whose sums are merged together


def word_text(text: Column) -> Column:
    """The words of ``word_tokens`` with blanks between them, and words of one character, which are left out later."""
    return F.regexp_replace(F.lower(fill_text(text)), r"[^a-z0-9_\p{L}\p{N}]+", " ")


def _entries(texts: DataFrame, keep: Sequence[str], words: str) -> DataFrame:
    """``(keep..., entries)`` with all terms of one and two words spelt out.

    Words and terms are written, as expressions on arrays would compute them anew for each element.
    """
    listed = texts.select(*keep, F.filter(F.split(words, " "), lambda w: F.char_length(w) > 1).alias("_words"))
    terms = written(listed, "listed-words").select(*keep, tm.ngram_range(F.col("_words"), 1, 2).alias("terms"))
    return doc_term_arrays(written(terms, "listed-terms"), keep)


@dataclass
class _Words:
    """The words of some rows: ``row`` and ``code`` of each, in order, and the distinct words."""

    n: int
    row: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> _Words:
        lists = pc.split_pattern(texts, " ")
        row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        words = lists.flatten()
        kept = pc.greater(pc.utf8_length(words), 1)
        coded = words.filter(kept).dictionary_encode()
        return cls(len(texts), row[kept.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word (-1: none) and row of every term, as often as it stands there."""
        pair = self.row[:-1] == self.row[1:]
        first = np.concatenate([self.code, self.code[:-1][pair]])
        second = np.concatenate([np.full(len(self.code), -1), self.code[1:][pair]])
        return first, second, np.concatenate([self.row, self.row[:-1][pair]])

    def counted(self, buckets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word (-1: none), count and number of rows of each distinct term, or of those in ``buckets``."""
        wide, n = len(self.distinct) + 1, max(self.n, 1)
        first, second, row = self.places()
        if buckets is not None:
            kept = buckets[self.buckets(first, second, len(buckets).bit_length() - 1)]
            first, second, row = first[kept], second[kept], row[kept]
        met = np.sort((first * wide + second + 1) * n + row)
        # One entry per term and row, then one per term.
        at = np.flatnonzero(np.diff(met, prepend=-1))
        term = met[at] // n
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        count = np.diff(np.append(at[starts], len(met)))
        first, second = np.divmod(term[starts], wide)
        return first, second - 1, count, np.diff(np.append(starts, len(term)))

    def hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        import pandas as pd

        own = pd.util.hash_array(np.append(self.distinct.to_numpy(zero_copy_only=False), "").astype(object), categorize=False)
        with np.errstate(over="ignore"):
            mixed = (own[first] ^ (own[first] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own[second] * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(second < 0, own[first], mixed ^ (mixed >> np.uint64(32))).view(np.int64)

    def buckets(self, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
        return (self.hashes(first, second).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)

    def spelt(self, first: np.ndarray, second: np.ndarray) -> pa.Array:
        one = self.distinct.take(pa.array(first))
        two = self.distinct.take(pa.array(second, mask=second < 0))
        return pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield start, stop
        start = stop


def _counter(wanted: np.ndarray | None, bits: int = 64):
    """Counts by hash, or with the sorted hashes ``wanted`` the terms that have one of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                words = _Words.of(batch.column(0).slice(a, b - a))
                first, second, counts, df = words.counted()
                if not len(first):
                    continue
                hashes = words.hashes(first, second) >> (64 - bits)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts), pa.array(df)], ["h", "count", "df"])
                    continue
                at = np.searchsorted(wanted, hashes)
                kept = wanted[np.minimum(at, len(wanted) - 1)] == hashes
                terms = words.spelt(first[kept], second[kept])
                yield pa.RecordBatch.from_arrays([terms, pa.array(counts[kept]), pa.array(df[kept])], ["term", "count", "df"])

    return count


def _added(parts: DataFrame, by: str) -> DataFrame:
    return parts.groupBy(by).agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def _bucket_counter(bits: int, chunk: int):
    """Terms by bucket: the sums of a task, ``chunk`` bits of buckets together."""

    def sums(total: np.ndarray) -> pa.RecordBatch:
        parts = total.reshape(-1, 1 << chunk)
        some = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some.tolist()], pa.binary())], ["chunk", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, terms = np.zeros(1 << bits, "<u4"), 0
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                words = _Words.of(batch.column(0).slice(a, b - a))
                first, second, _ = words.places()
                if terms + len(first) >= 1 << 32:
                    yield sums(total)
                    total[:], terms = 0, 0
                terms += len(first)
                np.add(total, np.bincount(words.buckets(first, second, bits), minlength=1 << bits), out=total, casting="unsafe")
        yield sums(total)

    return count


def _bucket_terms(wanted: np.ndarray, bits: int):
    """``(term, count, df)`` of the terms in the buckets ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(1 << bits, bool)
        kept[wanted] = True
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                words = _Words.of(batch.column(0).slice(a, b - a))
                first, second, counts, df = words.counted(kept)
                yield pa.RecordBatch.from_arrays([words.spelt(first, second), pa.array(counts), pa.array(df)], ["term", "count", "df"])

    return count


def _by_buckets(texts: DataFrame, min_df: int, max_features: int, known: int, bits: int) -> DataFrame | None:
    """The candidates, or nothing if more than ``known`` buckets are as full as the last place."""
    chunk = min(CHUNK_BITS, bits)

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros(1 << chunk, np.int64)
        for counts in parts["counts"]:
            total += np.frombuffer(counts.as_py(), "<u4")
        at = np.flatnonzero(total >= max(min_df, 1))
        return pa.table({"bucket": pa.array((parts["chunk"][0].as_py() << chunk) + at), "count": pa.array(total[at])})

    parts = texts.mapInArrow(_bucket_counter(bits, chunk), "chunk bigint, counts binary")
    totals = written(parts.groupBy("chunk").applyInArrow(added, "bucket bigint, count bigint"), "term-buckets")
    # Other terms in the buckets raise the bound, so it is first that of twice as many places.
    places = 2 * max_features
    while True:
        last = totals.orderBy(F.desc("count")).limit(places).agg(F.min("count").alias("least"), F.count("*").alias("n")).first()
        least = last["least"] if last["n"] == places else 0
        found = totals.filter(F.col("count") >= least).select("bucket").limit(known + 1).toArrow()["bucket"].to_numpy()
        if len(found) > known:
            return None
        terms = written(_added(texts.mapInArrow(_bucket_terms(found, bits), "term string, count bigint, df bigint"), "term"), "terms")
        if not least or terms.filter((F.col("df") >= min_df) & (F.col("count") >= least)).count() >= max_features:
            return terms
        places *= 2


def term_candidates(texts: DataFrame, min_df: int, max_features: int, words: str = "words", known: int = BROADCAST_ROWS, bits: int = 64) -> DataFrame:
    """``(term, count, df)`` with exact counts: all terms that can be among the ``max_features`` of the vocabulary; written.

    Up to ``known`` buckets or hashes are sent to every task; if more share the last place, all terms are spelt out.
    """
    texts = texts.select(words)
    terms = _by_buckets(texts, min_df, max_features, known, min(bits, BUCKET_BITS)) if max_features else None
    return terms if terms is not None else _by_hashes(texts, min_df, max_features, words, known, bits)


def _by_hashes(texts: DataFrame, min_df: int, max_features: int, words: str, known: int, bits: int) -> DataFrame:
    counted = _added(texts.mapInArrow(_counter(None, bits), "h bigint, count bigint, df bigint"), "h")
    hashed = written(counted.filter(F.col("df") >= min_df), "term-hashes")
    places = max_features
    while True:
        last = hashed.orderBy(F.desc("count")).limit(places).agg(F.min("count").alias("least"), F.count("*").alias("n")).first()
        least = last["least"] if last["n"] == places and last["n"] else 0
        reached = hashed.filter(F.col("count") >= least).select("h")
        found = reached.limit(known + 1).toArrow()["h"].to_numpy() if places else np.zeros(0, np.int64)
        if len(found) > known:
            entries = _entries(texts, [], words).select(F.inline("entries"))
            return written(entries.groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df")), "terms")
        if not len(found):
            return texts.sparkSession.createDataFrame([], "term string, count bigint, df bigint")
        terms = written(_added(texts.mapInArrow(_counter(np.sort(found), bits), "term string, count bigint, df bigint"), "term"), "terms")
        if not least or terms.filter((F.col("df") >= min_df) & (F.col("count") >= least)).count() >= max_features:
            return terms
        places *= 2


def tfidf_vectors(texts: DataFrame, vocabulary: DataFrame, keep: Sequence[str], n_terms: int, words: str = "words") -> DataFrame:
    """``(keep..., features)`` as of ``tfidf_rows``, from ``(keep..., words)``.

    A word of the vocabulary has a number, and a term of two words is a pair of numbers.
    """
    keep = list(keep)
    if n_terms > BROADCAST_ROWS:
        return tfidf_rows(_entries(texts, keep, words), vocabulary, keep, n_terms)
    listed = vocabulary.select("index", "term", "idf").orderBy("index").toArrow()
    idf = listed["idf"].to_numpy()
    parts = [t.split(" ") for t in listed["term"].to_pylist()]
    number = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}))}
    own_words, size = pa.array(list(number), pa.string()), len(number)
    alone = np.full(size, -1, np.int64)
    pairs = []
    for i, p in enumerate(parts):
        if len(p) == 1:
            alone[number[p[0]]] = i
        else:
            pairs.append((number[p[0]] * size + number[p[1]], i))
    pair_key, pair_at = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
    schema = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep] + [f"features {VECTOR}"])

    def places(found: _Words) -> np.ndarray:
        """``row * n_terms + index`` of every term of the vocabulary, as often as it stands there."""
        ids = pc.fill_null(pc.index_in(found.distinct, value_set=own_words), -1).to_numpy().astype(np.int64)[found.code]
        row, ids = found.row, ids
        at = np.where(ids >= 0, alone[ids], -1) if size else np.full(len(ids), -1)
        single = row[at >= 0] * n_terms + at[at >= 0]
        both = (row[:-1] == row[1:]) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        if not len(pair_key) or not both.any():
            return single
        key = ids[:-1][both] * size + ids[1:][both]
        spot = np.minimum(np.searchsorted(pair_key, key), len(pair_key) - 1)
        hit = pair_key[spot] == key
        return np.concatenate([single, row[:-1][both][hit] * n_terms + pair_at[spot[hit]]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                *kept, lines = part.columns
                n = part.num_rows
                met = np.sort(places(_Words.of(lines)))
                starts = np.flatnonzero(np.diff(met, prepend=-1))
                tf = np.diff(np.append(starts, len(met)))
                row, at = np.divmod(met[starts], max(n_terms, 1))
                raw = (1 + np.log(tf)) * idf[at]
                norm = np.sqrt(np.bincount(row, raw * raw, minlength=n))
                bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
                vector = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, n_terms), pa.int32()),
                        pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(raw / norm[row])),
                    ],
                    ["type", "size", "indices", "values"],
                )
                yield pa.RecordBatch.from_arrays([*kept, vector], [*keep, "features"])

    return texts.select(*keep, words).mapInArrow(weigh, schema)
