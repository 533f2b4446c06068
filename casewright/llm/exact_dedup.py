"""Exact duplicates against an index of earlier digests: a minimal perfect hash per bucket.

``build_index`` hashes the distinct digests of a history into buckets and gives each bucket a
minimal perfect hash: levels of bits, where a digest that is alone in its place of a level is
at home there and the others go on to the next (Limasset, Rizk, Chikhi and Peterlongo 2017).
The rank of a digest's bit is its slot, and the slot holds the whole digest, the locator of
the row that stays, and how many rows of the history had it. ``looked_up`` asks the index: a
digest that the slot repeats byte for byte is a member, and its rows are repeats of the
locator; any other is no member, whatever slot the hash gives it, and such digests are grouped
among themselves. ``deduplicated`` takes the rows up to the middle id as history and the rest
as what came after, so the row that stays is always the one with the least id.

Digests are SHA-256 of the text with every run of white space as one blank. They are counted
before any shuffle, so a text that a third of the rows share is a few rows; buckets hold some
``BUCKET`` distinct digests at any size. Verdicts return to the rows by ``left_join_hot``.

Defined results: a null text is empty, and all empty texts are equal; a null id comes after
every other; rows repeated with their id are listed as often as they are there and one of
them stays; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import SPACE_RUN, text_of, written
from casewright.llm.hot_join import left_join_hot
from casewright.llm.shingling import mix

BUCKET = 2_048   # distinct digests of the history in a bucket, about
SPREAD = 2       # places of a level for each digest still without a home
WIDTH = 32       # bytes of a digest

INDEX = "bucket bigint, sizes array<bigint>, bits binary, digests binary, locators array<bigint>, counts array<bigint>"
CLASSES = "digest binary, keep_id bigint, group_size bigint, member boolean"


def digest_of(text: str | Column = "text") -> Column:
    """SHA-256 of the text with its white space evened out, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), SPACE_RUN, " "), 256))


# --- the perfect hash of a bucket ---------------------------------------------


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest among ``size`` on a level; every byte of the digest counts."""
    mixed = np.full(len(words), level, np.uint64)
    for i in range(words.shape[1]):
        mixed = mix(mixed + words[:, i] + np.uint64(0x9E3779B97F4A7C15))
    return (mixed % np.uint64(size)).astype(np.int64)


def _levels(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits; ends when every digest has a home."""
    sizes, bits = [], []
    while len(words):
        size = SPREAD * len(words)
        place = _place(words, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words = words[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest: the rank of its bit; -1 where no level has a bit for it."""
    rank = np.cumsum(bits) - 1
    found = np.full(len(words), -1, np.int64)
    open_, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        place = base + _place(words[open_], level, size)
        home = bits[place]
        found[open_[home]] = rank[place[home]]
        open_, base = open_[~home], base + size
    return found


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of four 64-bit numbers."""
    joined = b"".join(digests.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, WIDTH // 8)


def _indexed(rows: pa.Table) -> pa.Table:
    """The index row of one bucket."""
    words = _words(rows["digest"])
    sizes, bits = _levels(words)
    order = np.argsort(slots(words, sizes, bits))
    return pa.table({
        "bucket": [rows["bucket"][0].as_py()],
        "sizes": [sizes],
        "bits": [np.packbits(bits).tobytes()],
        "digests": [words[order].tobytes()],
        "locators": [rows["locator"].to_numpy()[order]],
        "counts": [rows["n"].to_numpy()[order]],
    })


def _classes(index: pa.Table, asked: pa.Table) -> pa.Table:
    """All digests of a bucket, those of the history and those that are no members."""
    words = _words(asked["digest"])
    n = asked["n"].to_numpy().copy()
    if index.num_rows:
        sizes = index["sizes"][0].as_py()
        bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        known = np.frombuffer(index["digests"][0].as_py(), "<u8").reshape(-1, WIDTH // 8)
        locators, counts = (np.array(index[c][0].as_py(), np.int64) for c in ("locators", "counts"))
    else:
        sizes, bits, known = [], np.zeros(0, bool), np.zeros((0, WIDTH // 8), "<u8")
        locators = counts = np.zeros(0, np.int64)
    slot = slots(words, sizes, bits)
    member = slot >= 0
    member[member] = (known[slot[member]] == words[member]).all(axis=1)
    np.add.at(counts, slot[member], n[member])
    new = ~member
    digests = [known.tobytes()[i : i + WIDTH] for i in range(0, len(known) * WIDTH, WIDTH)]
    fresh = words[new].tobytes()
    digests += [fresh[i : i + WIDTH] for i in range(0, len(fresh), WIDTH)]
    return pa.table({
        "digest": pa.array(digests, pa.binary()),
        "keep_id": pa.concat_arrays([pa.array(locators, pa.int64()), asked["locator"].combine_chunks().filter(pa.array(new))]),
        "group_size": pa.array(np.concatenate([counts, n[new]]), pa.int64()),
        "member": pa.array(np.concatenate([np.ones(len(known), bool), np.zeros(int(new.sum()), bool)])),
    })


# --- the operator ---------------------------------------------------------------


def counted(rows: DataFrame) -> DataFrame:
    """``(digest, locator, n)`` of rows ``(digest, doc_id, n)``: the least id and how many rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("locator"), F.sum("n").alias("n"))


def _in_buckets(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The written index, one row per bucket, of distinct ``(digest, locator, n)``."""
    return written(_in_buckets(history, buckets).groupBy("bucket").applyInArrow(_indexed, INDEX), "digest-index")


def looked_up(asked: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Every digest of the index and of ``asked``: ``(digest, keep_id, group_size, member)``.

    ``member`` tells the digests of the history from those that are grouped separately.
    """
    return index.groupBy("bucket").cogroup(_in_buckets(asked, buckets).groupBy("bucket")).applyInArrow(_classes, CLASSES)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, in_history``."""
    narrow = docs.select("doc_id", digest_of("text").alias("digest"))
    rows = written(narrow.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    total, middle = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.percentile_approx("doc_id", 0.5)).first()
    past = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    history = written(counted(rows.filter(past)), "history-digests")
    buckets = max(1, -(-history.count() // BUCKET))
    classes = written(looked_up(counted(rows.filter(~past)), build_index(history, buckets), buckets), "digest-classes")
    told = left_join_hot(rows, classes, "digest", "group_size", total)
    copies = told.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_copy"))
    return copies.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )


ORACLE = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents
), c AS (SELECT digest, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size,
    row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS LAST) = 1 AS kept,
    digest AS text_sha256
FROM d JOIN c USING (digest)
"""
