"""N-gram Jaccard self-join by chosen paths.

A text is the set of its windows of ``WORDS`` words. In each run every set chooses a few of
its shingles by a hash that all sets share: two sets choose the same ones of those they have
in common. A chosen shingle is a bucket. A bucket of up to ``LIMIT`` sets is compared by
brute force; a larger one is split again by shingles chosen under it, and what even then is
larger is compared in blocks. ``runs_for`` gives the runs after which a pair at the threshold
has met with the target probability; more similar pairs meet more often.

Equal sets are one class from the start. In a bucket, pairs are first told apart by the keys
they share, and a pair is judged only in the smallest bucket that both are in, so it is
counted once and needs no list of pairs. For the sets that have such a pair the shingles are
fetched and compared exactly. A bucket returns a row for each of its sets: how many links it
has there and the least set it is connected with. Links become classes by connected
components.

Defined results: texts without words (null, empty, blank) have no shingles, are linked with
nothing and are classes of their own, one for each row; a text of fewer words than a window is
a single shingle; repeated rows are copies of each other, rows that only repeat an id are
judged by their texts; an empty table gives an empty result; other columns are ignored.

Rows are told apart by their file and their place in it, so ``docs`` has to be read from Parquet
files, as stages read what the stage before has written; splits of the files may differ between scans.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import file_numbers, with_places, written
from casewright.llm.components import components
from casewright.llm.grouping import grouped
from casewright.llm.shingling import SLICE_BYTES, mix, shingle_sets, word_hashes

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5     # the threshold, 0.8
RATE = 2.0                        # shingles that a set chooses in a run
SPLIT_RATE = 4.0                  # and under a split bucket, so that a pair with large buckets only still has RECALL
RECALL = 0.99999                  # probability with which a pair at the threshold meets
LIMIT = 1024                      # sets of a bucket that one task compares
LEAST_SHARED = 0.2                # share of its keys that a pair must have in common to be compared
BROADCAST_ROWS = 2_000_000        # ids sent to every task at most; more are joined by shuffle


def runs_for(recall: float = RECALL, rate: float = RATE, overlap: float = NUMERATOR / DENOMINATOR) -> int:
    """Runs until a pair with this overlap shares a key with probability ``recall``.

    The keys shared in a run are Poisson with mean ``rate * overlap``: the overlap of two
    sets, as a share of the larger one, is never less than their Jaccard similarity.
    """
    return math.ceil(-math.log(1 - recall) / (rate * overlap))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    from casewright.llm.encoding import slices

    texts = batch.column(batch.num_columns - 1)
    for begin, stop in slices(texts, SLICE_BYTES):
        part = batch.slice(begin, stop - begin)
        yield part, shingle_sets(*word_hashes(part.column(part.num_columns - 1)), WORDS)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))


def chosen_keys(sets: list[np.ndarray], runs: int, rate: float = RATE) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each set its keys, the keys under these, and under which of the keys each of them is."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    least = np.where(sizes > rate, np.minimum(rate / np.maximum(sizes, 1) * 2.0**64, 2.0**64 - 2048), 0).astype(np.uint64)
    least[sizes <= rate] = np.uint64(2**64 - 1)
    limit = np.repeat(least, sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    owners, keys = [], []
    for run in range(runs):
        hashed = mix(every ^ np.uint64(0x517CC1B727220A95 * (run + 1) & (2**64 - 1)))
        at = np.nonzero(hashed <= limit)[0]
        owners.append(owner[at])
        keys.append(mix(hashed[at] + np.uint64(run)))
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(len(sets) + 1))
    first = [keys[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]
    second, parents = [], []
    deep = np.where(sizes > SPLIT_RATE, np.minimum(SPLIT_RATE / np.maximum(sizes, 1) * 2.0**64, 2.0**64 - 2048), 0).astype(np.uint64)
    deep[sizes <= SPLIT_RATE] = np.uint64(2**64 - 1)
    for s, k, top in zip(sets, first, deep):
        hashed = mix(s[None, :] ^ k[:, None])
        row, column = np.nonzero(hashed <= top)
        second.append(mix(hashed[row, column] + np.uint64(1)))
        parents.append(row.astype(np.int64))
    return [_signed(x) for x in first], [_signed(x) for x in second], parents


def sketched(docs: DataFrame, files: DataFrame, runs: int) -> DataFrame:
    """``(_row, doc_id, _set, _n, _keys, _under, _parent)`` of each document, written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_row bigint, doc_id {kind}, _set binary, _n int, _keys array<bigint>, _under array<bigint>, _parent array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _text_slices(batch):
                keys, under, parents = chosen_keys(sets, runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()), _lists(keys), _lists(under), _lists(parents),
                    ],
                    ["_row", "doc_id", "_set", "_n", "_keys", "_under", "_parent"],
                )

    return written(with_places(docs, files, "doc_id", "text").mapInArrow(sketch, schema), "jaccard-sketches")


def _sizes(keys: DataFrame, name: str) -> DataFrame:
    """Buckets of two sets or more."""
    return written(keys.groupBy("_key").agg(F.count("*").alias("_size")).filter("_size > 1"), name)


def _split_keys(sketches: DataFrame, reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(_row, _key)``: the keys that sets in a large bucket have under it.

    The keys below are many more than those of the buckets, so they stay where the sketches are: of the large
    buckets there are at most keys / ``LIMIT``, which go to every task, or beyond the bound are joined by shuffle.
    """
    large = written(sizes.filter(F.col("_size") > LIMIT).select("_key"), "jaccard-large-buckets")
    each = sketches.select("_row", F.explode(
        F.transform("_keys", lambda k, at: F.struct(k.alias("_key"), F.filter("_under", lambda _, i: F.element_at("_parent", i + 1) == at).alias("_below")))
    ).alias("_top"))
    each = each.select("_row", "_top.*")
    inside = each.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "_key", "left_semi")
    return inside.select("_row", F.explode("_below").alias("_key")).join(reps.select("_row"), "_row", "left_semi")


def bucket_rows(reps: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """``(_cell, _block, _row, ...)``: each set in each bucket it is compared in.

    ``sketches`` hold the keys under the buckets, of these sets and maybe of others; without them ``reps`` do.
    """
    sketches = reps if sketches is None else sketches
    first = reps.select("_row", F.explode("_keys").alias("_key"))
    sizes = _sizes(first.select("_key"), "jaccard-buckets")
    # No large bucket is left out: what a pair shares may be in large ones alone.
    by_set = written(
        first.join(sizes, "_key").groupBy("_row").agg(F.collect_list(F.when(F.col("_size") <= LIMIT, F.col("_key"))).alias("_small")),
        "jaccard-places",
    )
    placed = reps.join(by_set, "_row")
    split = written(_split_keys(sketches, reps, sizes), "jaccard-split-keys")
    split_sizes = _sizes(split, "jaccard-split-buckets")
    split_met = split.join(split_sizes, "_key").withColumn("_blocks", F.ceil(F.col("_size") / LIMIT).cast("int"))
    deeper = split_met.groupBy("_row").agg(F.collect_list(F.struct("_key", "_blocks")).alias("_deep"))
    one = lambda k: F.struct(k.alias("_key"), F.lit(1).alias("_blocks"))
    both = placed.join(deeper, "_row", "left").withColumn(
        "_leaves", F.concat(F.transform("_small", one), F.coalesce("_deep", F.array().cast("array<struct<_key: bigint, _blocks: int>>")))
    )
    rows = both.select(
        "_row", "_n", "_copies", "_keys", F.transform("_leaves", lambda x: x["_key"]).alias("_met"), F.explode("_leaves").alias("_leaf")
    )
    # A bucket of b blocks is compared as pairs of blocks; a set goes to the b pairs that hold its block.
    blocks, own = F.col("_leaf._blocks"), F.pmod(F.xxhash64("_row"), F.col("_leaf._blocks")).cast("int")
    return rows.withColumn("_block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        F.col("_leaf._key").alias("_key"),
        F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block",
        "_row", "_n", "_copies", "_keys", "_met",
    )


def _common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of different sets, some thousand distinct values at a time."""
    flat = np.concatenate(sets)
    if not len(flat):
        return np.zeros((len(sets), len(sets)), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    # A value that one set alone has is in no intersection.
    code = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)]))
    count = np.bincount(code)
    shared = count > 1
    row, code = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(code, [first, first + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], code[a:b] - first] = 1
        total += part @ part.T
    return total


def _candidates(key: int, cross: bool, block: np.ndarray, n: np.ndarray, keys: list[np.ndarray], met: list[np.ndarray]) -> np.ndarray:
    """Pairs (upper triangle) of a bucket to be compared in it."""
    sizes = np.array([len(np.unique(k)) for k in keys], float)
    common = _common(keys)
    fits = common >= np.maximum(1, LEAST_SHARED * np.minimum(sizes[:, None], sizes[None, :]))
    fits &= DENOMINATOR * np.minimum(n[:, None], n[None, :]) >= NUMERATOR * np.maximum(n[:, None], n[None, :])
    fits &= _common([m[m < key] for m in met]) == 0
    if cross:
        fits &= block[:, None] != block[None, :]
    return np.triu(fits, 1)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _by_bucket(rows: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    order = ["_key", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, len(order)):
            if group.num_rows > 1:
                result = judge(group)
                if result is not None:
                    yield result

    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _pairs_in(group: pa.Table) -> np.ndarray:
    key, i, j = (group.column(c)[0].as_py() for c in ("_key", "_i", "_j"))
    return _candidates(
        key, i != j, group.column("_block").to_numpy(), group.column("_n").to_numpy().astype(float),
        _arrays(group.column("_keys")), _arrays(group.column("_met")),
    )


def _needed(group: pa.Table) -> pa.RecordBatch | None:
    pairs = _pairs_in(group)
    wanted = np.nonzero(pairs.any(axis=0) | pairs.any(axis=1))[0]
    if not len(wanted):
        return None
    table = group.take(pa.array(wanted)).combine_chunks()
    return table.to_batches()[0]


def _compared(group: pa.Table) -> pa.RecordBatch | None:
    """Exact similarity of the pairs of a bucket: links and least connected set of each."""
    pairs = _pairs_in(group)
    sets = [_unpack(s) for s in group.column("_shingles").to_pylist()]
    size = np.array([len(s) for s in sets], float)
    left, right = np.nonzero(pairs)
    if not len(left):
        return None
    if len(left) < 4 * len(sets):
        inter = np.fromiter((len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(left, right)), float, len(left))
    else:
        inter = _common(sets)[left, right]
    # inter / union >= 4/5 in whole numbers.
    linked = (NUMERATOR + DENOMINATOR) * inter >= NUMERATOR * (size[left] + size[right])
    left, right = left[linked], right[linked]
    if not len(left):
        return None
    copies, rows = group.column("_copies").to_numpy(), group.column("_row").to_numpy()
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, left, copies[right])
    np.add.at(links, right, copies[left])
    root = rows.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, left, before[right])
        np.minimum.at(root, right, root[left])
        if np.array_equal(before, root):
            break
    had = np.nonzero(links)[0]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[had]), pa.array(links[had]), pa.array(root[had])], ["_row", "_links", "_root"]
    )


def _pack(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: of two texts of a million words, one pair in 300 shares a hash by chance."""
    upper = np.unique(shingles >> np.uint64(16)).astype("<u8")
    return upper.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _with_shingles(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``(_row, _shingles)`` of the needed rows of ``(_row, text)``, written."""
    ids = needed.select("_row").distinct()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _text_slices(batch):
                packed = [_pack(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["_row", "_shingles"])

    ids = written(ids, "jaccard-needed-ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    wanted = texts.join(ids, "_row", "left_semi").select("_row", "text")
    return written(wanted.mapInArrow(fetch, "_row bigint, _shingles binary"), "jaccard-shingles")


def _classes(docs: DataFrame, files: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and for each distinct set its class: both written."""
    sketches = sketched(docs, files, runs_for(recall))
    classes = written(
        sketches.filter("_set IS NOT NULL").groupBy("_set").agg(
            F.min("_row").alias("_rep"), F.count("*").alias("_copies"), F.min("doc_id").alias("_least")
        ),
        "jaccard-classes",
    )
    reps = written(
        sketches.join(classes.select(F.col("_rep").alias("_row"), "_copies"), "_row").select(
            "_row", "_n", "_copies", "_keys"
        ),
        "jaccard-representatives",
    )
    bucket_schema = (
        "_key bigint, _i int, _j int, _block int, _row bigint, _n int, _copies bigint, _keys array<bigint>, _met array<bigint>"
    )
    needed = written(_by_bucket(bucket_rows(reps, sketches.filter("_set IS NOT NULL")), _needed, bucket_schema), "jaccard-needed")
    rows = needed.join(_with_shingles(with_places(docs, files, "text"), needed), "_row")
    links = written(
        _by_bucket(rows.select(*needed.columns, "_shingles"), _compared, "_row bigint, _links bigint, _root bigint"),
        "jaccard-links",
    )
    found = components(links.select(F.col("_row").alias("a"), F.col("_root").alias("b")))
    totals = links.groupBy("_row").agg(F.sum("_links").alias("_links")).withColumnRenamed("_row", "_rep")
    placed = (
        classes.join(totals, "_rep", "left").join(found.select(F.col("node").alias("_rep"), "root"), "_rep", "left")
        .withColumn("root", F.coalesce("root", "_rep"))
    )
    return sketches, written(placed, "jaccard-placed")


def joined(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``(doc_id, class_id, copy_of, n_links)`` for every document.

    ``class_id`` is the least id that the document is connected with, ``copy_of`` the least id
    with the same shingles, ``n_links`` the number of other documents at the threshold or above.
    """
    sketches, placed = _classes(docs, file_numbers(docs), recall)
    least = placed.groupBy("root").agg(F.min("_least").alias("class_id"))
    links = F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))
    by_set = placed.join(least, "root").select("_set", "class_id", F.col("_least").alias("copy_of"), links.alias("n_links"))
    every = sketches.select("doc_id", "_set").join(by_set, "_set", "left")
    own = lambda c: F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return every.select("doc_id", own("class_id"), own("copy_of"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def deduplicated(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One document of each class, that of the least id; all columns. Texts without words all stay."""
    files = file_numbers(docs)
    sketches, placed = _classes(docs, files, recall)
    rows = written(sketches.join(placed.select("_set", "root"), "_set").select("root", "doc_id", "_row"), "jaccard-members")
    # A null id comes before all others; of repeated ids the first row stays.
    keepers = rows.groupBy("root").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_kept"))
    dropped = written(rows.join(keepers, "root").filter("_row <> _kept").select("_row"), "jaccard-dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    named = with_places(docs, files, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return named.join(dropped, "_row", "left_anti").select("_doc.*")


ORACLE = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WORDS}
        THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS k FROM s GROUP BY 1
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE {NUMERATOR + DENOMINATOR} * i >= {NUMERATOR} * (x.n + y.n)
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM n
    UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
)
SELECT d.doc_id, coalesce((SELECT min(root) FROM reach WHERE node = d.doc_id), d.doc_id) AS class_id,
    coalesce((SELECT min(m.doc_id) FROM n m WHERE m.k = (SELECT k FROM n WHERE n.doc_id = d.doc_id)), d.doc_id) AS copy_of,
    (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM documents d
"""
