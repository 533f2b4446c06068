"""Best-fit packing by the configuration linear program.

Documents become token pieces of at most ``CAPACITY`` tokens. Their lengths form a
histogram of at most ``CAPACITY`` rows, whatever the size of the corpus. A configuration is
a multiset of lengths that fits one sequence; the linear program asks for the fewest
configurations that cover the histogram. It is solved by multiplicative weights: a knapsack
dynamic program prices all configurations, for every length that is still open the best one
that holds it is used for a share of what its scarcest length needs, and the prices of the
lengths it covered fall. Uses are whole, so rounds run until every piece is covered and
nothing is left to rounding. Of equal values the longer lengths are taken.

Only the histogram and the patterns pass through the driver, both bounded by ``CAPACITY``.
Pieces are numbered within their length by hash bucket, so that a length which a third of
the pieces share is numbered by many tasks, and look up their sequence in the patterns.

Defined results: a null or empty text is one piece with the closing id alone; repeated rows
and ids are packed row by row; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.common import written

CAPACITY = 2048
END_ID = 0
STEP = 0.5           # share of the scarcest length's remaining need that a use covers
ETA = 1.0            # how fast the price of a covered length falls
TILT = 0.01          # by how much more a token of a longer piece is worth at the start
FULL = 0.995         # share of its promised value that a configuration must still have
BUCKETS = 64         # hash buckets in which the pieces of one length are numbered


# --- lengths to patterns, on the histogram ----------------------------------


@dataclass
class Pattern:
    times: int
    lengths: dict[int, int]   # length -> copies in one sequence


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of every capacity, and the length taken there (-1: none): unbounded knapsack."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    # Longest first, as argmax gives ties to the first.
    lengths, prices = lengths[::-1], prices[::-1]
    fitting = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fitting[c]
        best[c] = best[c - 1]
        if k < len(lengths):
            values = best[c - lengths[k:]] + prices[k:]
            j = int(values.argmax())
            if values[j] > best[c]:
                best[c], taken[c] = values[j], lengths[k + j]
    return best, taken


def _configuration(first: int, taken: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest value among those that hold ``first``."""
    chosen = {first: 1}
    c = capacity - first
    while c > 0:
        x = int(taken[c])
        if x < 0:
            c -= 1
            continue
        chosen[x] = chosen.get(x, 0) + 1
        c -= x
    return chosen


def lp_bound(histogram: dict[int, int], capacity: int) -> float:
    """Sequences that no solution of the linear program goes below, from two sets of dual prices."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths], float)
    # Lengths as prices; and half a sequence for each piece, a whole one beyond half the capacity.
    duals = [lengths.astype(float), np.where(2 * lengths > capacity, 1.0, np.where(2 * lengths == capacity, 0.5, 0.0))]
    return max(float(p @ counts) / max(_knapsack(lengths, p, capacity)[0][-1], 1e-300) for p in duals)


def whole_uses(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """Uses of configurations by multiplicative weights, until no length is left or ``rounds`` have run."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths], np.int64)
    left = dict(zip(lengths.tolist(), counts.tolist()))
    start = lengths * (1 + TILT * lengths / capacity)
    uses, number = [], 0
    while rounds is None or number < rounds:
        number += 1
        need = np.array([left[x] for x in lengths.tolist()])
        open_ = need > 0
        if not open_.any():
            break
        shares = 1 - need / counts
        prices = start * np.exp(-ETA * (shares - shares[open_].min()))
        price = dict(zip(lengths.tolist(), prices.tolist()))
        best, taken = _knapsack(lengths[open_], prices[open_], capacity)
        # Every open length has a configuration of its own under these prices.
        used = False
        for x in lengths[open_][::-1].tolist():
            if not left[x]:
                continue
            promised = _configuration(x, taken, capacity)
            chosen = {y: k for y, n in promised.items() if (k := min(n, left[y]))}
            value = sum(price[y] * k for y, k in chosen.items())
            # What this round has used up is priced again first, except for one use a round.
            if used and value < FULL * (price[x] + best[capacity - x]):
                continue
            if not used:
                chosen = _topped_up(chosen, left, capacity)
            room = min(left[y] // k for y, k in chosen.items())
            use = max(1, math.floor(STEP * room))
            for y, k in chosen.items():
                left[y] -= k * use
            uses.append((use, chosen))
            used = True
    return uses


def _topped_up(chosen: dict[int, int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The configuration with the longest pieces that still fit."""
    chosen = dict(chosen)
    space = capacity - sum(x * k for x, k in chosen.items())
    for x in sorted(left, reverse=True):
        k = min(space // x, left[x] - chosen.get(x, 0))
        if k > 0:
            chosen[x] = chosen.get(x, 0) + k
            space -= k * x
    return chosen


def _filled(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for what is left: the longest piece first, then always the longest that fits."""
    left = {x: n for x, n in left.items() if n > 0}
    patterns = []
    while left:
        space, chosen = capacity, {}
        for x in sorted(left, reverse=True):
            k = min(space // x, left[x])
            if k:
                chosen[x] = k
                space -= k * x
        times = min(left[x] // k for x, k in chosen.items())
        patterns.append(Pattern(times, chosen))
        for x, k in chosen.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return patterns


def patterns_for(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[Pattern]:
    """Patterns that together use every piece of the histogram exactly once."""
    full = [Pattern(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    rest = {x: n for x, n in histogram.items() if x < capacity}
    if not rest:
        return full
    merged: dict[tuple, int] = {}
    for use, chosen in whole_uses(rest, capacity, rounds):
        key = tuple(sorted(chosen.items(), reverse=True))
        merged[key] = merged.get(key, 0) + use
    kept = [Pattern(n, dict(key)) for key, n in merged.items()]
    left = dict(rest)
    for p in kept:
        for x, k in p.lengths.items():
            left[x] -= k * p.times
    return full + kept + _filled(left, capacity)


# --- documents to pieces ----------------------------------------------------


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every text.

    ``tokenizer`` is a path that every executor can read; by default each executor takes the
    installed vocabulary. Where a document is cut, its first piece may be shorter.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from casewright.llm.encoding import default_tokenizer, encoder, slices

        coder = encoder(tokenizer or default_tokenizer())
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for begin, stop in slices(texts):
                ids, bounds = coder.encode([t or "" for t in texts.slice(begin, stop - begin).to_pylist()], END_ID)
                totals = np.diff(bounds)
                number = -(-totals // capacity)
                row = np.repeat(np.arange(len(totals)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                head = totals - (number - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                first = bounds[:-1][row] + start
                cuts = [ids[a : a + n] for a, n in zip(first.tolist(), length.tolist())]
                columns = [
                    names.slice(begin, stop - begin).take(pa.array(row)), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))
                    ))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(pieces, T.StructType(fields))


# --- pieces to sequences ----------------------------------------------------


def _intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, pieces, copies, first_sequence, offset)`` of each length in each pattern."""
    rows, ranks, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for x in sorted(p.lengths, reverse=True):
            k = p.lengths[x]
            rank = ranks.get(x, 0)
            rows.append((x, rank, k * p.times, k, sequence, offset))
            ranks[x] = rank + k * p.times
            offset += k * x
        sequence += p.times
    return rows


def _numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add ``_rank``, from 0 without gaps within each length."""
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    sizes = spread.groupBy("length", "_bucket").count()
    # At most CAPACITY x buckets rows.
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")
    offsets = sizes.select("length", "_bucket", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    return (
        spread.withColumn("_own", own).join(F.broadcast(offsets), ["length", "_bucket"])
        .withColumn("_rank", F.col("_own") - 1 + F.col("_before")).drop("_own", "_before", "_bucket")
    )


def packed(pieces: DataFrame, capacity: int = CAPACITY, rounds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows.
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    rows = _intervals(patterns_for(histogram, capacity, rounds))
    schema = "length bigint, first_rank bigint, pieces bigint, copies bigint, first_sequence bigint, at bigint"
    slots = spark.createDataFrame(rows, schema).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "copies", "first_sequence", "at"))).alias("_slots")
    )
    # One row per length; every use halves the need of a length, so patterns are bounded by the capacity and the logarithm of the counts.
    found = _numbered(pieces, buckets).join(F.broadcast(slots), "length")
    slot = F.element_at(F.filter("_slots", lambda s: s["first_rank"] <= F.col("_rank")), -1)
    inside = found.withColumn("_slot", slot).withColumn("_k", F.col("_rank") - F.col("_slot.first_rank"))
    copies = F.col("_slot.copies")
    return inside.withColumns(
        {
            "sequence_id": F.col("_slot.first_sequence") + F.floor(F.col("_k") / copies).cast("bigint"),
            "offset": F.col("_slot.at") + F.pmod(F.col("_k"), copies) * F.col("length"),
        }
    ).drop("_slots", "_slot", "_k", "_rank")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there; ``keep_ids`` adds the token ids."""
    pieces = written(token_pieces(docs, tokenizer, keep_ids=keep_ids), "packing-pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return packed(pieces).select(*columns)
