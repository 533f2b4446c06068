"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text, those are retained that begin at a minimiser: the position whose
window of ``GRAM`` words has the smallest hash among ``SPAN`` neighbours. The choice depends
on content alone, so copies of a passage retain the same suffixes. All retained suffixes of
the corpus are sorted by their first ``PREFIX`` words and compared with their neighbours. A
passage of ``PASSAGE`` words contains a retained suffix that begins within its first ``SPAN``
words and has ``PREFIX`` words in it, so none is missed.

Where neighbours agree, the match is extended: every passage of ``PASSAGE`` words that a
match can be part of, up to ``SPAN - 1`` words to its left and the rest to its right, is
sorted and compared with its neighbours in the same way. Passages that another document has
too are joined to spans as long as the repetition goes on.

The sort is a range partitioning by hash, document and place, in parts of ``PART_ROWS``: a passage
that a third of all documents share is cut into many of them. A task reads its part in order and
holds no more of a run of equal keys than the rows of the run's first document; once another
document has been seen, the rows of the run go out as they come. What a part cannot know, whether
its first and last run go on in its neighbours, is settled by a table of at most two keys a part.

Defined results: null, empty and short texts have no passages; passages repeated only within
one document are not reported; exact copies are repeated throughout; rows are told apart by
their file and place in it (so the input is read from Parquet files), also where they repeat an id;
an empty table gives an empty result; other columns are ignored. Words count from 0, ends are
exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import file_numbers, with_places, written
from casewright.llm.shingling import windows, word_hashes

PASSAGE = 50                     # words that make a passage
SPAN = 16                        # neighbours of which one is retained
GRAM = 10                        # words whose hash decides which
PREFIX = PASSAGE - SPAN + 1      # words of a retained suffix that are inside every passage it serves
SLICE_BYTES = 1 << 18            # text worked on at a time; a worker needs about forty times as much
PART_ROWS = 400_000              # rows of a part of the sort, about


def minimisers(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the smallest (of equal ones the first) in each run of ``span`` values."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    # A tree of minima over powers of two: value and place stay together by comparing values only.
    place = np.arange(len(grams))
    best, width = grams.copy(), 1
    while width < span:
        step = min(width, span - width)
        n = len(best) - step
        right = best[step:] < best[:n]
        best, place = np.where(right, best[step:], best[:n]), np.where(right, place[step:], place[:n])
        width += step
    return np.unique(place)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    from casewright.llm.encoding import slices

    texts = batch.column(batch.schema.get_field_index("text"))
    for begin, stop in slices(texts, SLICE_BYTES):
        yield batch.slice(begin, stop - begin), *word_hashes(texts.slice(begin, stop - begin))


def _rows(parts: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def suffixes(numbered: DataFrame) -> DataFrame:
    """``(_key, _row, _at)``: hash of the beginning of each retained suffix."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, bounds in _slices(batch):
                numbers, found = part.column(0).to_numpy(), []
                grams, begins = windows(hashes, GRAM), windows(hashes, PREFIX)
                for number, a, b in zip(numbers, bounds[:-1], bounds[1:]):
                    if b - a >= PASSAGE:
                        at = minimisers(grams[a : b - GRAM + 1])
                        at = at[at <= b - a - PREFIX]
                        found.append((begins[a + at].view(np.int64), np.full(len(at), number), at))
                if found:
                    yield _rows(found, ["_key", "_row", "_at"], [pa.int64(), pa.int64(), pa.int32()])

    return numbered.select("_row", "text").mapInArrow(retain, "_key bigint, _row bigint, _at int")


class _Run:
    """A run of equal keys that a batch leaves open: its first row, and rows of its first document."""

    def __init__(self, rows: pa.Table, opening: bool) -> None:
        self.key, self.row = rows.column("_key")[0].as_py(), rows.column("_row")[0].as_py()
        self.head, self.opening, self.shared, self.held = rows.slice(0, 1), opening, False, []

    def add(self, rows: pa.Table, others: list[str], first: bool) -> Iterator[pa.Table]:
        """Rows that can go out: all, once a second document is there, or if neighbours may go on with the run."""
        starts = np.zeros(rows.num_rows, bool)
        starts[0] = first
        self.held.append((rows, starts))
        # Sorted by document: the last row says whether there is another one.
        self.shared = self.shared or rows.column("_row")[rows.num_rows - 1].as_py() != self.row
        if self.shared or self.opening:
            yield from self.flush(others, self.opening)

    def flush(self, others: list[str], edge: bool) -> Iterator[pa.Table]:
        for rows, starts in self.held:
            yield _flagged(rows, others, np.full(rows.num_rows, edge), np.full(rows.num_rows, self.shared), starts, False)
        self.held = []

    def close(self, others: list[str]) -> Iterator[pa.Table]:
        """The part is over: what is left, or else a mark that the run was here."""
        if self.opening:
            return
        if self.shared:
            yield _flagged(self.head, others, np.ones(1, bool), np.ones(1, bool), np.ones(1, bool), True)
        else:
            yield from self.flush(others, True)


def _flagged(rows: pa.Table, others: list[str], edge: np.ndarray, shared: np.ndarray, first: np.ndarray, mark: bool) -> pa.Table:
    key = pa.array(rows.column("_key").to_numpy(), mask=~edge)
    columns = [rows.column(n) for n in ["_row", "_at", *others]]
    flags = [key, pa.array(shared), pa.array(first), pa.array(np.full(rows.num_rows, mark))]
    return pa.table([*columns, *flags], names=["_row", "_at", *others, "_edge", "_shared", "_first", "_mark"])


def _whole_runs(rows: pa.Table, others: list[str]) -> pa.Table:
    """Rows of the runs that lie inside a batch and that another document has too."""
    key, row = rows.column("_key").to_numpy(), rows.column("_row").to_numpy()
    starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    ends = np.concatenate([starts[1:], [len(key)]])
    shared = np.repeat(row[starts] != row[ends - 1], ends - starts)
    first = np.zeros(len(key), bool)
    first[starts] = True
    kept = rows.filter(pa.array(shared))
    return _flagged(kept, others, np.zeros(kept.num_rows, bool), np.ones(kept.num_rows, bool), first[shared], False)


def _told(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.Table]:
    """Flagged rows of a sorted part."""
    run: _Run | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        key = batch.column(batch.schema.get_field_index("_key")).to_numpy()
        if run is not None:
            goes_on = int(np.searchsorted(key, run.key, "right"))
            if goes_on:
                yield from run.add(rows.slice(0, goes_on), others, False)
            if goes_on == len(key):
                continue
            rows, key = rows.slice(goes_on), key[goes_on:]
        elif key[0] != key[-1]:
            run = _Run(rows, True)
            until = int(np.searchsorted(key, key[0], "right"))
            yield from run.add(rows.slice(0, until), others, True)
            rows, key = rows.slice(until), key[until:]
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield _whole_runs(rows.slice(0, last), others)
        run = _Run(rows.slice(last), run is None)
        yield from run.add(rows.slice(last), others, True)
    if run is not None:
        yield from run.close(others)


def _compared(rows: DataFrame, parts: int) -> DataFrame:
    """Add to each sorted row whether its neighbours share its key; rows that surely do not are gone.

    ``_edge`` is the key of rows of the first or last run of a part, where the answer is not
    known yet, and null elsewhere. A row with ``_mark`` is a second mention of the first row of
    a part's last run, for its neighbour.
    """
    others = [c for c in rows.columns if c not in ("_key", "_row", "_at")]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ["_row", "_at", *others])
    schema += ", _edge bigint, _shared boolean, _first boolean, _mark boolean"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _told(batches, others):
            yield from found.to_batches()

    order = ["_key", "_row", "_at"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, schema)


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose key another document has too, with ``_first`` for the first of its key."""
    rows = written(rows, name)
    compared = written(_compared(rows, max(1, -(-rows.count() // PART_ROWS))), f"{name}-compared")
    # Two keys at most for each part, however large a run is.
    edges = compared.filter("_edge IS NOT NULL").groupBy("_edge").agg(
        ((F.min("_row") != F.max("_row")) | F.max("_shared")).alias("_joined"), F.min(F.struct("_row", "_at")).alias("_least")
    )
    settled = compared.filter("NOT _mark").join(written(edges, f"{name}-edges"), "_edge", "left")
    return settled.filter(F.coalesce("_joined", "_shared")).withColumn(
        "_first", F.when(F.col("_least").isNull(), F.col("_first")).otherwise(F.struct("_row", "_at") == F.col("_least"))
    ).drop("_edge", "_shared", "_joined", "_least", "_mark")


def _extended(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(_key, _row, _at, doc_id)``: every passage that a matching suffix can be part of."""
    places = matches.groupBy("_row").agg(F.collect_set("_at").alias("_places"))
    kind = numbered.schema["doc_id"].dataType

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, bounds in _slices(batch):
                numbers, places = part.column("_row").to_numpy(), part.column("_places")
                passages, found, owners = windows(hashes, PASSAGE), [], []
                for i, (number, a, b) in enumerate(zip(numbers, bounds[:-1], bounds[1:])):
                    marked = np.zeros(b - a + 1, np.int32)
                    at = places[i].values.to_numpy(zero_copy_only=False)
                    # A passage begins from SPAN - 1 words before the suffix up to the suffix itself.
                    np.add.at(marked, np.maximum(at - SPAN + 1, 0), 1)
                    np.add.at(marked, at + 1, -1)
                    starts = np.nonzero(np.cumsum(marked)[: max(b - a - PASSAGE + 1, 0)] > 0)[0]
                    found.append((passages[a + starts].view(np.int64), np.full(len(starts), number), starts))
                    owners.append(np.full(len(starts), i))
                if found:
                    rows = _rows(found, ["_key", "_row", "_at"], [pa.int64(), pa.int64(), pa.int32()])
                    owner = part.column("doc_id").take(pa.array(np.concatenate(owners), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, owner], ["_key", "_row", "_at", "doc_id"])

    # Only texts with a match are fetched.
    texts = numbered.join(places, "_row").select("_row", "doc_id", "text", "_places")
    return texts.mapInArrow(extend, f"_key bigint, _row bigint, _at int, doc_id {kind.simpleString()}")


def _spans(marks: DataFrame) -> DataFrame:
    """Passages of each document joined to spans."""
    kind = marks.schema["doc_id"].dataType.simpleString()
    by_doc = marks.groupBy("_row", "doc_id").agg(F.collect_list(F.struct("_at", "_first")).alias("_marks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, starts, ends, later = [], [], [], []
            for i, marks in enumerate(batch.column("_marks")):
                at = marks.values.field("_at").to_numpy()
                first = marks.values.field("_first").to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                at, first = at[order], first[order]
                cut = np.concatenate([[0], np.nonzero(at[1:] > at[:-1] + PASSAGE)[0] + 1])
                stop = np.concatenate([cut[1:], [len(at)]])
                again = np.zeros(int(at[-1]) + PASSAGE + 1, np.int32)
                np.add.at(again, at[~first], 1)
                np.add.at(again, at[~first] + PASSAGE, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(again) > 0)])
                owner += [i] * len(cut)
                starts += at[cut].tolist()
                ends += (at[stop - 1] + PASSAGE).tolist()
                later += (covered[at[stop - 1] + PASSAGE] - covered[at[cut]]).tolist()
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, ends, later)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start_word", "end_word", "later_words"])

    return by_doc.mapInArrow(join, f"doc_id {kind}, start_word bigint, end_word bigint, later_words bigint")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, later_words)``: spans that other documents repeat.

    Every passage of ``PASSAGE`` words in a span stands in another document as well;
    ``later_words`` of the span repeat what comes first elsewhere and can be cut.
    """
    numbered = with_places(docs, file_numbers(docs), "doc_id", "text")
    matches = repeated(suffixes(numbered), "suffixes").select("_row", "_at")
    return _spans(repeated(_extended(matches, numbered), "passages"))
