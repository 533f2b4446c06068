"""Groups of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist(), table.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = table.slice(a, b - a)
            if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(keys)):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()
