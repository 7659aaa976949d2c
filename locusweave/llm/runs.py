"""Rows of one key side by side in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that end where a block ends, and the rows (from, to) of each of their blocks; rows come sorted, blocks are runs of equal first two columns."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        at, runs = 0, []
        for _, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            n = sum(1 for _ in rows)
            runs.append((at, at + n))
            at += n
        if runs:
            held = batch.slice(runs[-1][0])
            if len(runs) > 1:
                yield batch, runs[:-1]
    if held is not None and held.num_rows:
        yield held, [(0, held.num_rows)]
