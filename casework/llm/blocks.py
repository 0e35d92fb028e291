"""Helpers for tasks that work through rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of the keys they have, from batches sorted by ``key``.

    Only the rows of the last key of a batch wait for the next one."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], side="left"))
        first = kept[0].column(key)[0].as_py() if kept else None
        if last == 0 and (not kept or first == k[-1]):
            kept.append(batch)
            continue
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
        else:
            yield pa.Table.from_batches(kept)
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def spans(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])
