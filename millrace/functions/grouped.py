"""Rows of Arrow that lie in order of their keys, taken a group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where rows that are alike in all keys begin. Keys aren't null."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The same rows with where their groups begin, cut between groups only: some ``most`` of the column ``size`` at once, or one group."""
    held: list[pa.RecordBatch] = []  # of the last group, which may go on

    def cuts(t: pa.RecordBatch, at: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        upto = np.concatenate(([0], np.cumsum(t.column(size).to_numpy())))
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, min(len(at) - 1, int(np.searchsorted(upto[at], upto[at[lo]] + most, "right")) - 1))
            yield t.slice(at[lo], at[hi] - at[lo]), at[lo:hi] - at[lo]
            lo = hi

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and len(starts(one([held[-1].slice(held[-1].num_rows - 1), batch]), keys)) == 1:
            held.append(batch)
            continue
        t = one([*held, batch])
        at = starts(t, keys)
        yield from cuts(t, at)
        held = [t.slice(at[-1])]
    if held:
        yield one(held), np.zeros(1, np.int64)
