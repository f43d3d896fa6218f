"""Rows of whole numbers as bytes: a row's lowest bytes side by side, then its next ones, as many as its largest number needs. Nothing has to be
read in order, so whole Arrow columns are packed and unpacked at once, and bytes that are alike stand together for Spark's compression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of bytes. off: where each row begins; no row is empty."""
    v, n = values.astype(np.int64).view(np.uint64), np.diff(off)
    top = np.maximum.reduceat(v, off[:-1]) if len(n) else v
    width = np.ones(len(n), np.int64)
    for k in range(1, 8):
        width += top >= np.uint64(1 << (8 * k))
    at = np.concatenate(([0], np.cumsum(width * n)))
    out = np.empty(int(at[-1]), np.uint8)
    place, step, wide = np.arange(len(v)) + np.repeat(at[:-1] - off[:-1], n), np.repeat(n, n), np.repeat(width, n)
    for k in range(int(width.max(initial=0))):
        has = slice(None) if k == 0 else np.flatnonzero(wide > k)
        out[place[has] + k * step[has]] = (v[has] >> np.uint64(8 * k)) & np.uint64(255)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.binary())


def unpack(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """All numbers of a column that ``pack`` wrote, ``n`` of them in each row."""
    column = column.cast(pa.large_binary())
    o = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    off = np.concatenate(([0], np.cumsum(n)))
    if not off[-1]:
        return np.zeros(0, np.int64)
    data, width = np.frombuffer(column.buffers()[2], np.uint8), np.diff(o) // n
    place, step, wide = np.arange(off[-1]) + np.repeat(o[:-1] - off[:-1], n), np.repeat(n, n), np.repeat(width, n)
    out = data[place].astype(np.uint64)
    for k in range(1, int(width.max(initial=0))):
        has = np.flatnonzero(wide > k)
        out[has] |= data[place[has] + k * step[has]].astype(np.uint64) << np.uint64(8 * k)
    return out.view(np.int64)
