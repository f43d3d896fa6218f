"""Array kernels over whole texts.

Every text-scanning operator of this subpackage works on flat code-point arrays: an Arrow
string column becomes one ``uint32`` array plus row offsets, and words, windows and hashes are
computed for thousands of rows in a handful of numpy calls. Nulls count as empty texts. Work is
cut into chunks of about ``CHUNK`` bytes of whole rows, so memory doesn't follow the batch size
(one row longer than a chunk is a chunk of its own).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of ``batch`` with about ``size`` bytes of ``column`` each."""
    arr = batch.column(column)
    if batch.num_rows == 0:
        return
    o = offsets(arr)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(o, o[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)


def codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column and the offset of each row; null rows are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    o = offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[o[0] : o[-1]] if buf is not None else np.zeros(0, np.uint8)
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # bytes that aren't UTF-8: replaced row by row
        rows = [data[a - o[0] : b - o[0]].tobytes().decode("utf-8", "replace") for a, b in zip(o[:-1], o[1:], strict=True)]
        return codepoints(pa.array(rows, pa.large_string()))
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), count[o - o[0]]


@cache
def categories() -> np.ndarray:
    """The first letter of the Unicode category of every code point, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)).encode(), np.uint8)


@cache
def lower_map() -> np.ndarray:
    """Simple lower case of every code point."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


@cache
def word_mask() -> np.ndarray:
    """Letters, marks and numbers."""
    return np.isin(categories(), np.frombuffer(b"LMN", np.uint8))


@cache
def letter_mask() -> np.ndarray:
    return categories() == ord("L")


@cache
def nonspace_mask() -> np.ndarray:
    """``[^\\x20\\x09-\\x0D]``."""
    out = np.ones(sys.maxunicode + 1, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out


@cache
def _held(chars: str) -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


def among(cps: np.ndarray, chars: str) -> np.ndarray:
    """Whether each code point is one of ``chars``."""
    return _held(chars)[cps]


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` that don't cross a row: starts, ends, and the runs' offset per row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:n]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inv):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def _terms(shift: int) -> np.ndarray:
    """The mixed term of every code point up to U+FFFF."""
    return mix(np.arange(1 << 16, dtype=np.uint64) + _U(shift))


def span_hashes(cps: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the content of each span [s, e); equal contents have equal hashes wherever they stand."""
    n = 1 << max(16, int(len(cps) + 1).bit_length())
    power, inverse = _powers(n)
    total = np.zeros(len(cps) + 1, np.uint64)
    shift = (seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK
    term = _terms(shift)[cps] if cps.dtype == np.uint32 and len(cps) and cps.max() < 1 << 16 else mix(cps.astype(np.uint64) + _U(shift))
    term *= power[: len(cps)]
    np.cumsum(term, out=total[1:])
    h = (total[e] - total[s]) * inverse[s]
    return mix(h + (e - s).astype(np.uint64) * _U(0xA24BAED4963EE407))


def window_hashes(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within rows: hash, row, index of the first word."""
    count = np.maximum(np.diff(off) - (k - 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(row)) + np.repeat(off[:-1] - (np.cumsum(count) - count), count)
    out = np.zeros(len(row), np.uint64)
    for j in range(k):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += h[first + j]
    return mix(out), row, first


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """As row_sums, summed within each row only: one row's result never depends on the rows beside it."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Offsets of a list column without nulls, from 0."""
    o = lists.offsets.to_numpy().astype(np.int64)
    return o - o[0]
