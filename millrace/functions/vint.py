"""Integers in a variable number of bytes, as Hadoop writes them: -112 to 127 is one byte; otherwise a first byte tells the sign and
the number of bytes that follow, most significant first. ``encode`` and ``decode`` are column expressions; ``pack`` and ``unpack`` do
whole Arrow columns of them inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, NEGATIVE = -112, -120


def _hex(v: Column, n: Column | int = 2) -> Column:
    return F.lpad(F.hex(v), n, "0")


def encode(c: str | Column) -> Column:
    """A long column as bytes; null stays null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("long")
    size = F.when(v < 0, F.bitwise_not(v)).otherwise(v)  # of a negative number its complement is written
    n = F.ceil(F.length(F.hex(size)) / 2).cast("int")
    first = F.when(v < 0, NEGATIVE - n).otherwise(FIRST - n)
    return F.unhex(F.when((v >= FIRST) & (v <= 127), _hex(F.pmod(v, F.lit(256)))).otherwise(F.concat(_hex(F.pmod(first, F.lit(256))), _hex(size, 2 * n))))


def decode(c: str | Column) -> Column:
    """The number that the bytes of a binary column start with."""
    h = F.hex(F.col(c) if isinstance(c, str) else c)
    first = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    first = F.when(first > 127, first - 256).otherwise(first)
    n = F.when(first < NEGATIVE, NEGATIVE - first).otherwise(FIRST - first)
    size = F.conv(F.substr(h, F.lit(3), 2 * n), 16, 10).cast("long")
    return F.when(first >= FIRST, first.cast("long")).when(first < NEGATIVE, F.bitwise_not(size)).otherwise(size)


def pack(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of bytes, one number behind the other. off: where each row begins."""
    v = values.astype(np.int64)
    size = np.where(v < 0, ~v, v).view(np.uint64)
    one = (v >= FIRST) & (v <= 127)
    n = np.ones(len(v), np.int64)  # bytes behind the first
    for k in range(1, 8):
        n += size >= np.uint64(1 << (8 * k))
    n[one] = 0
    at = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.zeros(int(at[-1]), np.uint8)
    out[at[:-1]] = np.where(one, v, np.where(v < 0, NEGATIVE, FIRST) - n).astype(np.int8).view(np.uint8)
    for k in range(int(n.max(initial=0))):  # the k-th byte behind the first, most significant first
        has = n > k
        out[at[:-1][has] + 1 + k] = (size[has] >> (8 * (n[has] - 1 - k)).astype(np.uint64)).astype(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[off])), pa.py_buffer(out)]).cast(pa.binary())


def unpack(column: pa.Array) -> np.ndarray:
    """All numbers of a column of bytes that ``pack`` wrote. A first byte says how far off the next one is, so
    where numbers begin is found by doubling jumps: each time as many more are known."""
    column = column.cast(pa.large_binary())
    o = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]] if len(column) and o[-1] > o[0] else np.zeros(0, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    first = data.view(np.int8).astype(np.int64)
    step = np.where(first >= FIRST, 1, np.where(first < NEGATIVE, NEGATIVE - first, FIRST - first) + 1)
    begins = np.zeros(len(data) + 1, bool)
    begins[0] = True
    if (step == 1).all():
        begins[:-1] = True
    else:
        jump = np.minimum(np.arange(len(data)) + step, len(data))
        jump = np.append(jump, len(data))
        while True:  # every place known by now, and the place as many numbers behind it
            more = begins.copy()
            more[jump[np.flatnonzero(begins)]] = True
            if (more == begins).all():
                break
            begins, jump = more, jump[jump]
    at = np.flatnonzero(begins[:-1])
    lead, n = first[at], step[at] - 1
    out = np.where(n == 0, lead, 0).astype(np.uint64)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[has] = (out[has] << np.uint64(8)) | data[at[has] + 1 + k].astype(np.uint64)
    got = out.view(np.int64)
    return np.where((n > 0) & (lead < NEGATIVE), ~got, got)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_bytes(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the bytes of a long column of no nulls as ``name``: a batch of numbers at once."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pack(b.column(column).to_numpy(), np.arange(b.num_rows + 1))], names=[*b.schema.names, name])

    return df.mapInArrow(go, f"{_ddl(df)}, `{name}` binary")


def with_number(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the number that each value of a column of bytes holds as ``name``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unpack(b.column(column)), pa.int64())], names=[*b.schema.names, name])

    return df.mapInArrow(go, f"{_ddl(df)}, `{name}` bigint")
