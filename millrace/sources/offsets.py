"""A plain-text collection by byte offset: ranges of its files are dealt to tasks, and every line comes with the byte it begins at.

Small ranges may share a task, so that the number of tasks follows the bytes and not the files.
A range owns the lines that begin in it. Its task looks at the byte before to see whether a line begins right there, and reads past its
end to finish the last one, so every line comes once whatever the ranges are, and a file of any size is read in many tasks, a block at a
time. Lines end at a line feed; a carriage return before it is dropped from the line, not from the count. A file that ends in a
line feed has no further, empty line. Bytes that aren't UTF-8 are replaced in the line.

Paths may be local or any URI that pyarrow's file systems open (``hdfs://``, ``s3://``, ``gs://``). Compressed files are refused wherever they
stand, as their bytes are no places in the text. Names that begin with ``_`` or ``.`` are no data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE, BLOCK = 128 << 20, 4 << 20
#: Tasks for a core: small ranges, of whatever number, are dealt to as many.
TASKS = 4
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy", ".deflate")
SCHEMA = "file string, offset long, line string"


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path there, and what to put before such a path to get a path again."""
    if "://" in path or path.startswith("file:"):
        path = path if "://" in path else "file://" + path[len("file:") :]
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return fs.LocalFileSystem(), path, ""


def data_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of all plain files at or below ``path``, in order; a compressed one is refused."""
    system, inner, before = _system(path)
    top = system.get_file_info(inner)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    below = lambda f: f.path[len(inner.rstrip("/")) + 1 :].split("/") if f is not top else [f.base_name]
    out = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in below(f))]
    if bad := [f.path for f in out if f.path.endswith(COMPRESSED)]:
        raise ValueError(f"a compressed collection can't be read by offset: {bad[0]}")
    return sorted((before + f.path, f.size) for f in out)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lines [starts, ends) of a block as text, without their last carriage return."""
    full = ends > starts
    ends = np.where(full & (data[np.maximum(ends - 1, 0)] == 13), ends - 1, ends) if len(data) else ends
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    kept = data[np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])]
    got = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept)))
    try:
        got.validate(full=True)
    except pa.ArrowInvalid:
        raw = kept.tobytes()
        got = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.large_string())
    return got.cast(pa.string())


def lines_of(file: str, start: int, end: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The lines of ``file`` that begin in [start, end), a batch a block."""
    system, inner, _ = _system(file)
    with system.open_input_file(inner) as f:
        size = f.size()
        at = max(0, start - 1)  # of the first byte of ``data``
        f.seek(at)
        data, seeking = b"", start > 0
        while at < end or (data and not seeking):
            more = f.read(block)
            whole = data + more
            ended = at + len(whole) >= size
            bytes_ = np.frombuffer(whole, np.uint8)
            breaks = np.flatnonzero(bytes_ == 10)
            if seeking:  # the line before the first line feed is an earlier range's
                if not len(breaks):
                    if ended or at + len(whole) - 1 >= end:
                        return
                    at, data = at + len(whole), b""
                    continue
                starts, seeking = breaks + 1, False
                breaks = breaks[1:]
            else:
                starts = np.concatenate(([0], breaks + 1))
            ends = np.append(breaks, len(whole)) if ended and starts[-1] < len(whole) else breaks
            n = min(len(ends), int(np.searchsorted(starts + at, end, "left")))
            if n:
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.string()), "offset": pa.array(starts[:n] + at, pa.int64()), "line": _column(bytes_, starts[:n], ends[:n])})
            rest = int(starts[n]) if n < len(starts) else len(whole)
            if ended or at + rest >= end:
                return
            at, data = at + rest, whole[rest:]


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.tasks = options["path"], int(options.get("rangebytes", RANGE)), int(options.get("tasks", 0))

    def partitions(self) -> list[Ranges]:
        """Ranges in order, as many a task as make up an equal share of the bytes among ``tasks``, or RANGE bytes if that is less; one at least."""
        files = data_files(self.path)
        share = min(RANGE, sum(n for _, n in files) / self.tasks) if self.tasks else 0
        out, room = [Ranges([])], share
        for r in (Range(f, s, min(n, s + self.size)) for f, n in files for s in range(0, n, self.size)):
            if out[-1].ranges and r.end - r.start > room:
                out.append(Ranges([]))
                room = share
            out[-1].ranges.append(r)
            room -= r.end - r.start
        return out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from lines_of(r.file, r.start, r.end)


class OffsetLines(DataSource):
    """Format ``offset_lines``: options path, rangebytes and tasks."""

    @classmethod
    def name(cls) -> str:
        return "offset_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE, tasks: int = 0) -> DataFrame:
    """(file, offset, line) of a collection; refuses a compressed file before any job runs. tasks: small ranges are dealt to so many; else each is one."""
    data_files(path)
    spark.dataSource.register(OffsetLines)
    return spark.read.format("offset_lines").option("path", path).option("rangebytes", range_bytes).option("tasks", tasks).load()


def line_at(file: str, offset: int, block: int = 4096) -> str:
    """The line of ``file`` that begins at ``offset``; only its own bytes are read, to a block."""
    system, inner, _ = _system(file)
    with system.open_input_file(inner) as f:
        f.seek(offset)
        got = b""
        while b"\n" not in got and (more := f.read(block)):
            got += more
    line = got.partition(b"\n")[0]
    return (line[:-1] if line.endswith(b"\r") else line).decode("utf-8", "replace")


def lines_at(hits: DataFrame) -> DataFrame:
    """(file, offset, line) of hits (file, offset): each task reads its own hits' lines where they stand, and no others."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [line_at(f, o) for f, o in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"file": b.column("file"), "offset": b.column("offset"), "line": pa.array(lines, pa.string())})

    return hits.select("file", F.col("offset").cast("long").alias("offset")).mapInArrow(go, SCHEMA)
