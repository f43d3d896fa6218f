"""The byte-offset source against a plain scan, for any ranges and blocks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources import offsets as O


def brute(data):
    out, at = [], 0
    for part in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
        out.append((at, (part[:-1] if part.endswith(b"\r") else part).decode("utf-8", "replace")))
        at += len(part) + 1
    return out


def content(rng):
    return b"".join(rng.choice([b"\n", b"\n", b"ab", b"\xc3\xa9", b"x" * rng.randrange(30), b"\r\n", b"\r", b"\xff"]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_and_blocks_against_a_scan(tmp_path, seed):
    rng = random.Random(seed)
    for i in range(25):
        data = content(rng)
        path = tmp_path / f"f{i}"
        path.write_bytes(data)
        for size in (1, 2, 3, 7, 50, 10_000):
            for block in (1, 2, 5, 64):
                got = [(o, line) for s in range(0, len(data), size) for b in O.lines_of(str(path), s, min(len(data), s + size), block) for o, line in zip(b.column("offset").to_pylist(), b.column("line").to_pylist(), strict=True)]
                assert got == brute(data), (data, size, block)
        for o, line in brute(data):
            assert O.line_at(str(path), o, 3) == line


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_source_reads_a_folder(spark, tmp_path, size):
    rng = random.Random(9)
    want = set()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a", "deep/b", "deep/empty"):
        data = b"" if name.endswith("empty") else content(rng) * 9
        (tmp_path / "in" / name).write_bytes(data)
        want |= {(str(tmp_path / "in" / name), o, line) for o, line in brute(data)}
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"no data")
    (tmp_path / "in" / ".a.crc").write_bytes(b"no data")
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        rows = [(r["file"].removeprefix("file://"), r["offset"], r["line"]) for r in O.read_lines(spark, path, size).collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert O.read_lines(spark, str(tmp_path / "in"), 5).rdd.getNumPartitions() >= len(want) // 40


def test_lines_at_hits(spark, tmp_path):
    (tmp_path / "t").write_bytes("é\n\nxy\r\nlast".encode())
    lines = O.read_lines(spark, str(tmp_path / "t"), 3)
    hits = lines.where("line <> ''").select("file", "offset")
    assert sorted(tuple(r)[1:] for r in O.lines_at(hits).collect()) == [(0, "é"), (4, "xy"), (8, "last")]
    assert O.lines_at(hits.limit(0)).count() == 0


def test_compressed_files_are_refused_anywhere(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "plain").write_text("x\n")
    with gzip.open(tmp_path / "d" / "e" / "a.gz", "wb") as f:
        f.write(b"hidden\n")
    for path in (str(tmp_path / "d"), str(tmp_path / "d" / "e" / "a.gz")):
        with pytest.raises(ValueError, match="compressed"):
            O.read_lines(spark, path)
        with pytest.raises(ValueError, match="compressed"):
            files.read_collection(spark, path)
    with pytest.raises(FileNotFoundError):
        O.read_lines(spark, str(tmp_path / "none"))


def test_a_large_file_is_many_tasks_and_long_lines_cross_ranges(spark, tmp_path):
    with open(tmp_path / "big", "w") as f:
        for i in range(200_000):
            f.write(f"line {i}\n" if i % 1000 else "y" * 70_000 + "\n")
    df = O.read_lines(spark, str(tmp_path / "big"), 1 << 16)
    assert df.rdd.getNumPartitions() > 200
    got = df.agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.sum(F.length("line") + 1).alias("bytes"), F.max(F.col("offset") + F.length("line") + 1).alias("last")).first()
    assert got["n"] == got["d"] == 200_000 and got["bytes"] == got["last"] == (tmp_path / "big").stat().st_size


def test_small_ranges_share_tasks(spark, tmp_path):
    """However many files there are, they make no more tasks than a few for a core, and every line still comes once."""
    for i in range(150):
        (tmp_path / f"f{i:03d}").write_text(f"{i} a\n{i} b\n")
    got = files.read_collection(spark, str(tmp_path), 4)
    assert got.rdd.getNumPartitions() <= 2 * O.TASKS * spark.sparkContext.defaultParallelism
    assert sorted(r["line"] for r in got.collect()) == sorted(f"{i} {x}" for i in range(150) for x in "ab")
