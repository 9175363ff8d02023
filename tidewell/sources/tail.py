"""Lines of growing files as a stream source of Spark's: each line once, when it is whole.

An offset is how many bytes of each file have been read, always the end of a line, so a last line that is still being written waits for a later batch. A batch's bytes are cut into
ranges that tasks read side by side; a range has the lines that begin in it. Files that come later are read from their beginning. A batch that is run again reads the same
bytes, as files only grow.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINE = "file string, at long, line string"
#: Bytes of a range, of a look back for a line's end, and lines of an Arrow batch.
RANGE, LOOK, LINES = 32 << 20, 1 << 16, 10_000


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `begin` or later and before `end`; unless `first`, begin may lie inside a line, which is the range's before."""

    file: str
    begin: int
    end: int
    first: bool


def _opened(path: str) -> tuple[filesystems.FileSystem, str]:
    return filesystems.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (filesystems.LocalFileSystem(), path)


def _whole(store: filesystems.FileSystem, file: str, begin: int, size: int) -> int:
    """Where the last whole line of a file's first `size` bytes ends; begin where none ends after it."""
    with store.open_input_file(file) as f:
        end = size
        while end > begin:
            start = max(begin, end - LOOK)
            found = f.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return begin


def _ends(path: str, pattern: str, before: dict[str, int]) -> dict[str, int]:
    """How far each file below path whose name ends in pattern has whole lines."""
    store, folder = _opened(path)
    info = store.get_file_info(folder)
    if info.type == filesystems.FileType.NotFound:
        return dict(before)
    files = [info] if info.is_file else [x for x in store.get_file_info(filesystems.FileSelector(folder)) if x.is_file and x.base_name.endswith(pattern) and not x.base_name.startswith((".", "_"))]
    return before | {x.path: _whole(store, x.path, before.get(x.path, 0), x.size) for x in files}


def _ranges(begin: dict[str, int], end: dict[str, int]) -> list[Range]:
    return [Range(f, a, min(a + RANGE, end[f]), a == begin.get(f, 0)) for f in sorted(end) for a in range(begin.get(f, 0), end[f], RANGE)]


def _read(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(path)
    rows: tuple[list, ...] = ([], [], [])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["file", "at", "line"])
        [x.clear() for x in rows]
        return made

    with store.open_input_file(part.file) as f:
        # from the byte before, to see whether a line begins at the range's first
        f.seek(part.begin - (not part.first))
        at = part.begin if part.first else f.tell() + len(_line(f))
        while at < part.end:
            raw = _line(f)
            for column, x in zip(rows, (part.file, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")), strict=True):
                column.append(x)
            at += len(raw)
            if len(rows[0]) == LINES:
                yield batch()
    if rows[0]:
        yield batch()


def _line(f: pa.NativeFile) -> bytes:
    """The bytes up to the next line's end, which is there."""
    start, parts = f.tell(), []
    while block := f.read(LOOK):
        found = block.find(b"\n")
        if found >= 0:
            parts.append(block[: found + 1])
            break
        parts.append(block)
    whole = b"".join(parts)
    f.seek(start + len(whole))
    return whole


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.seen = path, pattern, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = _ends(self.path, self.pattern, self.seen)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begin, upto = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {f: max(n, self.seen.get(f, 0)) for f, n in upto.items()} | {f: n for f, n in self.seen.items() if f not in upto}
        return _ranges(begin, upto)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Batch(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Range]:
        return _ranges({}, _ends(self.path, self.pattern, {})) or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.end else iter(())


class GrowingLines(DataSource):
    """Options: path, of a file or a folder in a store that Arrow reads; pattern, how names of a folder's files end (all by default)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], self.options.get("pattern", ""))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self.options["path"], self.options.get("pattern", ""))


def lines(spark: SparkSession, path: str, stream: bool = False, pattern: str = "") -> DataFrame:
    """file, at (the byte where it begins) and line of the whole lines there are, or as a stream those that come."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream if stream else spark.read
    return reader.format(GrowingLines.name()).option("path", path).option("pattern", pattern).load()


def parsed(told: DataFrame, schema: str) -> DataFrame:
    """lines() that aren't blank, with the columns of schema and torn: whether the line is no such object."""
    row = F.from_json("line", f"{schema}, __torn string", {"columnNameOfCorruptRecord": "__torn", "mode": "PERMISSIVE"})
    full = told.where(F.trim("line") != "").withColumn("__row", row)
    return full.select("file", "at", "__row.*").withColumnRenamed("__torn", "torn_line").withColumn("torn", F.col("torn_line").isNotNull()).drop("torn_line")
