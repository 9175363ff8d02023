"""What is remembered of posts across sessions: quantised vectors that expire.

A table of folders, one for each write. Rows are upserted by appending: a read takes the latest row of each id, and compact() rewrites the table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dequantised, quantised
from ..operators.chunks import last_of_each
from ..schemas import MEMORY
from ..storage import delete, filesystem

TTL = "INTERVAL 7 DAYS"


def remembered(posts: DataFrame, now: Column) -> DataFrame:
    """MEMORY rows of posts (id, vec, author) that have a vector."""
    return posts.where("vec is not null").select(F.col("id").cast("string").alias("id"), quantised("vec").alias("v"), F.col("author").cast("string").alias("a"), now.alias("t")).select("id", "v.q", "v.s", "a", "t")


def latest(rows: DataFrame) -> DataFrame:
    return last_of_each(rows, "id", "t")


def recalled(rows: DataFrame, now: Column, ttl: str = TTL) -> DataFrame:
    """The rows that haven't expired, oldest first."""
    return rows.where(F.col("t") >= now - F.expr(ttl)).orderBy("t", "id")


def as_prior(rows: DataFrame) -> DataFrame:
    """id, vec and author, as cluster() takes its memory."""
    return rows.select("id", dequantised("q", "s").alias("vec"), F.col("a").alias("author"))


@dataclass(frozen=True)
class Folder:
    """A written folder as a manifest names it: its path, the name of its write, and its latest time in microseconds (None: no rows)."""

    path: str
    batch: str
    newest: int | None


class Store:
    """A manifest, one small file for each version, names the folders that are the table; the last version counts. Versions come to be by a rename that fails where another writer has been, which
    then starts from that one's. So a reader sees a version or the next, whatever breaks off in between, and files that a reader may still be at are deleted by vacuum() only.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: str = TTL):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl

    # versions

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder below path, and when each was written, in milliseconds."""
        p, fs = filesystem(self.spark, f"{self.path}/{folder}")
        return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self) -> list[tuple[int, int]]:
        return [(int(n.removesuffix(".json")), t) for n, t in self._files("versions") if n.endswith(".json")]

    def _read(self, version: int) -> list[Folder]:
        lines = self.spark.read.text(f"{self.path}/versions/{version:012d}.json").collect()
        return [Folder(**json.loads(r.value)) for r in lines if r.value]

    def folders(self) -> tuple[int, list[Folder]]:
        """The last version (0: none yet) and the folders that it names."""
        versions = self._versions()
        return (versions[-1][0], self._read(versions[-1][0])) if versions else (0, [])

    def _commit(self, change: Callable[[list[Folder]], list[Folder]]) -> None:
        """The next version: change() of the last. Where another writer was first, change() of its version."""
        jvm = self.spark.sparkContext._jvm
        while True:
            version, folders = self.folders()
            draft, fs = filesystem(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray("\n".join(json.dumps(asdict(f)) for f in change(folders)).encode()))
            out.close()
            made, _ = filesystem(self.spark, f"{self.path}/versions/{version + 1:012d}.json")
            fs.mkdirs(made.getParent())
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(draft, made, none)
                return
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                fs.delete(draft, False)

    def _write(self, rows: DataFrame, batch: str) -> Folder:
        path = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        newest = self.spark.read.schema(MEMORY).parquet(path).agg(F.unix_micros(F.max("t"))).first()[0]
        return Folder(path, batch, newest)

    def _rows_of(self, folders: list[Folder]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], MEMORY)
        return latest(self.spark.read.schema(MEMORY).parquet(*[f.path for f in folders]))

    def _micros(self, at: Column) -> int:
        return self.spark.range(1).select(F.unix_micros(at.cast("timestamp"))).first()[0]

    # the table

    def rows(self) -> DataFrame:
        return self._rows_of(self.folders()[1])

    def remember(self, posts: DataFrame, now: Column | None = None, batch: str | None = None) -> None:
        """batch names the write: one that is done again replaces itself. Folders all of whose rows have expired by the latest of these rows fall out of the table, so age bounds it."""
        made = self._write(remembered(posts, F.current_timestamp() if now is None else now), batch or uuid.uuid4().hex)
        least = None if made.newest is None else self._micros(F.timestamp_micros(F.lit(made.newest)) - F.expr(self.ttl))
        fresh = lambda f: f.batch != made.batch and f.newest is not None and (least is None or f.newest >= least)
        self._commit(lambda folders: [*filter(fresh, folders), made])

    def _fresh(self, folders: list[Folder], now: Column) -> list[Folder]:
        """Folders with rows that haven't expired; the others needn't be read."""
        least = self._micros(now - F.expr(self.ttl))
        return [f for f in folders if f.newest is not None and f.newest >= least]

    def recall(self, now: Column | None = None) -> DataFrame:
        now = F.current_timestamp() if now is None else now
        return recalled(self._rows_of(self._fresh(self.folders()[1], now)), now, self.ttl)

    def compact(self, now: Column | None = None, keep: timedelta = timedelta(days=1)) -> None:
        """Rewrites what has not expired as one folder, the next version. What writers add meanwhile stays beside it. Older versions are readable for as long as vacuum() keeps them."""
        now = F.current_timestamp() if now is None else now
        read = self.folders()[1]
        made = self._write(recalled(self._rows_of(self._fresh(read, now)), now, self.ttl), f"compacted-{uuid.uuid4().hex}")
        self._commit(lambda folders: [made, *(f for f in folders if f not in read)])
        self.vacuum(keep)

    def vacuum(self, keep: timedelta = timedelta(days=1)) -> None:
        """Deletes versions but the last that were replaced longer than `keep` ago, and folders and drafts that old which no version left names, as writers that broke off leave them."""
        versions, least = self._versions(), (time.time() - keep.total_seconds()) * 1000
        # a version was replaced when the next one was written
        gone = [v for (v, _), (_, replaced) in zip(versions, versions[1:], strict=False) if replaced <= least]
        named = {f.path.rsplit("/", 1)[-1] for v, _ in versions if v not in gone for f in self._read(v)}
        for v in gone:
            delete(self.spark, f"{self.path}/versions/{v:012d}.json")
        for folder, kept in (("rows", named), ("drafts", set())):
            for name, written in self._files(folder):
                if name not in kept and written <= least:
                    delete(self.spark, f"{self.path}/{folder}/{name}")

    def count(self) -> int:
        return self.rows().count()

    def forget_all(self) -> None:
        delete(self.spark, self.path)
