"""Tables that end a lineage, in the shared folder that the session names, and row numbers without a single task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import wraps
from threading import get_ident

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, or below a temporary folder where that is unset and all runs on one machine, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _dirs:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _dirs[app] = f"{(top or tempfile.mkdtemp(prefix='tidewell-')).rstrip('/')}/tidewell-{uuid.uuid4().hex}"
        atexit.register(delete, spark, _dirs[app])
    return _dirs[app]


def filesystem(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system, as Spark's own readers reach it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = filesystem(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    try:
        p, fs = filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended before the interpreter; whoever owns the folder clears it
        pass


@dataclass(eq=False)
class _Scope:
    """The tables that a function under way has cut, and the thread that it runs in: a stream's batches run in one of their own."""

    thread: int
    tables: list[tuple[SparkSession, str]] = field(default_factory=list)


#: Of all threads, those of the innermost functions last.
_scopes: list[_Scope] = []


def _innermost() -> _Scope | None:
    return next((s for s in reversed(_scopes) if s.thread == get_ident()), None)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that neither its plan nor lost executors cost it again. Its shuffles' files go with the write."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if scope := _innermost():
        scope.tables.append((df.sparkSession, path))
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether a query's shuffle files go when it has ended, where Spark knows the setting; they stay until the driver collects garbage otherwise.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


@contextmanager
def passing() -> Iterator[None]:
    """What this thread cuts inside is deleted at the end: for work that leaves what it finds somewhere else."""
    own = _Scope(get_ident())
    _scopes.append(own)
    try:
        yield
    finally:
        if own in _scopes:
            _scopes.remove(own)
        for spark, path in own.tables:
            delete(spark, path)


def scoped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is cut as the last of its tables; the others are deleted when it returns or fails, so that disk is held for what is under way only."""

    @wraps(f)
    def run(*args: object, **named: object) -> DataFrame:
        with passing():
            own = _innermost()
            found = f(*args, **named)
            _scopes.remove(own)  # the result is its caller's
            return cut(found)

    return run


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with the position of each row, from 0, in the total order of the columns `order`.

    Rows are range-sorted; each partition numbers its own from where those before it end. The driver sees a count for each partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, total = {}, 0
    for row in sorted(dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before[row["__part"]], total = total, total + row["n"]
    offsets = spark.createDataFrame(list(before.items()), "__part int, __before long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def cumulative(df: DataFrame, order: str, **sums: str) -> DataFrame:
    """df (one row for each value of `order`) with columns that add up those named in sums over all rows up to this one, in order.

    As numbered(): each partition of the range-sorted rows adds up its own, and starts from the totals of those before it.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    dealt = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("__part", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("__part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect())
    rows, so_far = [], {k: 0 for k in sums}
    for t in totals:
        rows.append((t["__part"], *so_far.values()))
        so_far = {k: v + (t[k] or 0) for k, v in so_far.items()}
    before = spark.createDataFrame(rows, "__part int, " + ", ".join(f"__{k} {dealt.schema[c].dataType.simpleString()}" for k, c in sums.items()))
    own = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    added = dealt.join(F.broadcast(before), "__part")
    return added.select(*df.columns, *[(F.sum(c).over(own) + F.col(f"__{k}")).alias(k) for k, c in sums.items()])
