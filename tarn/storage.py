"""Cutting lineage with tables written to the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests, one machine) an own one, kept for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="tarn-")
    return _own[key]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing is left to do it with
        pass


@atexit.register
def _remove_all() -> None:
    for spark, paths in list(_written.items()):
        _remove(spark, paths)


#: With this on, Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages start from a table that survives lost executors.

    The shuffle files of the write are deleted at its end, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df), and its rows as counted while they were written."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    written = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return written, seen.get["n"]


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote, when nothing reads it any more."""
    _forget(df.sparkSession, [getattr(df, "_cut_path", None)])


def _forget(spark: SparkSession, paths: list[str | None]) -> None:
    mine = _written.get(spark, [])
    gone = [p for p in mine if p in paths]
    _remove(spark, gone)
    for p in gone:
        mine.remove(p)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that cut() writes in this block are deleted at its end, but for those given to the function it yields.

    with scratch(spark) as keep: ...; return keep(cut(...))"""
    before, kept = set(_written.get(spark, [])), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._cut_path)
        return df

    try:
        yield keep
    finally:
        _forget(spark, [p for p in _written.get(spark, []) if p not in before and p not in kept])
