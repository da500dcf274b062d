"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-parchment-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends and a lost executor costs no recomputation."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_gone(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no shuffle files: they go as each execution ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, at: str) -> DataFrame:
    """df written to a folder and read again, for tables of whole texts that go again soon: packed more tightly than stored() does, and without shuffle files left."""
    with shuffles_gone(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, at: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """written(), and what aggregates of its rows were as they were written: no pass of their own."""
    seen = Observation(at.rsplit("/", 1)[-1])
    out = written(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), at)
    return out, seen.get


def forget(spark: SparkSession, at: str) -> None:
    """Deletes a scratch table that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _published(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/_published")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, at: str) -> int:
    """The highest generation that was published in a store, 0 for none."""
    path, system = _published(spark, at)
    names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
    return max([0, *(int(n) for n in names if n.isdigit())])


def published(spark: SparkSession, at: str, generation: int) -> str:
    """What was published with a generation."""
    path, system = _published(spark, at)
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(path, str(generation)))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, at: str, generation: int, content: str = "") -> None:
    """Makes a generation count, by one file of its number; fails if there is one already."""
    path, system = _published(spark, at)
    own = spark._jvm.org.apache.hadoop.fs.Path(path, f"_{generation}-{uuid.uuid4().hex}")
    stream = system.create(own, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    # readers see the file with all that is in it, or not at all
    number = spark._jvm.org.apache.hadoop.fs.Path(path, str(generation))
    if system.exists(number) or not system.rename(own, number):
        raise FileExistsError(f"generation {generation} of {at} exists")


def read_or_empty(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """The Parquet rows there, none where there is no folder yet."""
    try:
        return spark.read.schema(schema).parquet(at)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
