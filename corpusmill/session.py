"""Session factory shared by tests, benchmarks and local runs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "corpusmill", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution on; a cluster brings its own settings instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One parquet table of a data directory, any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Small rows that each take their time, over all cores: a table of few row groups is few tasks."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)  # a pattern, too
    return found is not None and len(found) > 0


def _on_store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def move(spark: SparkSession, source: str, to: str) -> None:
    """A folder to a place that is free, in one step where the store can."""
    store, at = _on_store(spark, source)
    place = spark._jvm.org.apache.hadoop.fs.Path(to)
    store.mkdirs(place.getParent())
    if store.exists(place) or not store.rename(at, place):
        raise OSError(f"could not move {source} to {to}")


def remove(spark: SparkSession, path: str) -> None:
    """A folder with all in it; nothing if it isn't there."""
    store, at = _on_store(spark, path)
    store.delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset and the master is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.conf.get("spark.master", "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def conf(spark: SparkSession, name: str, value: str):
    """While this holds, the session has a setting; its own one comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def pushed_filters(spark: SparkSession):
    """While this holds, filters reach Python data sources."""
    return conf(spark, "spark.sql.python.filterPushdown.enabled", "true")


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows written once to the shared folder: evaluated once, and safe when executors are lost."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()
