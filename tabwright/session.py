"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tabwright", master: str | None = None,
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    Nothing here sizes the cluster: shuffle partitions are only set when asked
    for (local runs); on a cluster AQE coalesces from the configured number.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    made only for a local session that has none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    root = os.environ.get("TABWRIGHT_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.environ["TABWRIGHT_SCRATCH"] = root
    return root


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A copy of ``df`` written below the shared folder, for results that several passes read.

    The passes then start from the compact copy instead of the source tables,
    also after an executor is lost.
    """
    path = scratch_table(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no result reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the copy that :func:`written` made, once nothing reads it any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, path)


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it; none in a store that only Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toUri().getPath() if system.getUri().getScheme() == "file" else None


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Plans run inside drop their shuffle files as soon as they end, not when the JVM happens to collect them."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
