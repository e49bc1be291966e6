"""Tables written to the folder that driver and executors share.

Lineage is cut by writing a Parquet table, never by a local checkpoint: an executor that is lost
takes nothing with it. The folder is the one the cluster names in ``spark.checkpoint.dir``, or the
one set as the checkpoint folder of the context; only a local master, where all executors are this
machine, gets a temporary folder where neither is set. Tables lie in a folder of the application, and
:func:`release` deletes them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session's cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        given = context._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _OWN[app]


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the plan restarts at that table."""
    return read_table(df.sparkSession, write_table(df, label), df.schema)


def write_table(df: DataFrame, label: str = "table") -> str:
    """Write ``df`` under a new name. Shuffle files go as soon as the table is there: what comes after
    starts from it."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`write_table`."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; DataFrames that read them end with it."""
    drop_table(spark, own_dir(spark))
