"""Session settings and the shared folder used to cut long lineages."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name="skygrade", master=None, **conf):
    """A session with adaptive execution on, the web page off and UTC as its zone."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A folder of our own is made only for a local session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="skygrade-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return os.path.join(shared_folder(spark), f"skygrade-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(own_folder(spark), f"{label}-{uuid.uuid4().hex}")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a written table on disk."""
    target, files = file_system(spark, path)
    return files.getContentSummary(target).getLength()


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables this application wrote; frames built on them cannot be read any more."""
    target, files = file_system(spark, own_folder(spark))
    files.delete(target, True)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Scope whose intermediate tables are deleted at its end: use or write out results inside it."""
    try:
        yield
    finally:
        drop_tables(spark)


def materialise(df: DataFrame, label="table", partition_by=()) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back.

    The table survives the loss of executors, so nothing downstream has to
    repeat the work above it, and every reader sees the same rows. A reader that
    filters on a ``partition_by`` column opens only the files it needs.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
