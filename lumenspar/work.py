"""Shared working storage: where intermediate tables go and how lineage is cut.

The folder is the one the cluster names in ``spark.checkpoint.dir``, which driver
and executors share. Only where that setting is absent (tests, a laptop) is a
folder made on the local machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session as a URI, without a final slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        named = context._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
        if not named:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="lumenspar-")
            context.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/lumenspar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Tasks a core that write a table of few files; beyond, so many partitions a task.
TASKS_A_CORE, PARTITIONS_A_TASK = 4, 8


def in_few(df: DataFrame) -> DataFrame:
    """The same rows, whose partitions are taken one after another by as many tasks as keep the cores busy.

    So a table of many small partitions is written as few files. A plain file system without
    Hadoop's native library starts a process for each file, which for a moment counts the
    memory of its executor once more. Not for plans that go by a task's number.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, partitions // PARTITIONS_A_TASK))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    Cuts lineage: a lost executor costs a re-read of files, not a recomputation,
    and everything reading the result sees the same rows.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, name: str = "step") -> DataFrame:
    """``materialize`` in few files."""
    return materialize(in_few(df), name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all working tables of this application, once its results are written elsewhere."""
    remove(spark, f"{shared_dir(spark)}/lumenspar/{spark.sparkContext.applicationId}")
