"""Session construction and the few settings that every plan relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "rankweave", memory: str = "8g") -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, which is only right when
    driver and executors are one machine; elsewhere that is an error.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "_made", None)
    if made is None or not os.path.isdir(made):
        made = shared_dir._made = tempfile.mkdtemp(prefix="rankweave-")
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut there.

    A reliable checkpoint: the loss of an executor costs nothing but the task
    it ran, and every later read sees the same rows.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it that don't go through Spark to read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job of its own made in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if its scan would keep most of them idle, else as it is.

    A table of a few small files gives a few tasks, too few for work that is
    heavy per row. Tables with more partitions than half the cores, as all
    large ones have, are never moved.
    """
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("Adaptive"):
        return df  # it has shuffles, whose partitions are settled when it runs
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df
