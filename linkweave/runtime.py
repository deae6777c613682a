"""Session helpers shared by iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Checkpoint folders that are marked for deletion already.
_OWNED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that setting and the
    context's own folder are both unset on a ``local`` master (tests, a laptop) is a local one
    chosen, since the other machines of a cluster would not see it. The folder is the
    application's own, and it and all that operators wrote there are deleted when the driver's
    JVM ends, after a failed query as after a good one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkweave-checkpoint-"))
    folder = context._jsc.sc().getCheckpointDir().get()
    if folder not in _OWNED:
        _OWNED.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read from there, for rounds whose files :func:`remove` takes away."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, with all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For CPU-heavy work on an input of few or unsplittable files; one with enough partitions is
    returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
