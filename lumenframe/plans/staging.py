"""Cutting lineage on storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session on one machine, as in tests, gets a temporary one, which goes with the process; on a cluster that fails."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
            return own.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    _MADE.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def discard(spark: SparkSession) -> int:
    """Deletes what this process wrote to fresh paths, once no result that reads it is needed any more; returns how many."""
    done = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are; for heavy work a row, and after columns are pruned.

    Inputs of many files are left as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder: later jobs read files, and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that it is computed once."""
    path = fresh_path(df.sparkSession, name)
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
