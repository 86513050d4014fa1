"""Where intermediate tables go, and how lineage is cut.

Everything that has to survive the loss of an executor is written below the folder named by
``spark.checkpoint.dir``. Where that setting is absent a folder of our own is chosen if all runs on one machine; on a cluster
its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Sets the checkpoint directory of the context when it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all of its machines share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), f"voxloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Used where several branches of a plan read the same costly intermediate result, or where a range partitioning would
    otherwise compute its input twice. Files are removed when the driver exits.
    """
    if getattr(df, "_written_once", False):  # a scan of such a table is not written again
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    scan = spark.read.schema(df.schema).parquet(path)
    scan._written_once = True
    return scan


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` before the driver ends, once nothing reads them any more."""
    for df in tables:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            for k, (spark, known) in enumerate(_written):
                if known.split("://")[-1].rstrip("/") == path.split("://")[-1].rstrip("/"):
                    _delete(spark, known)
                    del _written[k]
                    break


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM is already gone
            return


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """A scan that feeds Python work, on all cores: repartitioned where its files give fewer partitions than there are cores.

    Only for plans without a shuffle. An input that small costs next to nothing to move; a larger one is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if getattr(df, "_spread", False):
        return df
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    wide = df.repartition(cores, *keys)
    wide._spread = True
    wide._written_once = getattr(df, "_written_once", False)
    return wide
