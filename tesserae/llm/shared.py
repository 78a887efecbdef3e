"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary one;
    on a cluster a machine-local folder would lose rows, so this raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Have Arrow hand Python at most ``size`` of rows at a time, so that long texts don't pile up in workers.

    A setting of the session; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Hadoop's file system, whichever scheme it has."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Parquet tables of one run; a lost executor re-reads them from the shared folder.

    Results read them lazily, so they live as long as the driver's JVM, which
    deletes the folder when it ends; ``drop`` frees tables sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as read back."""
        df.write.mode("errorifexists").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))
