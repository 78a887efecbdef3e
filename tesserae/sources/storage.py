"""Files beside tables: the folder that executors share, stores by URI, and names that are published once."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import quote, unquote, urlsplit

import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Schemes of Hadoop's clients and what the same store is called here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "viewfs": "hdfs"}


class Taken(FileExistsError):
    """Somebody else has published this name."""


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary one; on
    a cluster a machine-local folder would lose rows, so this raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; deleted when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _store(spark, at).deleteOnExit(_path(spark, at))
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _path(spark: SparkSession, at: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)


def _store(spark: SparkSession, at: str):
    return _path(spark, at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    return _store(spark, at).exists(_path(spark, at))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _store(spark, folder).listStatus(_path(spark, folder)))


def read_text(spark: SparkSession, at: str) -> str:
    stream = _store(spark, at).open(_path(spark, at))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, at: str, text: str) -> None:
    """Write a small file under a name that is not there yet, whole or not at all; raises Taken where it is.

    The text goes to a name of its own first.  That is linked (on a local disk) or
    renamed without overwriting, so of several writers one succeeds.
    """
    store, parent = _store(spark, at), _path(spark, at).getParent()
    store.mkdirs(parent)
    own = f"{parent.toString()}/.{uuid.uuid4().hex}"
    out = store.create(_path(spark, own), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if store.getScheme() == "file":
            os.link(*(str(_path(spark, p).toUri().getPath()) for p in (own, at)))
        else:
            jvm = spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(_path(spark, own), _path(spark, at), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except FileExistsError as e:
        raise Taken(at) from e
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Taken(at) from e
        raise
    finally:
        store.delete(_path(spark, own), False)


def delete(spark: SparkSession, at: str) -> None:
    _store(spark, at).delete(_path(spark, at), True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a URI or local path, for use in tasks; Hadoop's scheme names are known."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    uri = f"{SCHEMES.get(parts.scheme, parts.scheme)}://{parts.netloc}{quote(unquote(parts.path))}"
    return pafs.FileSystem.from_uri(uri)
