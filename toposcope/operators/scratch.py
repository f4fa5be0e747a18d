"""Folders that the driver and all executors share, and tables written to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset (local tests) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("toposcope.scratch", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="toposcope-")
        spark.conf.set("toposcope.scratch", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as it is on disk: computed once, and not again when an executor is lost."""
    path = path or folder(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make a whole file, unless it exists: of writers at the same time one succeeds.

    Where the file is put in place by a rename, the file system must refuse to rename onto
    a file that exists, as HDFS does.
    """
    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, p = file_system(spark, draft)
    out = fs.create(p, False)
    out.write(bytearray(content))
    out.close()
    place = urlparse(path)
    if place.scheme == "file":  # a local rename would replace the file of another writer; a link does not
        try:
            os.link(urlparse(draft).path, place.path)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(p, False)
    target = file_system(spark, path)[1]
    done = not fs.exists(target) and fs.rename(p, target)
    if not done:
        fs.delete(p, False)
    return done


def content_of(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
