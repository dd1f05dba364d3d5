"""Small files in the folders that Spark shares, through Hadoop's file systems: whatever Spark reaches, this reaches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, uri: str) -> str:
    """The full URI of a path: one without a scheme belongs to the cluster's default file system."""
    fs, path = _path(spark, uri)
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    fs, path = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def read(spark: SparkSession, uri: str) -> bytes:
    fs, path = _path(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _path(spark, uri)
    fs.delete(path, True)


def publish(spark: SparkSession, folder: str, name: str, data: bytes) -> bool:
    """Write a whole file under a name that must be free; False if another writer was first.

    The file is written aside and then put in place in one step that fails if the name is taken: a hard link on a local file
    system, elsewhere Hadoop's rename without overwriting, which is atomic where the file system's rename is (HDFS).
    """
    fs, path = _path(spark, folder)
    fs.mkdirs(path)
    jvm, part = spark._jvm, f"_{uuid.uuid4().hex}"
    aside, target = jvm.org.apache.hadoop.fs.Path(path, part), jvm.org.apache.hadoop.fs.Path(path, name)
    stream = fs.create(aside, False)
    stream.write(bytearray(data))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath()
            try:
                os.link(os.path.join(local, part), os.path.join(local, name))
            except FileExistsError:
                return False
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, target, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(aside, False)


def arrow_uri(uri: str) -> str:
    """The URI as Arrow's file systems know it, for reading and writing in Python workers."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("gs://", "gs://")):
        if uri.startswith(ours):
            return theirs + uri[len(ours) :]
    return uri if "://" in uri or uri.startswith("file:") else "file://" + uri
