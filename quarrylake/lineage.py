"""Cutting lineage through the folder that all executors share, and small files in whatever store holds it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder named in ``spark.checkpoint.dir``; a folder of its own only where that is unset and the master is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="quarrylake-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more; by itself it waits until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a small file."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a file with one line of content if there is none of that name; of several writers one is told True.

    The content is written aside and then given its name in one step that fails where the name is taken:
    a rename, which a distributed file system refuses onto an existing file, or a hard link on a local one.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}-{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(f"{content}\n".encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(at) and bool(fs.rename(aside, at))
        try:
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(at.toUri().getPath()).toPath(), jvm.java.io.File(aside.toUri().getPath()).toPath())
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True
    finally:
        fs.delete(aside, False)
