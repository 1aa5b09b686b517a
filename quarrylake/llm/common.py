"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import string
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id in Python and in joins; a pandas column of longs with nulls would lose digits.
NO_ID = -(1 << 63)


def id_in(col: str, name: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID)).alias(name)


def id_out(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.nullif(name, F.lit(NO_ID)))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII strings take the JVM's byte-wise ``lower``."""
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder named in ``spark.checkpoint.dir``; a folder of its own only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or "file://" + quote(tempfile.mkdtemp(prefix="quarrylake-")))


def give_back(cycles: bool = True) -> None:
    """Returns freed memory to the system: Python workers live on after a task and wait beside others.

    Looking for cycles takes long where many objects are alive; inside a task it can be left out.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives its memory back at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a few numbers that one task takes at least, where there are more tasks than cores.
ROWS_A_TASK = 1 << 17


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a narrow table: one for every core at least.  Each task of a shuffle leaves files, however few its rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def gathered(df: DataFrame) -> DataFrame:
    """A narrow table, checkpointed, in as many partitions as its rows are worth."""
    out = checkpointed(df)
    return out.coalesce(tasks_for(df.sparkSession, out.count()))


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the files of earlier rounds: it does so once the driver has collected what stood for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
