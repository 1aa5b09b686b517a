"""Tables that are replaced as a whole: generations with an atomic commit, and stores that are brought up to date in part."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed, claim, names_in, read_line, remove

COMMITS = "commits"


def newest_generation(spark: SparkSession, folder: str) -> int:
    """The newest committed generation of a snapshot folder, 0 where there is none."""
    return max((int(n) for n in names_in(spark, f"{folder}/{COMMITS}") if n.isdigit()), default=0)


def save_if_current(tables: dict[str, DataFrame], folder: str, built_from: int) -> bool:
    """Saves the next generation after the one it was built from; where another has come in between it is not saved.

    The tables are written aside; what makes them the generation is a commit file that can be made only
    once, so of writers that start at the same time one is told True.  Readers see whole generations only.
    """
    spark = next(iter(tables.values())).sparkSession
    if newest_generation(spark, folder) != built_from:
        return False
    aside = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{aside}/{name}")
    if claim(spark, f"{folder}/{COMMITS}/{built_from + 1}", aside):
        return True
    remove(spark, f"{folder}/{aside}")
    return False


def load_generation(spark: SparkSession, folder: str, name: str, generation: int | None = None) -> DataFrame:
    """A table of a generation, the newest one if none is named."""
    number = newest_generation(spark, folder) if generation is None else generation
    return spark.read.parquet(f"{folder}/{read_line(spark, f'{folder}/{COMMITS}/{number}')}/{name}")


def bucket_of(path: Column, folders: int, parts: int) -> Column:
    """Files of one folder lie together, in ``parts`` buckets."""
    number = lambda text, n: F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int"), F.lit(n))
    return F.concat_ws("-", number(F.regexp_replace(path, "[^/]*$", ""), folders), number(path, parts))


def bring_up_to_date(found: DataFrame, folder: str, parse: Callable[[DataFrame], DataFrame], run: int, folders: int = 64, parts: int = 4) -> DataFrame:
    """(path, action, bucket): brings a store of parsed files up to date with ``found`` (path, size, mtime, text).

    A file whose size and time are those of the last run is the ``same`` and is not read; one whose content
    has the same hash is ``touched``; only ``new`` and ``parse``d ones go through ``parse``, which takes path
    and text and gives path and further columns.  The store lies in buckets; only those with a file that is
    not the same are written again, each as a whole, so a run that breaks off leaves others as they were
    and is made good by the next one.  Stored rows have the size, mtime and hash of their file and the run
    that parsed it.
    """
    spark = found.sparkSession
    there = [f"{folder}/{n}" for n in names_in(spark, folder) if n.startswith("bucket=")]
    known = spark.read.option("basePath", folder).parquet(*there) if there else None
    empty = found.select("path", "size", "mtime", F.sha1("text").alias("hash"), F.lit("").alias("bucket")).limit(0)
    index = (empty if known is None else known.select("path", "size", "mtime", "hash", "bucket")).select(*[F.col(c).alias(f"_{c}") for c in ("path", "size", "mtime", "hash", "bucket")])
    both = found.join(index, F.col("path") == F.col("_path"), "full")
    same_stat = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))  # a text may be null, and then its size and hash
    hash_ = F.when(~same_stat & F.col("path").isNotNull(), F.sha1("text"))
    action = F.when(F.col("path").isNull(), "removed").when(F.col("_path").isNull(), "new").when(same_stat, "same").when(F.col("hash").eqNullSafe(F.col("_hash")) & F.col("size").eqNullSafe(F.col("_size")), "touched").otherwise("parse")
    named = F.coalesce("path", "_path")
    told = both.withColumn("hash", hash_).select(named.alias("path"), action.alias("action"), F.coalesce("_bucket", bucket_of(named, folders, parts)).alias("bucket"), "size", "mtime", "hash")
    told = checkpointed(told)
    changed = told.filter("action <> 'same'")
    dirty = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # folders * parts at most
    if not dirty:
        return told.select("path", "action", "bucket")
    fresh = changed.filter("action IN ('new', 'parse')").select("path", "size", "mtime", "hash", "bucket", F.lit(run).alias("run"))
    texts = found.select("path", "text").join(fresh.select("path"), "path", "left_semi")
    rows = parse(texts).join(fresh, "path")
    if known is not None:
        old = spark.read.option("basePath", folder).parquet(*[p for p in there if p.rsplit("=", 1)[1] in set(dirty)] or there).filter(F.col("bucket").isin(dirty))
        stays = old.join(changed.select("path"), "path", "left_anti")
        moved = old.drop("size", "mtime").join(changed.filter("action = 'touched'").select("path", "size", "mtime"), "path")
        rows = rows.unionByName(stays).unionByName(moved)
    rows = checkpointed(rows)  # read before it is written over
    rows.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    for b in set(dirty) - left:  # all files of the bucket are gone
        remove(spark, f"{folder}/bucket={b}")
    return told.select("path", "action", "bucket")
