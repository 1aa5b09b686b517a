"""Corpus pipeline: language ID, exact de-duplication, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of ``documents``; the last one returns the packed pieces.  Nulls may stand in any column: a null text has
no language and goes, a null id sorts below every other one, a null source conflicts with nothing.
Other columns than those of ``documents`` are left out, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.llm import exact_dedup, langid, near_copies, suffix_dedup
from quarrylake.llm.common import checkpointed, ensure_checkpoint_dir
from quarrylake.llm.queries import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text in a batch of the passage stage.
PASSAGE_BATCH = 4 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; ``lang`` becomes the prediction and stays as it is where nothing could be learned."""
    kept = langid.identify(docs.select(*COLUMNS), langid.fold("doc_id", 3) != 1, keep=("text", "lang", "source"))
    kept = kept.filter((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce(F.nullif("lang_pred", F.lit("und")), "lang"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first_copies(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates.

    Near-duplicates have a Jaccard similarity of 0.8 or more over five-word shingles; SimHash links them
    first, then bands.  A row without an id
    stays only where no row of its group has one.  Rows that share an id are told apart by their texts,
    and of rows that are equal in both one stays.
    """
    near = checkpointed(near_copies.near_copies(docs).select("doc_id", "text_key", "stays"))
    dropped = near.filter("not stays").select(F.col("doc_id").alias("id"), "text_key").distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(dropped, keyed["doc_id"].eqNullSafe(dropped["id"]) & (keyed["text_key"] == dropped["text_key"]), "left_anti")
    if not near.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("source", "lang"))).filter("nth = 1")
    return kept.select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; characters that are only partly covered stay."""
    # smaller batches than op7: by now the executors hold what the stages before have left in their heaps
    out = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), batch_bytes=PASSAGE_BATCH, whole_characters=True)
    text = F.col("kept").cast("string")
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins of one sequence each."""
    return pack_documents(docs)


#: The near-duplicate stage links by SimHash first and checks its links exactly.  Texts with a similarity of 0.8 lie up to 11
#: and more of 64 bits apart, beyond any radius that blocks of bits can index, so MinHash bands link what is left.  See the README.
STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]

#: No stage but exact de-duplication can be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder, read again, and removed when the next one is there."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            _remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    out = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    _remove(spark, folder)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
