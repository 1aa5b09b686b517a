"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of little-endian 16- or 32-bit ids in which every document ends with one
end-of-document id.  Files are read in blocks that know nothing of documents; each block finds its
separators with one vectorised search, and a two-level prefix scan over the block summaries (chunks of
blocks, then blocks of a chunk) gives every separator its ordinal and the length of the document that
it closes, also when that document began many blocks earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import checkpointed, id_in, id_out, thrifty

#: Bytes of one block.
BLOCK_BYTES = 1 << 18
#: Bytes that one task reads of a file, and the stores whose files it opens itself.
RANGE_BYTES, REACHED = 64 << 20, ("file", "hdfs", "s3", "gs")
#: Blocks of one chunk of the prefix scan.
CHUNK = 1024


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, block_no, data) of flat token files; an empty file gives no block.

    Only names and sizes are listed; each task opens a file at its own range and reads that, so files may
    be of any size.  Stores that neither ``open`` nor pyarrow reaches are read as whole files by Spark,
    where a file is held by one task.
    """
    found = spark.read.format("binaryFile").load(path)
    size = max(block_bytes, range_bytes // block_bytes * block_bytes)

    def in_blocks(name: str, first: int, content: bytes) -> Iterator[pd.DataFrame]:
        for k, s in enumerate(range(0, len(content), block_bytes)):
            yield pd.DataFrame({"file": [name], "block_no": [first // block_bytes + k], "data": [content[s : s + block_bytes]]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from in_blocks(name, 0, content)

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["path"], batch["start"].tolist(), strict=True):
                yield from in_blocks(name, start, read_range(name, start, size))

    schema = "file string, block_no long, data binary"
    schemes = [r[0] for r in found.select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()]  # a few at most
    if not all(s in REACHED for s in schemes):
        return found.select("path", "content").mapInPandas(thrifty(whole), schema)
    ranges = found.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInPandas(thrifty(ranged), schema)


def read_range(name: str, start: int, size: int) -> bytes:
    """At most ``size`` bytes of a file from ``start`` on."""
    if name.startswith("file:"):
        with open(unquote(urlsplit(name).path), "rb") as f:
            f.seek(start)
            return f.read(size)
    store, path = FileSystem.from_uri(name)
    with store.open_input_file(path) as f:
        return f.read_at(min(size, f.size() - start), start)


def token_blocks(df: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, width: int = 4) -> DataFrame:
    """(file, block_no, data, doc_ids): one flat token stream per partition, cut at fixed byte offsets.

    Null and empty texts are documents of no token; an empty table gives no blocks.  doc_ids lists the
    documents that end in the block, in stream order.  It stands beside the stream
    and is not looked at by the scan.  Strings of special tokens in a text are encoded as ordinary
    text, so the separator is never part of a document.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"stream-{context.partitionId() if context else 0:06d}"
        bpe, held, size, ids, number = encoder(tokenizer), [], 0, [], 0
        for batch in batches:
            for doc, parts in zip(batch["doc_id"], bpe.encode_batch(batch["text"], False), strict=True):
                tokens = np.fromiter(chain(chain.from_iterable(parts), (separator,)), kind)
                held.append(tokens.tobytes())
                size += tokens.nbytes
                rest = None
                if size >= block_bytes:
                    data = b"".join(held)
                    full = len(data) // block_bytes
                    rest = data[full * block_bytes :]
                    for k in range(full):  # a document ends in the block that holds its separator
                        mine = k == full - 1 and not rest
                        yield pd.DataFrame({"file": [name], "block_no": [number], "data": [data[k * block_bytes : (k + 1) * block_bytes]], "doc_ids": [ids + [doc] if mine else ids]})
                        number += 1
                        ids = []
                    held, size = [rest], len(rest)
                if rest is None or rest:
                    ids.append(doc)
        bpe.forget()
        if size or ids:
            yield pd.DataFrame({"file": [name], "block_no": [number], "data": [b"".join(held)], "doc_ids": [ids]})

    picked = df.select(id_in(id_col), F.col(text_col).alias("text"))
    return picked.mapInPandas(thrifty(run), "file string, block_no long, data binary, doc_ids array<long>")


def separators(data: bytes, separator: int, width: int = 4) -> np.ndarray:
    """Positions (in tokens) of the separator in one block."""
    return np.flatnonzero(np.frombuffer(data, f"<u{width}") == separator)


def scan(blocks: DataFrame, separator: int, width: int = 4, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, block_no, first_ordinal, lengths, *carry): lengths of the documents that end in each block.

    ``blocks`` has file, block_no and data, with every block of a file but the last of one size, a
    multiple of ``width``.  Tokens after the last separator of a file belong to no document and give no
    length.  Null or empty data is a block without tokens.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["data"]:
                at = separators(data or b"", separator, width)
                size = len(data or b"") // width
                rows.append((size, len(at), size - 1 - int(at[-1]) if len(at) else size, int(at[0]) if len(at) else 0, (np.diff(at) - 1).tolist()))
            n, found, tail, head, inner = zip(*rows, strict=True) if rows else ((),) * 5
            yield batch.drop(columns="data").assign(n=n, found=found, tail=tail, head=head, inner=inner)

    kept = blocks.select("file", "block_no", "data", *carry)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop("data").dtypes) + ", n long, found long, tail long, head long, inner array<long>"
    blocks = checkpointed(kept.mapInPandas(thrifty(summarise), schema).withColumn("chunk", F.floor(F.col("block_no") / chunk)))  # read twice below
    # tail of a run of blocks: tokens after its last separator; a run without separators adds all its tokens
    step = F.struct("block_no", "n", "found", "tail")
    folded = lambda c: F.aggregate(c, F.struct(F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("tail")), lambda a, x: F.struct((a["found"] + x["found"]).alias("found"), (F.when(x["found"] > 0, x["tail"]).otherwise(a["tail"] + x["tail"])).alias("tail")))
    slim = blocks.select("file", "chunk", "block_no", "n", "found", "tail")
    chunks = slim.groupBy("file", "chunk").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    chunks = chunks.select("file", "chunk", "steps", folded(F.col("steps")).alias("all"))

    def before(part: list[str], order: str, found: str, tail: str) -> tuple:
        """Separators before a row, and tokens between the last of them and the row."""
        w = Window.partitionBy(*part).orderBy(order)
        back = w.rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.sum(found).over(back), F.lit(0))
        total = F.coalesce(F.sum(tail).over(back), F.lit(0))
        # tokens counted up to and including the last row with a separator, but for that row's own tail
        spent = F.coalesce(F.max(F.when(F.col(found) > 0, F.struct(F.col(order), (F.col("_run") - F.col(tail)).alias("x")))).over(back)["x"], F.lit(0))
        return seen, total - spent

    w = Window.partitionBy("file").orderBy("chunk")
    tops = chunks.select("file", "chunk", F.col("all.found").alias("found"), F.col("all.tail").alias("tail")).withColumn("_run", F.sum("tail").over(w))
    seen, open_tokens = before(["file"], "chunk", "found", "tail")
    tops = tops.select("file", "chunk", seen.alias("top_found"), open_tokens.alias("top_open"))
    w = Window.partitionBy("file", "chunk").orderBy("block_no")
    lows = blocks.withColumn("_run", F.sum("tail").over(w))
    seen, open_tokens = before(["file", "chunk"], "block_no", "found", "tail")
    joined = lows.withColumn("low_found", seen).withColumn("low_open", open_tokens).join(tops, ["file", "chunk"])
    opened = F.col("low_open") + F.when(F.col("low_found") == 0, F.col("top_open")).otherwise(F.lit(0)) + F.col("head")
    lengths = F.when(F.col("found") == 0, F.array().cast("array<long>")).otherwise(F.concat(F.array(opened), F.col("inner")))
    return joined.select("file", "block_no", (F.col("top_found") + F.col("low_found")).alias("first_ordinal"), lengths.alias("lengths"), *carry)


def document_token_counts(df: DataFrame, tokenizer: str, separator: int = 50_256, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, ordinal, n_tokens for every row, counted by scanning the documents' token streams.

    Null text counts as empty and has no tokens; a null id stays null; repeated rows are counted each.
    An empty table gives no rows.
    """
    scanned = scan(token_blocks(df, tokenizer, separator, id_col, text_col, block_bytes), separator, carry=("doc_ids",))
    each = scanned.select("file", "first_ordinal", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("pos", "x"))
    return id_out(each.select(F.col("x.doc_ids").alias("doc_id"), "file", (F.col("first_ordinal") + F.col("pos")).alias("ordinal"), F.col("x.lengths").alias("n_tokens")))
