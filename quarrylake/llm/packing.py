"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards by a hash of their place in the table, so that hot sources and clusters are spread evenly, and each
shard is packed by best fit in order of decreasing length.  Bins are kept in order of what is left in
them and carry a bitmap of their sources and one of their duplicate clusters; the search starts at the
tightest bin that is large enough and goes on to its successors until a bin shares neither.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_in, id_out

CAPACITY = 2048
#: Documents of one shard, on average.
SHARD_ROWS = 4096


class Bins:
    """Open bins in order of their residual; ties go to the bin that was opened first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # residual, bin
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of an item; source and cluster are bitmaps of what it must not meet."""
        sources, clusters = self.sources, self.clusters
        for k in range(bisect_left(self.open, (size, -1)), len(self.open)):
            residual, b = self.open[k]
            if not (sources[b] & source or clusters[b] & cluster):
                del self.open[k]
                break
        else:
            residual, b = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        if residual > size:
            insort(self.open, (residual - size, b))
        return b, self.capacity - residual


def pack_shard(rows: list[tuple], capacity: int) -> Iterator[tuple]:
    """(piece, start, size, bin, offset) lists for (id, size, source, cluster) rows sorted by size.

    Whole capacities of a long document fill bins of their own; its remainder is packed like any other.
    """
    seen: dict = {}
    for _, _, _, cluster in rows:
        if cluster is not None:
            seen[cluster] = seen.get(cluster, 0) + 1
    bit: dict = {}
    for cluster, n in seen.items():  # a cluster with one member conflicts with nothing
        if n > 1:
            bit[cluster] = 1 << len(bit)
    source_bit: dict = {}
    bins = Bins(capacity)
    items = sorted(((size % capacity if size else 0, -i) for i, (_, size, _, _) in enumerate(rows)), reverse=True)
    found: list[list[tuple]] = [[] for _ in rows]
    for i, (_, size, source, cluster) in enumerate(rows):
        for piece in range(size // capacity):
            b, at = bins.place(capacity, 0, 0)
            found[i].append((piece, piece * capacity, capacity, b, at))
    for size, i in items:
        i = -i
        _, whole, source, cluster = rows[i]
        if size or not whole:
            mark = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
            b, at = bins.place(size, mark, bit.get(cluster, 0))
            found[i].append((whole // capacity, whole - size, size, b, at))
    yield from found


def pack(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, shard, bin, bin_offset.

    No bin holds two pieces of one source or of one cluster, but for the whole capacities of a long
    document, which have a bin each.  Null sizes and negative ones count as 0; an empty document is one
    piece of size 0; a null source or cluster conflicts with nothing.  Repeated rows are packed as
    often as they come.  An empty table gives no rows.
    """
    source = F.col("source") if source is None else source
    cluster = F.lit(None).cast("string") if cluster is None else cluster
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    # the sizes may be costly to work out, and they are read twice: for the number of shards and for packing
    picked = checkpointed(df.select(id_in(id_col), size.alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster")))
    shards = max(1, -(-picked.count() // shard_rows))
    # by the place of a row, not by its id: rows without one, or with the same, are spread like others
    dealt = picked.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id long, piece long, start_token long, n_tokens long, shard long, bin long, bin_offset long"

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        rows = [(i, n, None if pd.isna(s) else s, None if pd.isna(c) else c) for i, n, s, c in zip(shard["doc_id"].tolist(), shard["size"].tolist(), shard["source"], shard["cluster"], strict=True)]
        number = int(shard["shard"].iloc[0])
        out = [(row[0], piece, start, size, number, b, at) for row, pieces in zip(rows, pack_shard(rows, capacity), strict=True) for piece, start, size, b, at in pieces]
        return pd.DataFrame(out, columns=["doc_id", "piece", "start_token", "n_tokens", "shard", "bin", "bin_offset"])

    return id_out(dealt.groupBy("shard").applyInPandas(run, schema))
