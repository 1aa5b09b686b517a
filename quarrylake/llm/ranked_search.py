"""Ranked lexical search: Block-Max WAND over shards of compressed posting blocks.

The index is one row for each shard, a bounded share of the documents that one task reads.  A shard keeps
its terms, and for each of them its postings in blocks of a fixed number: gaps and occurrences packed at
the least width that holds a block, and beside them, unpacked, the first and last document of the block
and the greatest impact in it.

A query walks the documents of a shard in strides.  The shallow move adds up the greatest impacts of the
blocks that reach over each document: where they stay below the score of the k-th best document so far,
the blocks are passed by without being unpacked.  Of the rest, the terms that are too light to lift a
document over that score by themselves wait: pivots are documents of the other terms, and only blocks
that hold pivots are unpacked for the light ones.  A task takes the k best of one shard to the next, and
the results of the tasks meet in one ranking.

The set of queries is dealt into blocks of bounded text; one block at a time is sent to the shards.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_in, id_out, thrifty

#: Term characters are letters and digits of ASCII and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a block, documents of a stride, bytes and documents of a shard, bytes of a block of queries.
BLOCK, STRIDE, SHARD_BYTES, SHARD_DOCS, QUERY_BYTES = 64, 2048, 8 << 20, 1 << 16, 4 << 20
#: Documents of an answer.
BEST = 50
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Index(NamedTuple):
    """Shards, and over the whole corpus the documents that have a term and the number of terms."""

    shards: DataFrame
    documents: int
    terms: int


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each element is of, and the elements of all ranges after one another."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _width(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


class Shard:
    """The postings of some documents; terms are numbered in the order of ``words``."""

    FIELDS = ("ids", "lengths", "words", "df", "first", "last", "most", "widths", "payload")
    SCHEMA = ", ".join(f"{f} binary" for f in FIELDS)

    def __init__(self, documents: int, terms: int, ids: np.ndarray, lengths: np.ndarray, df: np.ndarray, first: np.ndarray, last: np.ndarray, most: np.ndarray, widths: np.ndarray, payload: np.ndarray):
        self.ids, self.df, self.first, self.last, self.most, self.payload = ids, df, first, last, most, payload
        # long documents count less: 64-bit integers hold the product for any real corpus, Python's hold any
        self.m = np.array([100 - 50 + 50 * n * documents // max(1, terms) for n in lengths.tolist()], np.int64)
        blocks = -(-df // BLOCK)
        self.block_of = np.r_[0, np.cumsum(blocks)]
        of, place = _ranges(np.zeros(len(df), np.int64), blocks)
        self.count = np.minimum(BLOCK, df[of] - place * BLOCK)
        self.gap_width, self.tf_width = widths >> 4, widths & 15
        self.offset = np.cumsum(self.count * (self.gap_width + self.tf_width)) - self.count * (self.gap_width + self.tf_width)

    @staticmethod
    def build(ids: list[int], texts: list[bytes], documents: int, terms: int) -> dict[str, bytes]:
        """The row of a shard."""
        words = [terms_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for own in words for w in own]
        code, known = pd.factorize(flat)
        by_name = np.argsort(known, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[by_name] = np.arange(len(known))
        n = max(1, len(ids))
        key, tf = np.unique(rank[code] * n + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
        term, doc = key // n, key % n
        df = np.bincount(term, minlength=len(known))
        place = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
        at = np.flatnonzero(place % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[at] = 0
        m = np.array([100 - 50 + 50 * k * documents // max(1, terms) for k in lengths.tolist()], np.int64)
        greatest = lambda values: np.maximum.reduceat(values, at) if len(at) else np.zeros(0, np.int64)
        gap_width, tf_width = _width(greatest(gaps)), _width(greatest(tf))
        count = np.diff(np.r_[at, len(term)])
        size = count * (gap_width + tf_width)
        offset = np.cumsum(size) - size
        payload = np.zeros(int(size.sum()), np.uint8)
        of = np.repeat(np.arange(len(at)), count)
        inside = np.arange(len(term)) - at[of] if len(at) else of
        for values, width, start in ((gaps, gap_width, offset), (tf, tf_width, offset + count * gap_width)):
            for byte in range(4):
                pick = np.flatnonzero(width[of] > byte)
                payload[start[of[pick]] + inside[pick] * width[of[pick]] + byte] = (values[pick] >> (8 * byte)) & 255
        columns = {
            "ids": np.array(ids, "<i8"),
            "lengths": lengths.astype("<i8"),
            "df": df.astype("<u4"),
            "first": doc[at].astype("<u4"),
            "last": doc[at + count - 1].astype("<u4"),
            "most": greatest(impacts(tf, m[doc])).astype("<i8"),
            "widths": (gap_width << 4 | tf_width).astype(np.uint8),
            "payload": payload,
        }
        packed = {c: zlib.compress(a.tobytes(), 1) for c, a in columns.items()}
        return packed | {"words": zlib.compress(b" ".join(known[by_name].tolist()), 1)}

    @staticmethod
    def read(row, documents: int, terms: int) -> Shard:
        kinds = {"ids": "<i8", "lengths": "<i8", "df": "<u4", "first": "<u4", "last": "<u4", "most": "<i8", "widths": np.uint8, "payload": np.uint8}
        found = {c: np.frombuffer(zlib.decompress(getattr(row, c)), k) for c, k in kinds.items()}
        wide = {c: a.astype(np.int64) for c, a in found.items() if c != "payload"}
        return Shard(documents, terms, payload=found["payload"], **wide)

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which block, document and impact of every posting of some blocks."""
        count = self.count[blocks]
        of, inside = _ranges(np.zeros(len(blocks), np.int64), count)
        block = blocks[of]

        def values(width: np.ndarray, start: np.ndarray) -> np.ndarray:
            own = width[block]
            at = start[of] + inside * own
            out = self.payload[at].astype(np.int64)
            for byte in range(1, 4):
                pick = np.flatnonzero(own > byte)
                out[pick] |= self.payload[at[pick] + byte].astype(np.int64) << (8 * byte)
            return out

        gaps = values(self.gap_width, self.offset[blocks])
        tf = values(self.tf_width, self.offset[blocks] + count * self.gap_width[blocks])
        run = np.cumsum(gaps)
        begin = np.cumsum(count) - count
        doc = run - run[begin][of] + self.first[block] if len(of) else run
        return of, doc, impacts(tf, self.m[doc])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offers every document that may be among the best to ``best``."""
        term, block = _ranges(self.block_of[terms], self.block_of[terms + 1] - self.block_of[terms])
        weight = weights[term]
        most = weight * self.most[block]
        first, last = self.first[block], self.last[block]
        bound = _cover(first, last, most, len(self.ids))
        for s in range(0, len(self.ids), STRIDE):
            e = min(len(self.ids), s + STRIDE)
            open_ = bound[s:e] >= best.least
            if not open_.any():
                continue
            begin, end = np.maximum(first - s, 0), np.minimum(last + 1 - s, e - s)
            here = np.flatnonzero((first < e) & (last >= s))
            here = here[_any(open_, begin[here], end[here])]
            greatest = np.zeros(len(terms), np.int64)
            np.maximum.at(greatest, term[here], most[here])
            order = np.argsort(greatest, kind="stable")
            light = np.zeros(len(terms), bool)
            light[order[np.cumsum(greatest[order]) < best.least]] = True
            score = np.zeros(e - s, np.int64)

            def add(blocks: np.ndarray, where: np.ndarray, score=score, s=s, e=e) -> None:
                of, doc, impact = self.unpack(block[blocks])
                keep = np.flatnonzero((doc >= s) & (doc < e))
                keep = keep[where[doc[keep] - s]]
                np.add.at(score, doc[keep] - s, weight[blocks][of[keep]] * impact[keep])

            add(here[~light[term[here]]], open_)
            rest = here[light[term[here]]]
            pivots = open_ & (score > 0) & (score + _cover(begin[rest], end[rest] - 1, most[rest], e - s) >= best.least)
            if not pivots.any():
                continue
            add(rest[_any(pivots, begin[rest], end[rest])], pivots)
            found = np.flatnonzero(pivots & (score >= best.least))
            best.offer(score[found], self.ids[s + found])


def _cover(first: np.ndarray, last: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of the intervals that reach over each position."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, value)
    np.subtract.at(steps, last + 1, value)
    return np.cumsum(steps)[:size]


def _any(marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the ranges have a mark."""
    seen = np.r_[0, np.cumsum(marks)]
    return seen[end] > seen[begin]


class Best:
    """The k documents with the highest scores so far, equal scores by id, and the least score that may enter."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index of all documents; a null text has no terms, rows that share an id are documents of their own."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TERM)).cast("long")
    documents, terms = df.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                if ids and (size + len(t) > shard_bytes or len(ids) == SHARD_DOCS):
                    yield pd.DataFrame([Shard.build(ids, texts, documents, terms)])
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(bytes(t))
                size += len(t)
        if ids:
            yield pd.DataFrame([Shard.build(ids, texts, documents, terms)])

    rows = df.filter(F.col(text_col) != "").select(id_in(id_col), F.col(text_col).cast("binary").alias("text"))
    return Index(checkpointed(rows.mapInPandas(thrifty(build), Shard.SCHEMA)), documents, terms)


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = BEST, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item, scores above 0 only.

    A term of an item counts once, and rows of one item_id are one item with the terms of all of them; a
    null item_id is one as well.  An item without a known term has no rows.  Equal scores are in the
    order of doc_id, a null one first.  ``items`` is dealt into blocks of about ``query_bytes`` of text, of
    which one at a time is on the driver.
    """
    spark = items.sparkSession
    asked = items.select(id_in(id_col, "item_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null").distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = -(-total // query_bytes)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        of_block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = found.unionByName(_search_block(index, [(r["item_id"], bytes(r["text"])) for r in of_block], k))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    return id_out(id_out(ranked, "item_id"), "doc_id")


def _search_block(index: Index, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    number: dict[bytes, int] = {}
    wanted: dict[int, set[int]] = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(number.setdefault(t, len(number)) for t in terms_of(text))
    vocabulary = index.shards.sparkSession.sparkContext.broadcast(number)  # the terms of query_bytes of text

    def known(row) -> np.ndarray:
        """Number in the vocabulary of each term of the shard, -1 for others."""
        return np.fromiter(map(vocabulary.value.get, zlib.decompress(row.words).split(b" "), repeat(-1)), np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(number), np.int64)
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = known(row)
                at = np.flatnonzero(own >= 0)
                df[own[at]] += np.frombuffer(zlib.decompress(row.df), "<u4")[at]
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    counted = index.shards.select("words", "df").mapInPandas(thrifty(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    n = index.documents
    weight = np.zeros(len(number), np.int64)
    for r in counted:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    queries = [(item, np.array(sorted(t for t in own if weight[t] > 0), np.int64)) for item, own in wanted.items()]
    sent = index.shards.sparkSession.sparkContext.broadcast((queries, weight))
    documents, terms = index.documents, index.terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, weight = sent.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard, own = Shard.read(row, documents, terms), known(row)
                place = np.full(len(weight), -1)
                at = np.flatnonzero(own >= 0)
                place[own[at]] = at
                for (_, asked), top in zip(queries, best, strict=True):
                    here = asked[place[asked] >= 0]
                    if len(here):
                        shard.search(place[here], weight[here], top)
        for (item, _), top in zip(queries, best, strict=True):
            if len(top.ids):
                yield pd.DataFrame({"item_id": item, "doc_id": top.ids, "score": top.scores})

    return index.shards.mapInPandas(thrifty(run), "item_id long, doc_id long, score long")
