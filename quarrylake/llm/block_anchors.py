"""Removal of word passages that occur earlier, found by fixed blocks and rolling probes.

Every run of ``window`` words holds a whole block of ``window // 2`` words that starts at a multiple of
that length in its document.  So all documents are cut into such blocks, which do not overlap: these
are the reference blocks, a tenth as many as words.  All are then probed with every rolling window of a
block's length.  A probe that meets a reference block elsewhere is a hit, and is extended on both sides
by whole windows: each of the windows that hold the block is looked up under a digest of its words, and
what adjoins is one maximal repeat.

Three passes over the documents, which are dealt into batches of bounded text:

1. a batch sends its probes, 32 bits each, to buckets of the index, with a mark at reference blocks; a
   bucket answers which of them are hits.  Few bits lose nothing: a chance hit is only extended;
2. a batch sends the digests (96 bits) of the windows around its hits, each once and with the least
   document that has it; a bucket answers with the least document of all batches where that is earlier;
3. a batch applies the answers, and what its own documents repeat themselves, to its documents.

A batch sends a probe or a window once, however often it has it, so what a third of all documents share
costs one entry for each batch, and nobody ever holds the occurrences of one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out, shuffle_width
from .suffix_dedup import sparing

WINDOW = 20
#: Bytes of text in a batch.
BATCH = 8 << 20
#: Batches of one task at most, on average.
TASK_BATCHES = 4
#: Fixed values of the hashes: how two neighbouring runs are combined, by lane.
LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _combined(left: np.ndarray, right: np.ndarray, lane: int) -> np.ndarray:
    a, b = (np.uint64(x) for x in LANES[lane])
    x = left * a + (right ^ (right >> np.uint64(31))) * b
    x ^= x >> np.uint64(29)
    x *= a
    x ^= x >> np.uint64(32)
    return x


def _runs(words: np.ndarray, length: int, lane: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; shorter than ``words`` by length - 1."""
    if length == 1:
        return words
    half = 1 << (length.bit_length() - 1)
    if half == length:
        part = _runs(words, length // 2, lane)
        return _combined(part[: len(part) - length // 2], part[length // 2 :], lane)
    part = _runs(words, half, lane)
    return _combined(part[: len(words) - length + 1], part[length - half :], lane)


class Passages:
    """The words of some documents: hash of each, and for each document where they begin."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.window, self.block = window, max(1, window // 2)
        words = [t.split() for t in texts]  # bytes split at 0x20 and 0x09 to 0x0D
        self.n_words = np.array([len(w) for w in words], np.int64)
        long = [d for d, w in enumerate(words) if len(w) >= window]
        self.doc = np.array(long, np.int64)
        sizes = self.n_words[self.doc]
        self.begin = np.cumsum(sizes) - sizes
        flat = np.array([w for d in long for w in words[d]], object)
        self.hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
        self.sizes = sizes

    def _starts(self, length: int) -> np.ndarray:
        """Positions from which ``length`` words of one document follow."""
        ok = np.ones(len(self.hashes), bool)
        for back in range(1, length):
            ok[self.begin + self.sizes - back] = False
        return np.flatnonzero(ok)

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the rolling probes, their hashes, and which are reference blocks."""
        at = self._starts(self.block)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, bool)
        offset = at - self.begin[self.document_of(at)]
        return at, _runs(self.hashes, self.block, 0)[at], offset % self.block == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all windows and the two parts of their digests, 64 and 32 bits."""
        at = self._starts(self.window)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return at, _runs(self.hashes, self.window, 0)[at], (_runs(self.hashes, self.window, 1)[at] >> np.uint64(32)).astype(np.uint32)


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers byte by byte, all lowest bytes first, so that high bytes that are alike take no room; rising ones as steps."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unpacked(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, the first of which counts most, and where in it a new group begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted buckets."""
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
    for s, e in zip(edges, edges[1:], strict=False):
        yield int(bucket[s]), int(s), int(e)


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batch_bytes: int = BATCH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (array of start, end in words) and kept (binary).

    Words are runs of other bytes than 0x20 and 0x09 to 0x0D, unchanged; kept words are joined by one
    space.  A word goes if one of the windows that cover it also starts in a document with a smaller id, or
    earlier in its own.  A null text has no words; a null id sorts below every other id, and rows that share
    an id take nothing from each other; texts of less than ``window`` words lose nothing.  Windows are
    equal when their 96-bit digests are.  An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    batches = max(1, -(-total // batch_bytes))
    width = max(shuffle_width(spark), batches // TASK_BATCHES)
    # dealt by the partition as well, so that equal rows repeated without bound are not one batch
    texts = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches))).repartition(width, "batch").groupBy("batch")

    def load(left: pd.DataFrame) -> tuple[np.ndarray, list[bytes], Passages]:
        left = left.sort_values("doc_id", kind="stable")
        own = [bytes(t) for t in left["text"]]
        return left["doc_id"].to_numpy(np.int64), own, Passages(own, window)

    def bucketed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and the 32 bits that stand for a probe in it."""
        return (hashes % np.uint64(batches)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.uint32)

    def send_probes(left: pd.DataFrame) -> pd.DataFrame:
        rows = []
        _, _, p = load(left)
        _, hashes, is_block = p.probes()
        bucket, short = bucketed(hashes)
        order, new = _grouped(bucket, short)
        first = np.flatnonzero(new)
        several = np.diff(np.r_[first, len(order)]) > 1
        block = np.logical_or.reduceat(is_block[order], first) if len(first) else np.zeros(0, bool)
        for b, s, e in _slices(bucket[order[first]]):
            rows.append((b, int(left["batch"].iloc[0]), _packed(short[order[first[s:e]]], rising=True), np.packbits(block[s:e]).tobytes(), np.packbits(several[s:e]).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "batch", "probes", "blocks", "several"])

    def find_hits(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(raw, np.uint32, rising=True) for raw in group["probes"]]
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(raw, np.uint8), count=len(p)) for raw, p in zip(group[c], parts, strict=True)]) > 0
        flat, block, several = np.concatenate(parts), bits("blocks"), bits("several")
        order, new = _grouped(flat)
        first = np.flatnonzero(new)
        hit = np.logical_or.reduceat(block[order], first) & (np.logical_or.reduceat(several[order], first) | (np.diff(np.r_[first, len(flat)]) > 1))
        marks = np.empty(len(flat), bool)
        marks[order] = np.repeat(hit, np.diff(np.r_[first, len(flat)]))
        rows, s = [], 0
        for batch, p in zip(group["batch"].tolist(), parts, strict=True):
            own = p[marks[s : s + len(p)]]
            s += len(p)
            if len(own):
                rows.append((batch, int(group["bucket"].iloc[0]), _packed(own, rising=True)))
        return pd.DataFrame(rows, columns=["batch", "bucket", "payload"])

    def send_windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            ids, _, p = load(left)
            at, hashes, _ = p.probes()
            bucket, short = bucketed(hashes)
            key = (bucket.astype(np.uint64) << np.uint64(32)) | short
            hits = np.concatenate([_unpacked(raw, np.uint32, rising=True).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, raw in zip(right["bucket"], right["payload"], strict=True)])
            hit = np.zeros(len(p.hashes) + 1, np.int64)
            hit[at[np.isin(key, hits)] + 1] = 1
            seen = np.cumsum(hit)
            starts, high, low = p.windows()
            # a window holds the blocks that start in its first words; the last one that a reference can have ends with it at most
            near = seen[starts + p.block] > seen[starts]
            starts, high, low = starts[near], high[near], low[near]
            own = ids[p.doc[p.document_of(starts)]] if len(starts) else np.zeros(0, np.int64)
            bucket = (high % np.uint64(batches)).astype(np.int64)
            order, new = _grouped(bucket, high, low)  # stable, so the least id of a group comes first
            first = order[new]
            for b, s, e in _slices(bucket[first]):
                at = first[s:e]
                rows.append((b, int(left["batch"].iloc[0]), _packed(high[at], rising=True), _packed(low[at]), _packed(own[at])))
        return pd.DataFrame(rows, columns=["bucket", "batch", "high", "low", "least"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        high = np.concatenate([_unpacked(raw, np.uint64, rising=True) for raw in group["high"]])
        low = np.concatenate([_unpacked(raw, np.uint32) for raw in group["low"]])
        parts = [_unpacked(raw, np.int64) for raw in group["least"]]
        own = np.concatenate(parts)
        order, new = _grouped(high, low)
        first = np.flatnonzero(new)
        least = np.empty(len(own), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.r_[first, len(own)]))
        rows, s = [], 0
        for batch, p in zip(group["batch"].tolist(), parts, strict=True):
            e = s + len(p)
            at = s + np.flatnonzero(least[s:e] < own[s:e])
            s = e
            if len(at):
                rows.append((batch, _packed(high[at], rising=True), _packed(low[at]), _packed(least[at])))
        return pd.DataFrame(rows, columns=["batch", "high", "low", "least"])

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["doc_id", "n_words", "n_removed", "spans", "kept"])
        ids, own, p = load(left)
        at, high, low = p.windows()
        doc = p.document_of(at) if len(at) else np.zeros(0, np.int64)
        of = ids[p.doc[doc]] if len(at) else np.zeros(0, np.int64)
        told = lambda c, kind, rising=False: np.concatenate([np.zeros(0, kind), *(_unpacked(raw, kind, rising) for raw in right[c])])
        told_high, told_low, told_least = told("high", np.uint64, True), told("low", np.uint32), told("least", np.int64)
        order, new = _grouped(np.r_[high, told_high], np.r_[low, told_low])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, group, np.r_[of, told_least])
        gone = least[group[: len(at)]] < of
        by, other = _grouped(doc, group[: len(at)])  # a document's own repeats: all but the first of each
        gone[by[~other]] = True
        start, doc = at[gone], doc[gone]
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(start):
            begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)])
            last = np.r_[begins[1:], len(start)] - 1
            base = p.begin[doc[begins]]
            for x, a, b in zip(p.doc[doc[begins]].tolist(), (start[begins] - base).tolist(), (start[last] + window - base).tolist(), strict=True):
                spans.setdefault(x, []).append((a, b))
        rows = []
        for x, t in enumerate(own):
            words, cut = t.split(), spans.get(x, [])
            kept = [w for s, e in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(words)], strict=True) for w in words[s:e]] if cut else words
            rows.append((int(ids[x]), len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in cut], b" ".join(kept)))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept"])

    sent = texts.applyInPandas(sparing(send_probes), "bucket long, batch long, probes binary, blocks binary, several binary")
    hits = sent.repartition(width, "bucket").groupBy("bucket").applyInPandas(sparing(find_hits), "batch long, bucket long, payload binary")
    met = texts.cogroup(hits.repartition(width, "batch").groupBy("batch")).applyInPandas(sparing(send_windows), "bucket long, batch long, high binary, low binary, least binary")
    answers = met.repartition(width, "bucket").groupBy("bucket").applyInPandas(sparing(answer), "batch long, high binary, low binary, least binary")
    out = texts.cogroup(answers.repartition(width, "batch").groupBy("batch")).applyInPandas(sparing(apply), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return id_out(out)
