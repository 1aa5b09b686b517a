"""Removal of byte passages that an earlier document already has.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id is
removed.  The strings of a document are dealt by their anchor, the least hash of the k-grams inside
them, so equal strings meet under one anchor; neighbouring strings with one anchor travel as a single
context.  Three passes over the documents, all keyed by the same batches:

1. anchors of a batch are compared with those of all others; each batch learns which are shared;
2. contexts of shared anchors, one of each kind per batch, meet under their anchor.  There a
   Burrows-Wheeler transform of the differing contexts is expanded breadth first, by backward
   extension; boundaries between neighbouring suffixes appear by increasing length of their common
   prefix, and the expansion stops at ``length``.  What is then still undivided are the equal strings,
   and each gets the least id of a document that has it;
3. each batch applies the answers to its own documents.

A batch sends one entry for each kind, so a passage that a third of all documents share costs one
entry per batch.  An anchor with very many contexts, such as a common line in ever new
surroundings, would gather all of them in one place: its strings travel one by one under their own
hashes instead.  Exact copies of an earlier document skip all this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, give_back, id_in, id_out, shuffle_width

LENGTH, GRAM = 50, 26
#: Bytes of text in a batch, of the contexts in one transform, and of a chunk that is hashed at once.
BATCH, TRANSFORM, CHUNK = 8 << 20, 1 << 20, 48 << 10
#: Groups of copies that hold 1/HOT_SHARE of the rows are found on the map side.
HOT_SHARE = 256
#: Batches of one task at most, on average.
TASK_BATCHES = 4
#: An anchor is hot from so many contexts on, counted once in each batch: its strings are dealt one by one.
HOT_CONTEXTS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random 64-bit value of each byte, powers of an odd base and of its inverse modulo 2**64."""
    values = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0xD6E8FEB86659FD93
    size = 1 << 16
    up, down = [1], [1]
    back = pow(base, -1, 1 << 64)
    for _ in range(size):
        up.append(up[-1] * base & 0xFFFFFFFFFFFFFFFF)
        down.append(down[-1] * back & 0xFFFFFFFFFFFFFFFF)
    return values, np.array(up, np.uint64), np.array(down, np.uint64)


VALUES, UP, DOWN = _tables()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Contexts:
    """Contexts of some documents: doc (index), start, strings (how many), anchor and digest."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.texts, self.length = texts, length
        parts: list[tuple] = []
        held: list[tuple[int, int, int]] = []
        size = 0
        for d, t in enumerate(texts):
            if len(t) < length:
                continue
            for s in range(0, len(t) - length + 1, CHUNK):
                e = min(len(t), s + CHUNK + length - 1)
                if size + e - s > CHUNK + length - 1 and held:
                    parts.append(self._chunk(held, gram))
                    held, size = [], 0
                held.append((d, s, e))
                size += e - s
        if held:
            parts.append(self._chunk(held, gram))
        kinds = (np.int32, np.int64, np.int32, np.uint64, np.uint64)
        self.doc, self.start, self.strings, self.anchor, self.digest = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k in range(5))

    def _chunk(self, held: list[tuple[int, int, int]], gram: int) -> tuple:
        length = self.length
        data = np.frombuffer(b"".join([self.texts[d][s:e] for d, s, e in held]), np.uint8)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * UP[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * DOWN[: n - gram + 1])
        least = _sliding_min((grams & ~np.uint64(0xFFFF)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        sizes = np.array([e - s for _, s, e in held])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        valid = np.ones(len(least), bool)
        for e in ends[:-1].tolist():  # no string goes over the end of a document
            valid[e - length + 1 : e] = False
        at = np.flatnonzero(valid)
        own = least[at]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        strings = np.diff(np.r_[first, len(at)])
        start = at[first]
        piece = np.searchsorted(ends, start, side="right")
        docs, offsets = np.array([d for d, _, _ in held]), np.array([s for _, s, _ in held])
        end = start + strings + length - 1
        digest = _mix(_mix((sums[end] - sums[start]) * DOWN[start]) + strings.astype(np.uint64) * _ODD)
        return docs[piece].astype(np.int32), start - begins[piece] + offsets[piece], strings.astype(np.int32), own[first] >> np.uint64(16), digest

    def split_hot(self, hot: np.ndarray) -> np.ndarray:
        """Contexts whose anchor is in ``hot`` (sorted) become one context for each string, anchored by its digest; returns those anchors."""
        at = np.searchsorted(hot, self.anchor)
        pick = np.flatnonzero(hot[np.minimum(at, len(hot) - 1)] == self.anchor) if len(hot) else np.zeros(0, np.int64)
        if not len(pick):
            return np.zeros(0, np.uint64)
        strings = self.strings[pick].astype(np.int64)
        edges, digests = np.cumsum(strings + self.length - 1), []
        first = 0
        while first < len(pick):  # as many contexts as the tables of powers reach
            last = max(first + 1, int(np.searchsorted(edges, (edges[first - 1] if first else 0) + CHUNK, "right")))
            part = pick[first:last].tolist()
            data = np.frombuffer(b"".join(map(self.text, part)), np.uint8)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(VALUES[data] * UP[: len(data)], out=sums[1:])
            size = self.strings[part].astype(np.int64)
            begin = np.cumsum(size + self.length - 1) - size - self.length + 1
            s = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            digests.append(_mix(_mix((sums[s + self.length] - sums[s]) * DOWN[s]) + _ODD))
            first = last
        own = np.concatenate(digests)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(strings) - strings, strings)
        rest = np.ones(len(self.doc), bool)
        rest[pick] = False
        doc = np.concatenate([self.doc[rest], np.repeat(self.doc[pick], strings)])
        start = np.concatenate([self.start[rest], np.repeat(self.start[pick], strings) + offset])
        count = np.concatenate([self.strings[rest], np.ones(len(own), self.strings.dtype)])
        anchor, digest = np.concatenate([self.anchor[rest], own >> np.uint64(16)]), np.concatenate([self.digest[rest], own])
        order = np.lexsort((start, doc))
        self.doc, self.start, self.strings, self.anchor, self.digest = doc[order], start[order], count[order], anchor[order], digest[order]
        return np.unique(own >> np.uint64(16))

    def text(self, i: int) -> bytes:
        s = int(self.start[i])
        return self.texts[self.doc[i]][s : s + int(self.strings[i]) + self.length - 1]


def bounded_suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions ordered by their first ``length`` symbols at least; text is positive but for a closing 0."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    reach = 7
    while True:
        order = np.argsort(key, kind="stable")
        if reach >= length:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        later = np.zeros(n, np.int64)
        later[: max(0, n - reach)] = rank[reach:]
        key = rank * (n + 1) + later
        reach *= 2


def equal_strings(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Class of each position: two positions share one iff the ``length`` symbols from there agree.

    Intervals of the suffix order stand for the strings whose suffixes they hold.  Backward extension
    of an interval by each symbol before its members gives the intervals of strings one symbol longer.
    An interval whose right boundary is new sets it and is expanded in the next round; after ``length``
    rounds all boundaries with a shorter common prefix are set.
    """
    data = np.r_[np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0]
    n = len(data)
    order = bounded_suffix_order(data, length + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = data[order - 1]  # the transform; before the first position stands the closing symbol
    back = place[order - 1]
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = high - low
        of = np.repeat(np.arange(len(low)), sizes)
        member = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        key = of * 257 + before[member]
        by = np.argsort(key, kind="stable")
        key, to = key[by], back[member[by]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        new = ~boundary[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        boundary[high] = True
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(boundary[:n])
    return out[:-1]


def least_owners(contexts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the least owner of every string in it, over all contexts given."""
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    of = np.repeat(np.arange(len(contexts)), strings)
    at = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings) + begins[of]
    kind = equal_strings(b"".join(contexts), length)[at]
    least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owner[of])
    return np.split(least[kind], np.cumsum(strings)[:-1])


def resolve(texts: list[bytes], anchors: np.ndarray, owner: np.ndarray, length: int = LENGTH, transform: int = TRANSFORM) -> list[np.ndarray]:
    """least_owners within each anchor; whole anchors share a transform up to its size.

    An anchor with more text than a transform holds is dealt by its strings' hash instead, so that
    equal strings still meet.
    """
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    order = np.argsort(anchors, kind="stable")
    edges = np.flatnonzero(np.r_[True, anchors[order][1:] != anchors[order][:-1], True])
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, least in zip(held, least_owners([texts[i] for i in held], owner[held], length), strict=True):
            out[i] = least
        held.clear()

    for s, e in zip(edges, edges[1:], strict=False):
        own = order[s:e].tolist()
        if len(own) == 1:
            out[own[0]] = np.full(len(texts[own[0]]) - length + 1, owner[own[0]])
            continue
        total = sum(len(texts[i]) for i in own)
        if total > 4 * transform:
            parts = -(-total * length // (4 * transform * 8))
            pieces: list[list[tuple[int, int]]] = [[] for _ in range(parts)]
            for i in own:
                out[i] = np.full(len(texts[i]) - length + 1, owner[i])
                for j in range(len(texts[i]) - length + 1):
                    pieces[hash(texts[i][j : j + length]) % parts].append((i, j))
            for part in pieces:
                if part:
                    for (i, j), least in zip(part, least_owners([texts[i][j : j + length] for i, j in part], owner[[i for i, _ in part]], length), strict=True):
                        out[i][j] = least[0]
            continue
        if size + total > transform and held:
            flush()
            size = 0
        held += own
        size += total
    if held:
        flush()
    return out


def inside_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that holds whole characters of UTF-8 only."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def sparing(work: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """A function for applyInPandas that gives its memory back after each group."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = work(group)
        give_back(cycles=False)
        return out

    def two(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = work(left, right)
        give_back(cycles=False)
        return out

    return one if work.__code__.co_argcount == 1 else two


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH, keep: tuple[str, ...] = (), hot_contexts: int = HOT_CONTEXTS, whole_characters: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary), ``keep`` as strings.

    Null text counts as empty.  A null id sorts below every other id; rows with the same id remove
    nothing from each other, and texts shorter than ``length`` bytes lose nothing.  Strings are judged
    on the input and never go over the end of a document.  With ``whole_characters`` a character that is
    only partly covered stays, so what is kept is valid UTF-8.  An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(id_in(id_col), *[F.col(c).cast("string").alias(f"_{c}") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt_by = F.xxhash64("doc_id", "text").alias("_hash")  # not by the id alone: null and repeated ids are spread too
    facts = checkpointed(docs.select("doc_id", dealt_by, F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    total, rows = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    batches = max(1, -(-total // batch_bytes))
    batch_of = F.pmod("_hash", F.lit(batches))
    width = max(shuffle_width(spark), batches // TASK_BATCHES)
    first = facts.groupBy("sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    hot = checkpointed(first.filter(F.col("n") >= F.lit(max(2, -(-rows // HOT_SHARE)))))  # HOT_SHARE of them at most
    later = lambda df: df.filter("doc_id > low").select(batch_of.alias("batch"), F.lit(0).alias("kind"), F.col("doc_id").alias("number"), F.col("sha").alias("payload"))
    of_hot = later(facts.join(F.broadcast(hot), "sha"))
    of_rest = later(facts.join(F.broadcast(hot), "sha", "left_anti").join(first.join(F.broadcast(hot), "sha", "left_anti"), "sha"))
    copies = checkpointed(of_hot.unionByName(of_rest))
    dealt = docs.withColumn("_hash", dealt_by).select(batch_of.alias("batch"), *docs.columns).repartition(width, "batch")

    def load(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Ids, texts and which of them are copies; sorted by id."""
        left = left.sort_values("doc_id", kind="stable")
        ids, texts = left["doc_id"].to_numpy(np.int64), [t.encode("utf-8", "replace") for t in left["text"]]
        known = right[right["kind"] == 0]
        copied: dict[int, set] = {}
        for i, sha in zip(known["number"].tolist(), known["payload"], strict=True):
            copied.setdefault(i, set()).add(bytes(sha))
        is_copy = np.array([i in copied and hashlib.sha256(t).digest() in copied[i] for i, t in zip(ids.tolist(), texts, strict=True)], bool)
        return ids, texts, is_copy

    def contexts_of(texts: list[bytes], is_copy: np.ndarray) -> Contexts:
        return Contexts([b"" if c else t for t, c in zip(texts, is_copy.tolist(), strict=True)], length, gram)

    def by_bucket(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (values % np.uint64(batches)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(values) else [0]
        for s, e in zip(edges, edges[1:], strict=False):
            yield int(bucket[order[s]]), order[s:e]

    def send_anchors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            ids, texts, is_copy = load(left, right)
            c = contexts_of(texts, is_copy)
            order = np.lexsort((ids[c.doc], c.anchor))
            anchors, docs_of = c.anchor[order], ids[c.doc[order]]
            new = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.zeros(0, np.int64)
            last = np.r_[new[1:], len(anchors)] - 1 if len(new) else new
            several = docs_of[new] != docs_of[last]
            kinds = anchors[new]
            kind = np.repeat(np.arange(len(new)), last - new + 1)
            kind, digest = kind[several[kind]], c.digest[order][several[kind]]
            by = np.lexsort((digest, kind))
            other = np.r_[True, (np.diff(kind[by]) != 0) | (digest[by][1:] != digest[by][:-1])][: len(by)]
            contexts = np.bincount(kind[by][other], minlength=len(new)).astype("<i4")
            for bucket, at in by_bucket(kinds):
                raw = kinds[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                rows.append((bucket, int(left["batch"].iloc[0]), raw, np.packbits(several[at]).tobytes(), contexts[at[several[at]]].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "batch", "anchors", "several", "contexts"])

    def find_shared(group: pd.DataFrame) -> pd.DataFrame:
        def wide(raw: bytes) -> np.ndarray:
            out = np.zeros((len(raw) // 6, 8), np.uint8)
            out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            return out.view("<u8").ravel()

        parts = [wide(raw) for raw in group["anchors"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(p)) for f, p in zip(group["several"], parts, strict=True)])
        _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        contexts = np.ones(len(several))
        contexts[several > 0] = np.frombuffer(b"".join(group["contexts"]), "<i4")
        shared, many = count > 1, np.bincount(inverse, contexts) >= hot_contexts
        shared[inverse[several > 0]] = True
        rows, s = [], 0
        for batch, p in zip(group["batch"].tolist(), parts, strict=True):
            own = inverse[s : s + len(p)]
            bits = shared[own]
            s += len(p)
            if bits.any():
                rows.append((batch, 1, int(group["bucket"].iloc[0]), np.packbits(bits).tobytes()))
            if (hot := p[many[own]]).size:
                rows.append((batch, 3, 0, hot.tobytes()))
        return pd.DataFrame(rows, columns=["batch", "kind", "number", "payload"])

    def send_contexts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        marks = {int(b): p for b, k, p in zip(right["number"], right["kind"], right["payload"], strict=True) if k == 1}
        if len(left) and marks:
            ids, texts, is_copy = load(left, right)
            c = contexts_of(texts, is_copy)
            hot = hot_anchors(right)
            kinds = np.unique(c.anchor)
            shared = np.zeros(len(kinds), bool)
            for bucket, at in by_bucket(kinds):
                if bucket in marks:
                    shared[at] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=len(at)) > 0
            if len(hot):
                batch = int(left["batch"].iloc[0])
                rows.append((-1 - batch, batch, hot.tobytes(), b"", b"", b"", b"", b""))
                known = np.union1d(kinds[shared & ~np.isin(kinds, hot)], c.split_hot(hot))
                kinds = np.unique(c.anchor)
                shared = np.isin(kinds, known)
            at = np.flatnonzero(shared[np.searchsorted(kinds, c.anchor)])
            digests, first, inverse = np.unique(c.digest[at], return_index=True, return_inverse=True)
            high = np.full(len(digests), NO_ID)
            np.maximum.at(high, inverse, ids[c.doc[at]])
            low = ids[c.doc[at[first]]]  # documents are in the order of their ids
            for bucket, pick in by_bucket(c.anchor[at[first]]):
                own = at[first[pick]]
                strings = b"".join([c.text(i) for i in own.tolist()])
                rows.append((bucket, int(left["batch"].iloc[0]), c.anchor[own].tobytes(), digests[pick].tobytes(), low[pick].tobytes(), high[pick].tobytes(), c.strings[own].astype("<i4").tobytes(), strings))
        return pd.DataFrame(rows, columns=["bucket", "batch", "anchors", "digests", "low", "high", "counts", "strings"])

    def hot_anchors(right: pd.DataFrame) -> np.ndarray:
        found = [np.frombuffer(p, np.uint64) for k, p in zip(right["kind"], right["payload"], strict=True) if k == 3]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:  # a batch's note to itself on its hot anchors
            return pd.DataFrame([(b, 3, 0, raw) for b, raw in zip(group["batch"].tolist(), group["anchors"], strict=True)], columns=["batch", "kind", "number", "payload"])
        number: dict[bytes, int] = {}
        anchor_of: list[int] = []
        owner: list[int] = []
        entries = []
        for row in group.itertuples(index=False):
            counts = np.frombuffer(row.counts, "<i4")
            ends = np.cumsum(counts + length - 1).tolist()
            index = np.empty(len(counts), np.int64)
            anchors, low = np.frombuffer(row.anchors, np.uint64).tolist(), np.frombuffer(row.low, np.int64)
            for k, (s, e, least) in enumerate(zip([0, *ends], ends, low.tolist(), strict=False)):
                text = row.strings[s:e]
                i = number.setdefault(text, len(owner))
                if i == len(owner):
                    anchor_of.append(anchors[k])
                    owner.append(least)
                elif least < owner[i]:
                    owner[i] = least
                index[k] = i
            entries.append((row.batch, index, np.frombuffer(row.digests, np.uint64), np.frombuffer(row.high, np.int64)))
        found = resolve(list(number), np.array(anchor_of, np.uint64), np.array(owner, np.int64), length)
        lowest = np.array([f.min() for f in found])
        flat = [f[:1] if (f == f[0]).all() else f for f in found]
        rows = []
        for batch, index, digests, high in entries:
            hit = np.flatnonzero(lowest[index] < high)
            if len(hit):
                owners = [flat[i] for i in index[hit].tolist()]
                sizes = np.array([len(o) for o in owners], "<i4")
                rows.append((batch, 2, len(hit), digests[hit].tobytes() + sizes.tobytes() + np.concatenate(owners).astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["batch", "kind", "number", "payload"])

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["doc_id", "n_bytes", "n_removed", "spans", "kept", *keep])
        ids, texts, is_copy = load(left, right)
        left = left.sort_values("doc_id", kind="stable")  # as load() does
        digests, sizes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, n, raw in zip(right["kind"], right["number"], right["payload"], strict=True):
            if k == 2:
                digests.append(np.frombuffer(raw, np.uint64, n))
                sizes.append(np.frombuffer(raw, "<i4", n, 8 * n).astype(np.int64))
                owners.append(np.frombuffer(raw, "<i8", -1, 12 * n))
        digest, size, owner = np.concatenate(digests), np.concatenate(sizes), np.concatenate(owners)
        order = np.argsort(digest, kind="stable")
        begin = np.cumsum(size) - size
        removed: dict[int, list[tuple[int, int]]] = {}
        if len(digest):
            c = contexts_of(texts, is_copy)
            c.split_hot(hot_anchors(right))
            at = np.minimum(np.searchsorted(digest, c.digest, sorter=order), len(order) - 1)
            hit = np.flatnonzero(digest[order[at]] == c.digest)
            entry = order[at[hit]]
            doc, start, strings = c.doc[hit], c.start[hit], c.strings[hit].astype(np.int64)
            of = np.repeat(np.arange(len(hit)), strings)
            j = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
            least = owner[begin[entry[of]] + np.where(size[entry[of]] == 1, 0, j)]
            gone = ids[doc[of]] > least
            of, j = of[gone], j[gone]
            d, s = doc[of].astype(np.int64), start[of] + j
            if len(d):  # strings come in order of document and start; runs whose strings touch are one span
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)])
                last = np.r_[new[1:], len(d)] - 1
                for x, a, b in zip(d[new].tolist(), s[new].tolist(), (s[last] + length).tolist(), strict=True):
                    removed.setdefault(x, []).append((a, b))
        rows = []
        for x, t in enumerate(texts):
            spans = [(0, len(t))] if is_copy[x] and len(t) >= length else removed.get(x, [])
            if whole_characters:
                spans = [(a, b) for a, b in (inside_characters(t, *span) for span in spans) if a < b]
            kept = t if not spans else b"".join([t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True)])
            rows.append((int(ids[x]), len(t), len(t) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"]).assign(**{c: left[f"_{c}"].to_numpy() for c in keep})

    side = "batch long, kind int, number long, payload binary"
    with_copies = lambda more: copies.unionByName(more).repartition(width, "batch").groupBy("batch")
    texts = dealt.groupBy("batch")
    sent = texts.cogroup(copies.repartition(width, "batch").groupBy("batch")).applyInPandas(sparing(send_anchors), "bucket long, batch long, anchors binary, several binary, contexts binary")
    shared = sent.repartition(width, "bucket").groupBy("bucket").applyInPandas(sparing(find_shared), side)
    columns = "bucket long, batch long, anchors binary, digests binary, low binary, high binary, counts binary, strings binary"
    met = texts.cogroup(with_copies(shared)).applyInPandas(sparing(send_contexts), columns)
    answers = met.repartition(width, "bucket").groupBy("bucket").applyInPandas(sparing(answer), side)
    out = texts.cogroup(with_copies(answers)).applyInPandas(sparing(apply), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary" + "".join(f", `{c}` string" for c in keep))
    return id_out(out)
