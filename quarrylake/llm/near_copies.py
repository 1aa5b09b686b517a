"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: texts whose fingerprints differ in two bits at most (bit-sliced comparison, as in
``simhash``) are candidates, an exact check decides them, and the components of those that hold are the
first groups.  A 64-bit SimHash puts the other pairs 3 to 11 bits apart and no radius holds them all, so
candidates between different groups come from MinHash bands: a pair at exactly 0.8 is missed with a
chance of 3e-6, a closer one with less.
Inside a bucket pairs are filtered by the parity bitmaps of their sets, whose distance is never more
than the size of the symmetric difference, so that filter loses nothing.  What passes is joined with
the shingle sets and decided by the exact similarity.  A bucket emits a spanning forest; only where an
edge of a forest fails are further pairs between different groups looked at, a few of each text and
group in a round, and what the round has joined needs no more of them.

Buckets are counted before anything is gathered, and the large ones are dealt in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, gathered, id_in, id_out, thrifty
from .components import connected_components
from .simhash import BLOCK, RADIUS, SEED, _whole_groups, dealt, link_edges, majority

WIDTH = 5
#: Chance of missing a pair of similarity s: (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 32, 5
#: Bits of the map that keeps texts without candidates from being shuffled.
SLOTS = 1 << 23
#: Pairs of a text with one other group that the first round after a failed edge looks at; each further round takes as many times more.
FIRST_PAIRS = 64
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
_SALT = _RANDOM.integers(0, 1 << 64, BANDS, np.uint64)
_LAST = np.uint64(0x9E3779B97F4A7C15)


def rank() -> Column:
    """Order of the rows of a component: the first one stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; one shingle where there are fewer words, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def node_of(found: np.ndarray) -> int:
    """The digest that stands for a shingle set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):
        np.minimum(least, np.multiply.outer(_FACTORS, found[k : k + 512]).min(axis=1), out=least)
    mixed = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(32)) ^ _SALT) * _LAST).view(np.int64)


def parity_bitmap(found: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of hashes end in b; four to eight bits a shingle, 64 at least."""
    width = max(64, 1 << (4 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bucket_links(size: np.ndarray, bits: list[bytes], label: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Pairs of different labels that the bitmaps cannot rule out; a spanning forest of them where ``most`` is 0.

    Otherwise each member has ``most`` pairs with every other label at most; (i, i) tells that it has more.

    ``size`` is sorted, so bitmaps get longer with the index.  Sizes that differ by more than a quarter
    cannot be similar, so a bitmap meets its own length or the double, which folds in half.
    """
    label, m = label.copy(), len(size)
    length = np.fromiter(map(len, bits), np.int64, m)
    upto = np.searchsorted(4 * size, 5 * size, "right")
    tables = {}
    for w in np.unique(length).tolist():
        low, high = np.searchsorted(length, [w, w + 1]).tolist()
        rows = np.frombuffer(b"".join(bits[low:high]), np.uint64).reshape(high - low, w // 8)
        tables[w] = low, high, rows, rows[:, : w // 16] ^ rows[:, w // 16 :] if w > 8 else None
    for i in range(m - 1):
        w = int(length[i])
        low, high, rows, _ = tables[w]
        own = rows[i - low]
        js = i + 1 + np.flatnonzero(label[i + 1 : upto[i]] != label[i])
        if not len(js):
            continue
        same, double = js[js < high], js[js >= high]
        apart = [np.bitwise_count(rows[same - low] ^ own).sum(axis=1, dtype=np.int64)]
        if len(double):
            start, _, _, folded = tables[2 * w]
            apart.append(np.bitwise_count(folded[double - start] ^ own).sum(axis=1, dtype=np.int64))
        js = js[9 * np.concatenate(apart) <= size[i] + size[js]]
        if most:
            order = np.argsort(label[js], kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(label[js][order]) != 0]) if len(js) else order
            count = np.diff(np.r_[first, len(js)])
            nth = np.arange(len(js)) - np.repeat(first, count)
            yield from ((i, j) for j in np.sort(js[order][nth < most]).tolist())
            if (count > most).any():
                yield i, i
        elif len(js):
            labels, first = np.unique(label[js], return_index=True)
            yield from ((i, j) for j in js[first].tolist())
            label[np.isin(label, labels)] = label[i]


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text)
                rows.append((node_of(found), np.array(majority(found), np.uint64).astype(np.int64), len(found), parity_bitmap(found), band_keys(found)))
            node, fp, n, bits, keys = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "node": np.array(node, np.int64), "fp": np.array(fp, np.int64), "n": np.array(n, np.int64), "bits": list(bits), "keys": list(keys)})

    return docs.mapInPandas(thrifty(run), "doc_id long, text_key long, node long, fp long, n long, bits binary, keys array<long>")


def _simhash_pairs(nodes: DataFrame, block: int) -> DataFrame:
    """(src, dst) of nodes whose fingerprints differ in ``RADIUS`` bits at most: a forest, in which the least node stands for a fingerprint."""
    prints = nodes.select("node", "sketch.fp")
    stands = checkpointed(prints.groupBy("fp").agg(F.min("node").alias("of")))
    equal = prints.join(stands, "fp").filter("node <> of").select(F.col("of").alias("src"), F.col("node").alias("dst"))
    edges = link_edges(stands.select("fp"), RADIUS, block).distinct()
    ends = edges.join(stands.select(F.col("fp").alias("src"), F.col("of").alias("a")), "src").join(stands.select(F.col("fp").alias("dst"), F.col("of").alias("b")), "dst")
    return gathered(equal.unionByName(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))))


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) of the buckets with two nodes or more; buckets with equal members become one.

    Members are counted and digested by partial sums, so no bucket is ever gathered.
    """
    keyed = nodes.select(F.explode(F.array_distinct("sketch.keys")).alias("key"), "node")
    mixed = F.xxhash64("node")
    members = F.xxhash64(F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1 << 31))), F.count("*")).alias("members")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), members).filter("n > 1")
    # of the buckets with equal members one is kept, before its nodes are looked up
    one = checkpointed(shared.groupBy("members").agg(F.min("key").alias("key")).select("key"))
    return keyed.join(one, "key", "left_semi")


def _candidates(buckets: DataFrame, most: int) -> DataFrame:
    """(src, dst) over buckets of key, part, node, n, bits, label; equal ones tell that a text has more than ``most``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, BLOCK):
            key, part, node = frame["key"].values, frame["part"].values, frame["node"].values
            size, label, bits = frame["n"].values, frame["label"].values, frame["bits"].tolist()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(key)]
            pairs = [(s + i, s + j) for s, e in zip(cuts, cuts[1:], strict=False) for i, j in bucket_links(size[s:e], bits[s:e], label[s:e], most)]
            if pairs:
                i, j = np.array(pairs).T
                yield pd.DataFrame({"src": np.minimum(node[i], node[j]), "dst": np.maximum(node[i], node[j])})

    found = buckets.repartition("key", "part").sortWithinPartitions("key", "part", "n", "node").mapInPandas(thrifty(run), "src long, dst long")
    return gathered(found.distinct())


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, grams) of the nodes asked for; the texts are read once more, and most of them are kept out of the shuffle."""
    slot = F.pmod("sketch.text_key", F.lit(SLOTS)) + 1
    slots = nodes.join(asked, "node").groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    held = np.zeros(SLOTS // 8, np.uint8)
    for at, bits in slots.collect():  # SLOTS / 8 bytes at most
        held[(at - 1) * 4096 : at * 4096] = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["text_key"].values % SLOTS
            batch = batch[(held[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1]
            sets = [shingles(t) for t in batch["text"]]
            if not sets:
                continue
            yield pd.DataFrame({"node": np.array([node_of(s) for s in sets], np.int64), "grams": [s.view(np.int64) for s in sets]})

    # the slots only keep most texts out of the shuffle; the join decides
    read = docs.select("text_key", "text").mapInPandas(thrifty(run), "node long, grams array<long>")
    return read.join(asked, "node", "left_semi").dropDuplicates(["node"])


def _decided(pairs: DataFrame, known: DataFrame | None, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, near), where near tells whether the exact similarity of the shingle sets is 0.8 or more, and all sets that are known then."""
    asked = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    asked = gathered(asked if known is None else asked.join(known.select("node"), "node", "left_anti"))
    if known is None or not asked.isEmpty():
        more = checkpointed(_sets(asked, nodes, docs))
        known = more if known is None else known.unionByName(more)
    both = pairs.join(known.select(F.col("node").alias("src"), F.col("grams").alias("a")), "src").join(known.select(F.col("node").alias("dst"), F.col("grams").alias("b")), "dst")
    return gathered(both.select("src", "dst", (9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).alias("near"))), known


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 64, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, text_key (xxhash64 of the text), component_id, root, stays.

    Two texts are linked where the Jaccard similarity of their shingle sets is 0.8 or more; texts without
    words have equal, empty sets.  component_id is the least doc_id that links reach; null ids take part
    but name a component only when alone.  ``root`` names the component whether or not it has an id.
    ``stays`` marks the row of a component with the least id, of rows with that id those with one text; a
    null id comes last.  An empty table gives no rows.
    """
    docs = df.select(id_in(id_col), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"))
    rows = checkpointed(id_out(_sketches(docs.select("doc_id", "text", "text_key"))))
    total = rows.count()
    nodes = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(rank()).alias("first"), F.count("*").alias("copies"), F.first(F.struct("text_key", "fp", "n", "bits", "keys")).alias("sketch")))
    buckets = dealt(checkpointed(_shared_buckets(nodes)), "node", block)
    buckets = checkpointed(buckets.join(nodes.select("node", "sketch.n", "sketch.bits"), "node"))
    by_simhash, sets = _decided(_simhash_pairs(nodes, block), None, nodes, docs)
    links = gathered(by_simhash.filter("near"))
    forget(df.sparkSession)
    told = lambda roots: buckets.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    decided, sets = _decided(_candidates(told(connected_components(links)), 0), sets, nodes, docs)
    forget(df.sparkSession)
    roots = connected_components(links.unionByName(decided.filter("near")))
    most = FIRST_PAIRS
    forget(df.sparkSession)
    while not decided.filter("NOT near").isEmpty():  # a failed edge may have stood for pairs that hold
        asked = _candidates(told(roots), most)
        pairs = gathered(asked.filter("src <> dst").join(decided, ["src", "dst"], "left_anti"))
        if not pairs.isEmpty():
            more, sets = _decided(pairs, sets, nodes, docs)
            decided = gathered(decided.unionByName(more))
            forget(df.sparkSession)
        roots = connected_components(links.unionByName(decided.filter("near")))
        if asked.filter("src = dst").isEmpty():
            break
        most *= FIRST_PAIRS
        forget(df.sparkSession)
    owned = nodes.join(roots, "node", "left").select("node", "low", "first", "copies", F.coalesce("root", "node").alias("root"))
    named = owned.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    names = checkpointed(owned.drop("first").join(named, "root"))
    names = names.select("node", "copies", "component_id", "root", "first")
    hot = names.filter(F.col("copies") >= max(2, total / hot_share)).drop("copies")  # hot_share rows at most
    split = rows.select("doc_id", "text_key", "node").join(F.broadcast(hot), "node", "left")
    rest = split.filter("root IS NULL").select("doc_id", "text_key", "node").join(names.drop("copies"), "node")
    columns = ("doc_id", "text_key", "component_id", "root", (rank() == F.col("first")).alias("stays"))
    return split.filter("root IS NOT NULL").select(*columns).unionByName(rest.select(*columns))
