"""SimHash near-duplicates with bit-sliced distance comparison.

Fingerprints are majority votes over the XXH64 of word shingles.  Distinct fingerprints are dealt to
buckets: 64 bits are cut into four blocks, and two fingerprints that differ in at most two bits agree
on two of the blocks, so every link is inside one of six bucket tables.  Inside a bucket the bits are
kept as vertical planes (one big integer per bit position, one lane per fingerprint); all pairs at a
given distance in the bucket's order are compared at once with carry-save counters, and a round is
abandoned once every lane is over the radius.  A bucket emits a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_in, id_out, thrifty
from .components import connected_components

SEED = 42
RADIUS = 2
#: Rows of a bucket that are compared as one block; larger buckets are cut into pairs of chunks.
BLOCK = 16_384
#: Bits between two looks at whether any lane is still alive.
LOOK = 8


def majority(hashes: np.ndarray) -> int:
    """Unsigned SimHash of hashes: a bit is set where it is in over half of them; zero where there is none."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16_384):
        part = np.ascontiguousarray(hashes[k : k + 16_384].astype("<u8")).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * votes > len(hashes)).tolist())


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Unsigned SimHash of one text; zero where there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return majority(hashes)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return id_out(df.select(id_in(id_col), F.col(text_col).alias("text")).mapInPandas(thrifty(run), "doc_id long, fp long"))


def planes_of(values: np.ndarray) -> list[int]:
    """Bit plane b has lane i set when bit b of values[i] is set."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def lanes_of(mask: int, lanes: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((lanes + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=lanes))


def bit_sliced_links(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of the same group whose values differ in at most ``radius`` (0 to 2) bits.

    ``groups`` is sorted.  Round s compares lane i with lane i + s; two counter planes and one overflow
    plane hold all distances of the round.
    """
    n = len(values)
    if n < 2:
        return
    planes = planes_of(values)
    same = int.from_bytes(np.packbits(groups[1:] == groups[:-1], bitorder="little").tobytes(), "little")
    near = same
    for s in range(1, n):
        if s > 1:
            near &= same >> (s - 1)
        if not near:
            return
        ones = twos = over = 0
        alive = near
        for b, plane in enumerate(planes):
            differ = (plane ^ (plane >> s)) & near
            carry = ones & differ
            ones ^= differ
            over |= carry & twos
            twos ^= carry
            if b % LOOK == LOOK - 1:
                beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
                alive = near & ~beyond
                if not alive:
                    break
        if alive:
            i = lanes_of(alive, n - s)
            yield i, i + s


def forest(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) values of a spanning forest of the links; the root is the least index of a tree."""
    up = np.arange(len(values))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in bit_sliced_links(values, groups, radius):
        apart = up[i] != up[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    for x in range(len(up)):
        up[x] = up[up[x]]
    moved = np.flatnonzero(up != np.arange(len(up)))
    return values[moved], values[up[moved]]


def _whole_groups(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Regroups key-sorted batches so that no key is spread over two frames."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= block:
            both = pd.concat(held, ignore_index=True)
            last = (both["key"].values == both["key"].values[-1]) & (both["part"].values == both["part"].values[-1])
            if last.all():
                held = [both]
                continue
            yield both[~last]
            held, rows = [both[last]], int(last.sum())
    if held:
        yield pd.concat(held, ignore_index=True)


def dealt(keyed: DataFrame, item: str, block: int) -> DataFrame:
    """(key, part, item): a bucket of more than ``block`` rows is cut so that every pair of its chunks is one part."""
    large = keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / (block // 2)).cast("int").alias("chunks"))
    large = checkpointed(large)
    if large.isEmpty():
        return keyed.select("key", F.lit(0).alias("part"), item)
    # a large bucket: every pair of its chunks is one block
    chunk = F.pmod(F.xxhash64(item), F.col("chunks")).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
    return keyed.join(large, "key", "left").select("key", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(mates)).alias("part"), item)


PAIRS = tuple(combinations(range(4), 2))


def _bits(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def refined(keyed: DataFrame, block: int) -> DataFrame:
    """(key, fp): a bucket of more than ``block`` fingerprints becomes 36 tables of smaller ones.

    Its members agree on two blocks of 16 bits, so what differs is in the other two.  Each of those is cut
    in four, and fingerprints that differ in two bits at most agree on two quarters of either.
    """
    large = checkpointed(keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.lit(True).alias("large")))
    if large.isEmpty():
        return keyed
    marked = keyed.join(large, "key", "left")
    table = F.shiftrightunsigned("key", 32)
    keys = F.array().cast("array<long>")
    for t, pair in enumerate(PAIRS):
        rest = [k for k in range(4) if k not in pair]
        parts = []
        for n, ((a, b), (c, d)) in enumerate(product(PAIRS, PAIRS)):
            quarters = (_bits(16 * rest[0] + 4 * a, 4), _bits(16 * rest[0] + 4 * b, 4), _bits(16 * rest[1] + 4 * c, 4), _bits(16 * rest[1] + 4 * d, 4))
            parts.append(F.xxhash64("key", F.lit(n), *quarters))
        keys = F.when(table == t, F.array(*parts)).otherwise(keys)
    return marked.filter("large is null").select("key", "fp").unionByName(marked.filter("large").select(F.explode(keys).alias("key"), "fp"))


def link_edges(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(src, dst) edges over distinct fingerprints (column fp) whose components are those of all links."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    blocks = [_bits(16 * k, 16) for k in range(4)]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(blocks[a], 16)).bitwiseOR(blocks[b]) for t, (a, b) in enumerate(PAIRS)]
    keyed = refined(checkpointed(distinct.select("fp", F.explode(F.array(*keys)).alias("key"))), block)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, block):
            key, part, fp = frame["key"].values, frame["part"].values, frame["fp"].values.view(np.uint64)
            new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            group = np.cumsum(new)
            size = np.bincount(group)[group]
            for low, high in ((2, 64), (65, 1 << 62)):  # small buckets share rounds, large ones have their own
                pick = (size >= low) & (size <= high)
                if not pick.any():
                    continue
                values, groups = fp[pick], group[pick]
                cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)] if low > 2 else [0, len(groups)]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    member, root = forest(values[s:e], groups[s:e], radius)
                    if len(member):
                        yield pd.DataFrame({"src": member.view(np.int64), "dst": root.view(np.int64)})

    return dealt(keyed, "fp", block).repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInPandas(thrifty(compare), "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, hot_share: int = 64) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, group_size.

    Null and wordless texts have fingerprint zero and are linked like any other.  component_id is the
    least doc_id that links reach; null ids take part but name a component only when alone.  Repeated
    rows are returned as often as they come.  An empty table gives no rows.
    """
    docs = checkpointed(fingerprints(df, id_col, text_col, width))
    total = docs.count()
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = connected_components(link_edges(nodes.select("fp"), radius))
    owned = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = owned.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size"))
    names = checkpointed(owned.join(named, "root").select("fp", "n", "component_id", "group_size"))
    hot = names.filter(F.col("n") >= max(2, total / hot_share)).drop("n")  # hot_share rows at most
    split = docs.join(F.broadcast(hot), "fp", "left")
    done = split.filter(F.col("group_size").isNotNull())
    rest = split.filter(F.col("group_size").isNull()).select("doc_id", "fp").join(names.drop("n"), "fp")
    columns = ("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size")
    return done.select(*columns).unionByName(rest.select(*columns))
