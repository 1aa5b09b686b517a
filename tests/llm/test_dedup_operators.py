"""Exact and near de-duplication, passages, fingerprints, packing."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylake.llm import components, doc_fingerprint, exact_dedup, packing, queries, simhash, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(i):
    return -(1 << 63) if i is None else i


@pytest.mark.parametrize("which", ["small", "awkward"])
@pytest.mark.parametrize("share", [2, 5, 256])
def test_exact(request, which, share):
    df, rows = request.getfixturevalue(which)
    if which == "awkward":
        df, rows = df.unionByName(df.filter("doc_id in (3, 11)")), [*rows, *(r for r in rows if r[0] in (3, 11))]
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    got = exact_dedup.exact_dedup(df, hot_share=share, counters=4 * share).collect()
    want = Counter((str(i), str(max(g, key=low)), len(g), sha(t)) for t, g in groups.items() for i in g)
    assert Counter((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.keep_first_copies(df).count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_misra_gries_bound():
    rng = np.random.default_rng(1)
    stream = [f"k{int(k)}" for k in rng.zipf(1.3, 20_000)]
    summary, true = Counter(), Counter(stream)
    for s in range(0, len(stream), 500):
        summary.update(stream[s : s + 500])
        summary = exact_dedup.shrink(summary, 40)
    for k, n in true.items():
        assert n - len(stream) / 41 <= summary.get(k, 0) <= n


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(fps))]


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_simhash(request, which):
    df, rows = request.getfixturevalue(which)
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r].append(i)
    want = sorted((str(i), f"{f:016x}", str(min(least[r], default=None))) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 16_384])
def test_simhash_links_of_crowded_fingerprints(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = rng.integers(0, 14, (240, 3))
    fps = np.unique([c ^ np.uint64(sum({1 << int(b) * 4 for b in f})) for c, f in zip(np.resize(centres, 240), flips, strict=True)]).astype(np.uint64)
    edges = simhash.link_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), block=block)
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    mine = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        mine[found.get(x, x)].add(x)
    want = defaultdict(set)
    for x, r in zip(fps.view(np.int64).tolist(), plain_components([int(x) for x in fps]), strict=True):
        want[r].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 8, 300).astype(np.uint64) * np.uint64(1 << 40) ^ np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    groups = np.sort(rng.integers(0, 20, 300))
    got = {(int(a), int(b)) for i, j in simhash.bit_sliced_links(values, groups, radius) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if groups[a] == groups[b] and int(values[a] ^ values[b]).bit_count() <= radius}
    assert got == want


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (7, None), (200, 201), (201, 200)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {k: 0 for k in range(41)} | {200: 200, 201: 200}


def test_rounds_of_components_have_as_many_tasks_as_their_edges_are_worth(spark, monkeypatch):
    """A shuffle of 211 tasks leaves files for each of them; a few edges need no more tasks than there are cores."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    widths = []

    def counted(df):
        out = df.checkpoint()
        widths.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "checkpointed", counted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "src long, dst long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = dict(components.connected_components(edges).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20}
    assert len(widths) > 2 and max(widths[1:]) <= spark.sparkContext.defaultParallelism


def plain_removal(rows, length=50):
    first = {}
    texts = [(low(i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in first or i < first[w]:
                first[w] = i
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.diff(np.r_[0, gone.astype(int)])
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out)


def removal(df, **options):
    got = suffix_dedup.remove_repeats(df, **options).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    return sorted((low(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in got)


@pytest.mark.parametrize("which", ["small", "awkward"])
@pytest.mark.parametrize(("batch", "hot"), [(20_000, 64), (20_000, 1), (20_000, 3), (8 << 20, 64)])
def test_passages(request, which, batch, hot):
    df, rows = request.getfixturevalue(which)
    assert removal(df, batch_bytes=batch, hot_contexts=hot) == plain_removal(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "hot"), [(1, 64), (256, 64), (256, 2)])
def test_passages_planted(make, monkeypatch, share, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    rows = []
    for i in rng.permutation(160).tolist():
        parts = [" ".join(rng.choice(words, rng.integers(0, 60)))]
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(0, 12)]
            s = rng.integers(0, 60)
            parts += [p[s : s + rng.integers(30, 200)], " ".join(rng.choice(words, rng.integers(0, 9)))]
        rows.append((i * 7, "|".join(parts)))
    rows += [(5000, rows[3][1]), (5000, rows[4][1]), (5001, "ab" * 400), (5002, "ab" * 300), (None, passages[0])]
    assert removal(make(rows), batch_bytes=9000, hot_contexts=hot) == plain_removal(rows)


def test_passages_over_chunks(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 101, 3000)).decode()
    rows = [(1, base), (2, base[500:1900] + "q" + base[700:]), (3, "z" * 11 + base), (4, base[::-1])]
    assert sum(c.strings.sum() for c in [suffix_dedup.Contexts([t.encode() for _, t in rows])]) == sum(len(t) - 49 for _, t in rows)
    assert removal(make(rows)) == removal(make(rows), batch_bytes=2000, hot_contexts=1) == plain_removal(rows)


def test_passages_with_clashing_columns_and_null_ids(make):
    passage = "the same long passage that stands in many documents without an id of their own, word for word"
    rows = [(None, f"{k} {passage}") for k in range(40)] + [(1, passage), (2, f"x {passage}")]
    df = make(rows).withColumn("batch", F.lit("b")).withColumn("kind", F.lit("k")).withColumn("_hash", F.lit("h")).withColumn("payload", F.lit("p"))
    assert removal(df, batch_bytes=300, hot_contexts=2) == plain_removal(rows)
    assert sorted(r["batch"] for r in suffix_dedup.remove_repeats(df, keep=("batch", "kind")).collect()) == ["b"] * len(rows)


@pytest.mark.parametrize("length", [3, 6])
def test_equal_strings(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        text = bytes(rng.choice(list(b"ab\0"), rng.integers(length, 150)).astype(np.uint8))
        kind = suffix_dedup.equal_strings(text, length)
        seen = {}
        for i in range(len(text) - length + 1):
            assert seen.setdefault(text[i : i + length], kind[i]) == kind[i]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("transform", [40, 100_000])
def test_resolve_of_large_anchors(transform):
    rng = np.random.default_rng(8)
    anchors, owner = rng.integers(0, 4, 60).astype(np.uint64), rng.permutation(60)
    letters = [b"ab", b"cd", b"ef", b"gh"]  # equal strings always have one anchor
    texts = [bytes(rng.choice(list(letters[int(a)]), rng.integers(8, 30)).astype(np.uint8)) for a in anchors]
    got = suffix_dedup.resolve(texts, anchors, owner, 6, transform)
    least = {}
    for t, a, o in zip(texts, anchors, owner, strict=True):
        for j in range(len(t) - 5):
            least[a, t[j : j + 6]] = min(o, least.get((a, t[j : j + 6]), 99))
    for t, a, g in zip(texts, anchors, got, strict=True):
        assert g.tolist() == [least[a, t[j : j + 6]] for j in range(len(t) - 5)]


def plain_canonical(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip(" ")


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_fingerprints(request, which):
    df, rows = request.getfixturevalue(which)
    got = {r["doc_id"]: r for r in doc_fingerprint.edit_sensitivity(df).collect()}
    order = sorted(rows, key=lambda r: -low(r[0]))
    assert len(got) == len(rows)
    names = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert r["near_edited"] == float(plain_canonical(t) == plain_canonical(edited))
        assert r["near_next"] == float(plain_canonical(t) == plain_canonical(after))
        assert names.setdefault(plain_canonical(t), r["fingerprint"]) == r["fingerprint"]
        assert names.setdefault(plain_canonical(edited), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(names.values())) == len(names)
    only = doc_fingerprint.fingerprint(df).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in only} == {i: r["fingerprint"] for i, r in got.items()}


def test_fingerprints_of_odd_tables(make):
    assert doc_fingerprint.edit_sensitivity(make([])).count() == 0
    one = doc_fingerprint.edit_sensitivity(make([(3, "abcdef")])).first()
    assert one["edited_sha256"] == sha("abcdab") and one["near_next"] == 1.0
    twice = doc_fingerprint.edit_sensitivity(make([(3, "b"), (3, "a"), (2, "c")])).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in twice) == [(2, 1), (3, 1), (3, 1)] and len({r["fingerprint"] for r in twice}) == 3


def test_every_row_of_a_repeated_id_has_a_fingerprint(make):
    texts = ["Straße  und Weg", "strasse UND weg", "etwas ganz anderes", "etwas ganz anderes", ""]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(9, "neun")]
    names = {t: plain_canonical(t) for _, t in rows}
    for found, column in ((doc_fingerprint.edit_sensitivity(make(rows)), "n_chars"), (doc_fingerprint.fingerprint(make(rows)), "doc_id")):
        found = found.collect()
        assert Counter(r["doc_id"] for r in found) == {None: 5, 7: 5, 9: 1}
        assert Counter(r["fingerprint"] for r in found).values().__len__() == len(set(names.values())) and column in found[0]


def test_fingerprint_collisions_are_told_apart(spark):
    rows = [(1, 0, 7, 7, "same", True, 2), (2, 0, 7, 7, "same", False, 2), (3, 0, 7, 7, "other", False, 2)]
    members = spark.createDataFrame(rows, "key long, kind int, h1 long, h2 long, canon string, is_rep boolean, salts int")
    assert [(r["key"], r["own"]) for r in doc_fingerprint.differing(members).collect()] == [(3, sha("other"))]


def plain_best_fit(rows, capacity):
    """Best fit by looking at all bins; the same order of items and the same ties."""
    bins, out = [], []
    for i, size, source, cluster in rows:
        for piece in range(size // capacity):
            bins.append([0, set(), set()])
            out.append((i, piece, capacity, len(bins) - 1))
    for i, size, source, cluster in sorted(rows, key=lambda r: (-(r[1] % capacity), rows.index(r))):
        rest = size % capacity
        if rest or not size:
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] and b[0] >= rest and source not in b[1] and (cluster is None or cluster not in b[2])]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([capacity, set(), set()])
            bins[k][0] -= rest
            if source is not None:
                bins[k][1].add(source)
            bins[k][2].add(cluster)
            out.append((i, size // capacity, rest, k))
    return sorted(out)


def test_packing_equals_plain_best_fit():
    rng = np.random.default_rng(6)
    for _ in range(20):
        rows = sorted(((k, int(rng.integers(0, 260)), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", "w", None])) for k in range(80)), key=lambda r: -r[1])
        got = [(row[0], piece, size, b) for row, found in zip(rows, packing.pack_shard(rows, 100), strict=True) for piece, _, size, b, _ in found]
        assert sorted(got) == plain_best_fit(rows, 100)


def test_packing_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    pieces = queries.op5_packing(spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in docs}
    cluster = {r["doc_id"]: r["text"].translate(LOW) for r in docs}
    bins, of = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p["shard"], p["bin"]].append(p)
        of[p["doc_id"]].append(p)
    assert set(of) == set(source)
    for mine in of.values():
        mine.sort(key=lambda p: p["piece"])
        assert [p["start_token"] for p in mine] == [2048 * k for k in range(len(mine))] and all(p["n_tokens"] == 2048 for p in mine[:-1])
    for mine in bins.values():
        mine.sort(key=lambda p: p["bin_offset"])
        at = 0
        for p in mine:
            assert p["bin_offset"] == at
            at += p["n_tokens"]
        assert at <= 2048
        assert len({source[p["doc_id"]] for p in mine}) == len({cluster[p["doc_id"]] for p in mine}) == len(mine)


def test_packing_edge_cases(spark):
    rows = [(1, None, None, None), (2, -3, "s", "c"), (3, 0, "s", "c"), (None, 9, None, "c"), (4, 25, "s", None), (4, 25, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    from pyspark.sql import functions as F

    got = packing.pack(df, cluster=F.col("cluster"), capacity=10).collect()
    assert Counter(str(r["doc_id"]) for r in got) == {"1": 1, "2": 1, "3": 1, "None": 1, "4": 6}
    assert packing.pack(df.limit(0), cluster=F.col("cluster")).count() == 0


def test_packing_of_rows_without_an_id_is_spread(spark):
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).alias("n_tokens"), F.lit("s").alias("source"))
    shards = packing.pack(df, capacity=10).groupBy("shard").count().collect()
    assert len(shards) == -(-40_000 // packing.SHARD_ROWS) and max(r["count"] for r in shards) < 2 * packing.SHARD_ROWS


def test_exact_keeps_one_of_equal_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "same")] * 50 + [(1, "other"), (1, "other")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, hot_share=4).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 52


def test_whole_characters_stay(make):
    shared = "é" * 40
    rows = [(1, shared), (2, "x" + shared[:30] + "è" + shared[:10]), (3, "aé" + "é" * 24 + "zz")]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(make(rows), whole_characters=True).collect()}
    for i, text in rows:
        kept = bytes(got[i]["kept"]).decode()  # valid
        assert "�" not in kept and all(c in text for c in kept)
    assert got[2]["n_removed"] > 0
