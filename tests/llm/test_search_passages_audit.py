"""Ranked search, word passages and the audit of filters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quarrylake.llm import block_anchors, filter_audit, ranked_search

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(i):
    return -(1 << 63) if i is None else i


def repeated(df, rows, ids=(3, 11)):
    return df.unionByName(df.filter(f"doc_id in {ids}")), [*rows, *(r for r in rows if r[0] in ids)]


# --- ranked search


def plain_search(rows, items, k=50):
    terms = [(low(i), [t.translate(FOLD) for t in re.findall(ranked_search.TERM, x or "")]) for i, x in rows]
    terms = [(i, t) for i, t in terms if t]
    n, total, df = len(terms), sum(len(t) for _, t in terms), Counter(w for _, t in terms for w in set(t))
    asked = defaultdict(set)
    for item, text in items:
        if text is not None:
            asked[low(item)] |= {t.translate(FOLD) for t in re.findall(ranked_search.TERM, text)}
    out = []
    for item, own in asked.items():
        scores = []
        for i, t in terms:
            tf, m = Counter(t), 100 - 50 + 50 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in own if w in tf)
            scores += [(-score, i)] if score > 0 else []
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((low(r["item_id"]), r["rank"], low(r["doc_id"]), r["score"]) for r in df.collect())


ITEMS = [(0, "The quick BROWN fox, the lazy dog"), (0, "bear"), (1, None), (2, ""), (3, "日本語 tail straße"), (None, "one two ab"), (4, "unknownword"), (5, "a" * 9000), (3, "日本語 tail straße")]


@pytest.mark.parametrize("which", ["small", "awkward"])
@pytest.mark.parametrize("shard", [200, 8 << 20])
def test_search_equals_brute_force(request, spark, which, shard):
    df, rows = request.getfixturevalue(which)
    if which == "awkward":
        df, rows = repeated(df, rows)
        items = spark.createDataFrame([(*r, 7, "clash") for r in ITEMS], "item_id long, text string, doc_id long, score string")
        asked = ITEMS
    else:
        items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
        asked = [(r["item_id"], r["text"]) for r in items.collect()]
        shard *= 100 if shard == 200 else 1
    index = ranked_search.build_index(df, shard_bytes=shard)
    assert found(ranked_search.search(index, items, query_bytes=400)) == plain_search(rows, asked)
    assert found(ranked_search.search(index, items, k=3)) == plain_search(rows, asked, 3)


def test_search_of_nothing(spark, awkward, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(awkward[0].limit(0)), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(make([(1, " .,"), (2, None)])), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(awkward[0]), items.limit(0)).count() == 0


def test_blocks_below_the_threshold_stay_packed(monkeypatch):
    """Documents of rising length: the first ones win, and few of the later blocks are unpacked."""
    rng = random.Random(3)
    texts = [("rare " * 3 if d < 60 else "").encode() + b" ".join([b"common"] + [f"w{rng.randrange(50)}".encode() for _ in range(5 + d // 400)]) for d in range(9000)]
    total = sum(len(ranked_search.terms_of(t)) for t in texts)
    row = type("Row", (), ranked_search.Shard.build(list(range(len(texts))), texts, len(texts), total))
    shard = ranked_search.Shard.read(row, len(texts), total)
    names = __import__("zlib").decompress(row.words).split(b" ")
    unpacked = []
    plain = shard.unpack
    monkeypatch.setattr(shard, "unpack", lambda blocks: (unpacked.append(len(blocks)), plain(blocks))[1])
    best = ranked_search.Best(20)
    terms = np.array([names.index(b"rare"), names.index(b"common")])
    shard.search(terms, np.array([5000, 1]), best)
    assert best.ids.max() < 60 and len(best.ids) == 20
    assert sum(unpacked) <= 40 < len(shard.first[shard.block_of[terms[1]] : shard.block_of[terms[1] + 1]])


def test_postings_survive_packing():
    rng = random.Random(5)
    texts = [b" ".join(rng.choices([b"a", b"b", b"c"], [1000, 5, 1], k=rng.randrange(1, 700))) for _ in range(700)] + [b"c " * 70_000]
    row = type("Row", (), ranked_search.Shard.build(list(range(len(texts))), texts, 10**10, 10**12))
    shard = ranked_search.Shard.read(row, 10**10, 10**12)
    for term, name in enumerate(zlib_words(row)):
        of, doc, impact = shard.unpack(np.arange(shard.block_of[term], shard.block_of[term + 1]))
        want = [(d, t.split().count(name), len(t.split())) for d, t in enumerate(texts) if name in t.split()]
        assert doc.tolist() == [d for d, _, _ in want]
        assert impact.tolist() == [10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * 10**10 // 10**12)) for _, tf, n in want]
        assert (shard.most[shard.block_of[term] + of] >= impact).all()


def zlib_words(row):
    import zlib

    return zlib.decompress(row.words).split(b" ")


# --- word passages


def plain_windows(rows, window=20):
    first = {}
    order = sorted(range(len(rows)), key=lambda r: low(rows[r][0]))
    words = [WORD.findall(t or "") for _, t in rows]
    for r in order:
        for s in range(len(words[r]) - window + 1):
            first.setdefault(tuple(words[r][s : s + window]), low(rows[r][0]))
    out = []
    for r, (i, _) in enumerate(rows):
        gone, own = set(), set()
        for s in range(len(words[r]) - window + 1):
            w = tuple(words[r][s : s + window])
            if first[w] < low(i) or w in own:
                gone |= set(range(s, s + window))
            own.add(w)
        kept = " ".join(w for k, w in enumerate(words[r]) if k not in gone)
        out.append((low(i), len(words[r]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def cut(df):
    return Counter((low(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("which", ["small", "awkward"])
@pytest.mark.parametrize("batch", [2000, 8 << 20])
def test_windows_equal_brute_force(request, which, batch):
    df, rows = request.getfixturevalue(which)
    if which == "awkward":
        df, rows = repeated(df, rows)
    else:
        batch *= 20 if batch == 2000 else 1
    assert cut(block_anchors.remove_repeated_windows(df, batch_bytes=batch)) == plain_windows(rows)


@pytest.mark.parametrize("window", [5, 8, 20])
def test_passages_at_every_alignment(make, window):
    """A passage in many documents at all offsets, a phrase that alone is too short, repeats inside a document."""
    rng = random.Random(window)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage, phrase = [f"p{k}" for k in range(30)], [f"q{k}" for k in range(window - 1)]
    rows = [(d, " \t".join([" \n".join(new(d % 13) + passage[d % 4 :] + new(3) + phrase + new(d % 5) + phrase)])) for d in range(40)]
    rows += [(100, " ".join(["x"] * 100)), (101, " ".join(passage * 4)), (None, " ".join(passage)), (None, " ".join(passage[2:] + ["é"])), (7, " ".join(passage))]
    got = cut(block_anchors.remove_repeated_windows(make(rows), window=window, batch_bytes=1500))
    assert got == plain_windows(rows, window)
    assert cut(block_anchors.remove_repeated_windows(make(rows).limit(0), window=window)) == Counter()


# --- audit of filters


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(low(i), least.get(t or "", low(i)))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": low(i) > least[t],
        }
        parts[source or ""].append(({f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, own in parts.items():
        removed, found = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed[f] += len(gone)
                failing, alone = sum(f in d[0] for d in own), sum(d[0] == {f} for d in own)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], removed[r[-1]]) for r in found]
    return sorted(out)


def audited(df):
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_audit_equals_brute_force(spark, small, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(filter_audit.audit(docs, labels)) == want

    plain = " ".join(f"w{k}" for k in range(60))
    rows = [(r[0], r[1], f"src{(r[0] or 0) % 2}") for r in awkward[1]]
    rows += [(None, plain, None), (None, plain, ""), (20, plain, None), (21, plain.upper(), "src1"), (22, plain + " $", "src0"), (22, plain + " $", "src0"), (23, plain + " $", None), (24, "", None)]
    marks = [(20, 1, 0), (20, 0, 1), (22, 1, None), (None, 1, 1), (99, 1, 1), (24, None, 1)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, mask string, good int")
    labels = spark.createDataFrame([(*m, "c") for m in marks], "doc_id long, quality int, toxic int, part string")
    assert audited(filter_audit.audit(docs, labels)) == plain_audit(rows, marks)
    assert audited(filter_audit.audit(docs, labels.limit(0))) == plain_audit(rows, [])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
