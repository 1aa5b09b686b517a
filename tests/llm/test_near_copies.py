"""Near copies of five-word shingles against brute force."""

import random
import re

import pytest

import corpus_pipeline
from quarrylake.llm import near_copies

from .test_dedup_operators import LOW


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if 5 * len(sets[a] & sets[b]) >= 4 * union:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(rows))]


def edited():
    """Families of texts with ever more edited words, so that similarities lie on both sides of 0.8."""
    rng = random.Random(5)
    rows = []
    for size in (8, 40, 300, 900):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for k in range(24):
            words = list(base)
            for _ in range(k * size // 400 + k % 2):
                words[rng.randrange(size)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("which", ["small", "awkward", "edited"])
@pytest.mark.parametrize("block", [16, 16_384])
def test_near_copies_equal_brute_force(request, make, which, block):
    df, rows = (make(edited()), edited()) if which == "edited" else request.getfixturevalue(which)
    groups = {}
    for (i, _), g in zip(rows, plain_groups(rows), strict=True):
        groups.setdefault(g, []).append(i)
    want = sorted((sorted(g, key=str) for g in groups.values()), key=str)
    got = {}
    for r in near_copies.near_copies(df, hot_share=4, block=block).collect():
        got.setdefault(r["root"], []).append(r["doc_id"])
        assert r["component_id"] is not None or r["doc_id"] is None
    assert sorted((sorted(g, key=str) for g in got.values()), key=str) == want


def test_stage_drops_copies_with_edited_words(spark, make, tmp_path):
    words = [f"word{k}" for k in range(200)]
    other = [*words[:100], "edited", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100])), (None, " ".join(words) + " end")]
    kept = corpus_pipeline.near_stage(spark, make(rows), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]  # the row without an id is a copy of one with an id


def test_language_stage_without_labels_keeps_lettered_documents(spark, make, tmp_path):
    rows = [(1, "the house"), (2, "12 34"), (3, None), (4, "das Haus")]
    kept = corpus_pipeline.language_stage(spark, make(rows, [None] * 4), str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept) == [(1, None), (4, None)]


def test_language_stage_writes_the_prediction(spark, make, tmp_path):
    rows = [(i, "the house and the garden are green") for i in range(60)] + [(i, "das Haus und der Garten ist schoen") for i in range(60, 120)]
    langs = ["en"] * 60 + ["de"] * 59 + ["en"]
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, make(rows, langs), str(tmp_path)).collect()}
    assert len(kept) == 120 and kept[119] == "de"


def test_stage_tells_rows_that_share_an_id_apart(spark, make, tmp_path):
    copied, clean = " ".join(f"word{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    alone = " ".join(f"nameless{k}" for k in range(60))
    rows = [(3, copied), (5, copied + " more"), (5, clean), (None, copied), (None, alone), (None, alone), (7, clean + " end")]
    kept = corpus_pipeline.near_stage(spark, make(rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, copied), (5, clean), (None, alone)], key=str)


def test_rounds_after_failed_edges(spark, make, monkeypatch):
    """With one pair of each text and group in a round, groups that only a later pair links are still found."""
    monkeypatch.setattr(near_copies, "FIRST_PAIRS", 2)
    rows = edited()
    groups = {}
    for (i, _), g in zip(rows, plain_groups(rows), strict=True):
        groups.setdefault(g, set()).add(i)
    got = {}
    for r in near_copies.near_copies(make(rows)).collect():
        got.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_band_key_of_very_many_nodes(spark):
    """A key that 100,000 nodes share is counted and dealt without being gathered."""
    from pyspark.sql import functions as F

    from quarrylake.llm.simhash import dealt

    nodes = spark.range(100_000).select(F.col("id").alias("node"), F.struct(F.array(F.lit(7).cast("long"), F.lit(9).cast("long"), F.col("id") + 100).alias("keys")).alias("sketch"))
    shared = near_copies._shared_buckets(nodes)
    assert shared.count() == 100_000 and shared.select("key").distinct().count() == 1  # keys 7 and 9 have the same members
    parts = dealt(shared, "node", 16_384).groupBy("key", "part").count()
    assert parts.agg(F.max("count")).first()[0] <= 2 * 16_384


def test_simhash_links_come_first(spark, make, monkeypatch):
    """Copies within two bits of SimHash are grouped by its links alone; what those bits cannot tell is left to the bands, and an exact check decides."""
    words = [f"word{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words) + " end"), (3, "all other words stand here"), (4, " ".join(words[:200]))]
    monkeypatch.setattr(near_copies, "_shared_buckets", lambda nodes: nodes.limit(0).select(nodes["node"].alias("key"), "node"))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
