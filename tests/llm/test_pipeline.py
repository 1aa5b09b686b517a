"""The pipeline against a brute-force version of all its stages."""

from collections import defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylake.llm import queries

from .test_dedup_operators import LOW
from .test_near_copies import plain_groups


def spans_of_characters(b):
    at = 0
    for c in b.decode():
        size = len(c.encode())
        yield at, size
        at += size


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = [(9001, None), (9002, ""), (9003, "12 34 !!"), (9004, "Ganz neue Worte stehen hier")]
    more = spark.createDataFrame([(i, t, None, "src1", len(t or "")) for i, t in odd], docs.schema)
    docs.unionByName(more).withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + odd

    rows = [(i, t) for i, t in rows if t and regex.search(r"\p{L}", t)]
    last = {}
    for i, t in rows:
        key = t.translate(LOW)
        last[key] = max(i, last.get(key, i))
    rows = [(i, t) for i, t in rows if last[t.translate(LOW)] == i]
    roots = plain_groups(rows)  # five-word shingles, similarity 0.8
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        least[r].append(i)
    rows = sorted((i, t.encode()) for (i, t), r in zip(rows, roots, strict=True) if i == min(least[r]))
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.encode_special_tokens = True
    want = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        for at, size in spans_of_characters(b):
            gone[at : at + size] = gone[at : at + size].all()  # a character that is only partly covered stays
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode()
        want[i] = len(library.encode(text, add_special_tokens=False).ids) + 1
    got = defaultdict(list)
    bins = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(r)
        bins[r["shard"], r["bin"]] += r["n_tokens"]
    assert {i: sum(r["n_tokens"] for r in pieces) for i, pieces in got.items()} == want
    assert max(bins.values()) <= 2048
    for pieces in got.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["start_token"] for r in pieces] == [2048 * k for k in range(len(pieces))]


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.select(*corpus_pipeline.COLUMNS), str(tmp_path)).count() == 0


def test_stages_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [
        (None, "the house and the garden", "en", None, None), (None, None, None, None, None), (1, None, "en", "src0", 0), (2, "", None, "src1", None),
        (3, "The house and the garden", None, "src1", 7), (3, "The house and the garden", None, "src1", 7), (4, "das Haus und der Garten " * 30, "de", "src1", 9),
        (1 << 60, "das Haus und der Garten " * 30 + "ist neu", "de", None, None), (5, "w " * 90_000, "en", "src2", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit(1)).withColumn("kept", F.lit("x"))
    found = docs
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, found, str(tmp_path))
        found.write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        got = sorted((r["doc_id"] for r in found.collect()), key=str)
        if name == "language_id":
            assert got == sorted([None, 3, 3, 4, 1 << 60, 5], key=str)
        elif name == "exact_dedup":
            assert got == sorted([3, 4, 1 << 60, 5], key=str)
        else:
            assert {3, 4, 5} <= set(got) <= {3, 4, 1 << 60, 5}
