import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_tokens string"


@pytest.fixture(scope="session")
def make(spark):
    """documents with columns that clash with outputs, from (doc_id, text) pairs."""

    def build(rows, langs=None):
        langs = langs or ["en"] * len(rows)
        return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), "x", "y", "z") for (i, t), lang in zip(rows, langs, strict=True)], DOC)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """All whole documents of the smallest table."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


AWKWARD = [
    (0, None),
    (1, ""),
    (2, "  \t\n "),
    (3, "one"),
    (4, "One"),
    (5, "one two"),
    (6, "ÀÉ straße ﬁ"),
    (7, "àé STRASSE fi"),
    (8, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood"),
    (9, "xx the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood"),
    (10, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood"),
    (11, "a" * 9000),
    (12, "ab " * 70_000),
    (13, "<|endoftext|> tail's 12'34 日本語 😀  x"),
    (None, "no id"),
    (14, "zz zz zz zz"),
]


@pytest.fixture(scope="session")
def awkward(make):
    return make(AWKWARD), AWKWARD
