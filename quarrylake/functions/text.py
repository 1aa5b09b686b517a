"""Lexical functions as Spark columns: tokens, sizes, wording, redaction, patterns, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as X

# Patterns and words that results depend on.
HANGUL_RUN = r"[가-힣]{2,}"
CASE_BREAKS = (("([a-z0-9])([A-Z])", "$1 $2"), ("([A-Z]+)([A-Z][a-z])", "$1 $2"))
KEY_TERM = r"[A-Za-z][A-Za-z0-9]*(?:[._+#-][A-Za-z0-9]+)*[+#]*|\d+(?:\.\d+)*"
PATH_HINT = r"[A-Za-z0-9_@.\-/]*/[A-Za-z0-9_@.\-/]+|[A-Za-z0-9_-]+\.[A-Za-z][A-Za-z0-9_]{0,7}\b"
SENTENCE_BREAK = r"(?<=[.!?。])\s+|\r?\n+"
QUOTE_SIGNS = r"[`\"'“”‘’()\[\]{}]"
POINTS = r"[.,;:!?。、]+"
NEGATIONS = ("not", "never", "no", "don't", "dont", "without", "avoid", "stop")
ASCII_PER_TOKEN, OTHER_PER_TOKEN = 4, 1.3

#: Tokens of column {c} in DuckDB: word runs, their parts and themselves, of two letters at least.
DUCK_TOKENS = (
    "list_distinct(list_filter(flatten(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+'), "
    "lambda w: string_split(lower(regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_+', ' ', 'g')), ' ') || [lower(w)])), lambda t: length(t) >= 2))"
)


def nfkc(text: Column) -> Column:
    """NFKC by ICU; pure ASCII passes through."""
    changed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(changed)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that is worked out once and used several times."""
    return F.transform(F.array(value), body)[0]


#: Tokens of a single sign do not count.
SINGLE = ("", *"abcdefghijklmnopqrstuvwxyz0123456789_")


def tokens(text: Column) -> Column:
    """Distinct tokens: ASCII words with their camel-case and underscore parts, and Hangul bigrams.

    The text is cleaned and split as a whole, not word by word: words are joined by blanks, camel case is broken only where there is any, and both forms are split at blanks.  What is used
    twice is bound, since nothing shares the parts of an expression that holds a lambda.
    """
    one_case = lambda words: F.regexp_replace(F.regexp_replace(words, *CASE_BREAKS[0]), *CASE_BREAKS[1])

    def split(words: Column, parted: Column) -> Column:
        parts = F.when(parted.contains("_") | (parted != words), F.translate(F.lower(parted), "_", " "))
        return F.array_except(F.split(F.concat_ws(" ", F.lower(words), parts), " "), F.array(*map(F.lit, SINGLE)))

    def of_ascii(words: Column) -> Column:
        parted = F.when(words.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), one_case(words)).otherwise(words)
        return bound(parted, lambda p: split(words, p))

    def bigrams(whole: Column) -> Column:
        runs = F.regexp_extract_all(whole, F.lit(HANGUL_RUN), F.lit(0))
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))

    def of(whole: Column) -> Column:
        # taking the words out is ten times as fast as replacing what stands between them
        latin = bound(F.array_join(F.regexp_extract_all(whole, F.lit("[A-Za-z0-9_]+"), F.lit(0)), " "), of_ascii)
        return F.when(whole.rlike(HANGUL_RUN), F.concat(latin, bigrams(whole))).otherwise(latin)

    return bound(nfkc(F.coalesce(text, F.lit(""))), of)


def approx_tokens(text: Column) -> Column:
    """ASCII characters / 4 and others / 1.3, rounded up."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.ceil((F.length(text) - other) / ASCII_PER_TOKEN + other / OTHER_PER_TOKEN)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), r"\s+", " "))


def for_match(text: Column) -> Column:
    quotes = F.translate(nfkc(text), "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(quotes, r"\s+", " ")))


def canonical(text: Column) -> Column:
    """Wording without punctuation, quotes, backticks or case."""
    bare = F.regexp_replace(for_match(text), QUOTE_SIGNS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, POINTS, " "), r"\s+", " "))


def key_terms(text: Column) -> Column:
    """Numbers, versions and Latin names, the parts that change what a rule says."""
    found = F.regexp_extract_all(nfkc(text), F.lit(KEY_TERM), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, F.lower)))


def negated(text: Column) -> Column:
    return F.lower(text).rlike(r"(?<![A-Za-z0-9_])(" + "|".join(NEGATIONS) + r")(?![A-Za-z0-9_])")


def sentences(text: Column) -> Column:
    """Sentences on . ! ? 。 and line breaks, collapsed, empty ones dropped."""
    parts = F.split(text, SENTENCE_BREAK)
    return F.filter(F.transform(parts, collapse), lambda s: F.length(s) > 0)


def slug(text: Column, limit: int = 40) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit("item"))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def path_hints(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATH_HINT), F.lit(0))
    bare = F.transform(found, lambda h: F.regexp_replace(h, "^[./]+", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda h: (F.length(h) >= 3) & ~h.rlike(r"^\d+(\.\d+)*$"))))


def strip_invisible(text: Column) -> Column:
    """Without the signs that do not show and those that turn the direction of writing."""
    return F.regexp_replace(text, f"[{X.INVISIBLE}]", "")


def names_topic(text: Column, topic: Column) -> Column:
    """Whether a text in any case names a topic: one of ASCII letters as a word, any other also inside of one; not one of a single sign."""
    low, said = F.lower(text), F.lower(topic)
    edges = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(said, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return (F.length(topic) >= 2) & F.when(topic.rlike(r"^[\x20-\x7e]+$"), F.regexp_like(low, edges)).otherwise(F.contains(low, said))


def error_excerpt(output: Column, most: int = 5) -> Column:
    """The first distinct lines that tell of an error, each cut to 200 signs; null where there is none."""
    lines = F.transform(F.split(output, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    told = F.array_distinct(F.filter(lines, lambda s: F.regexp_like(s, F.lit(X.ERROR_LINE)) & ~F.regexp_like(s, F.lit(X.NOISE_LINE))))
    excerpt = F.nullif(F.array_join(F.transform(F.slice(told, 1, most), lambda s: truncate(s, 200)), "\n"), F.lit(""))
    return F.when(output.rlike(X.ERROR_LINE), excerpt)  # most texts have no such line and are never split


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def rule_marks(text: Column) -> Column:
    """What ``same_rule`` compares but the tokens, for texts that are worked out once each: digests of the canonical wording and of the key terms."""
    marks = lambda c, t: F.struct((F.length(c) > 0).alias("said"), F.sha2(c, 256).alias("wording"), negated(text).alias("negated"), F.sha2(F.array_join(key_terms(t), " "), 256).alias("terms"))
    return bound(nfkc(text), lambda t: bound(canonical(t), lambda c: marks(c, t)))


def close_wording(ta: Column, tb: Column) -> Column:
    """Whether the tokens of two canonical wordings have a Jaccard similarity of 0.9."""
    return (F.size(ta) >= 4) & (F.size(tb) >= 4) & (jaccard(ta, tb) >= 0.9)


def same_rule(a: Column, b: Column) -> Column:
    """Equal canonical wording, or token Jaccard of 0.9 with equal key terms and negation."""
    ca, cb = canonical(a), canonical(b)
    ta, tb = tokens(ca), tokens(cb)
    close = (negated(a) == negated(b)) & (key_terms(a) == key_terms(b)) & close_wording(ta, tb)
    return (F.length(ca) > 0) & (F.length(cb) > 0) & ((ca == cb) | close)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tok): one row for each distinct token of each text."""
    return docs.select(F.col(id_col), tokens(F.col(text_col)).alias("toks")).select(id_col, F.explode("toks").alias("tok"))


def idf(posted: DataFrame, n: int) -> DataFrame:
    """(tok, df, w): w = ln(1 + n / df)."""
    return posted.groupBy("tok").agg(F.count("*").alias("df")).withColumn("w", F.log(1 + F.lit(max(1, n)) / F.col("df")))
