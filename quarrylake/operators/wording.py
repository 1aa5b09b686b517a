"""Text queries: wording, signals, hygiene and scores over documents and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import models
from ..functions import text as T
from ..functions.screening import redact_secrets
from ..lineage import checkpointed
from ..plans.query import Query, spread, table
from . import overlap

D = T.DUCK_TOKENS.format(c="text")
#: Canonical wording in DuckDB (the fixture tables hold no compatibility characters).
CANON = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“”', '''''""'), '\s+', ' ', 'g'))), '[`"''“”‘’()\[\]{}]', '', 'g'), '[.,;:!?。、]+', ' ', 'g'), '\s+', ' ', 'g'))"""


def per_row(name: str, source: str, key: str, columns: dict[str, Callable[[Column], Column]], oracle: str | None, text: str = "text") -> Query:
    """A projection of one text column."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spread(table(spark, sf, source).select(key, text), key, text)
        return rows.select(key, *[make(F.col(text)).alias(c) for c, make in columns.items()])

    return Query(name, run, oracle)


def tx10_same_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that say the same as the document before them.

    Each text is worked out once and neighbours meet by digests.  Only those that these cannot tell apart
    (equal key terms and negation, different wording) have their tokens compared, one set for each wording.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marks = checkpointed(spread(docs, "doc_id", "text").select("doc_id", T.rule_marks(F.col("text")).alias("own")).select("doc_id", "own.*"))
    before = marks.select((F.col("doc_id") + 1).alias("doc_id"), *[F.col(c).alias(f"{c}_before") for c in marks.columns[1:]])
    alike = lambda c: F.col(c) == F.col(f"{c}_before")
    both, equal = F.col("said") & F.col("said_before"), alike("wording")
    pairs = checkpointed(marks.join(before, "doc_id").select("doc_id", (both & equal).alias("same"), F.coalesce(both & ~equal & alike("negated") & alike("terms"), F.lit(False)).alias("open"), "wording", "wording_before"))
    left = pairs.filter("open")
    near = left.select(F.explode(F.array("doc_id", F.col("doc_id") - 1)).alias("doc_id")).distinct()
    wordings = spread(docs.join(near, "doc_id", "left_semi"), "doc_id", "text").select(T.canonical(F.col("text")).alias("text"))
    toks = checkpointed(wordings.distinct().select(F.sha2("text", 256).alias("wording"), T.tokens(F.col("text")).alias("toks")))
    told = left.join(toks, "wording").join(toks.select(F.col("wording").alias("wording_before"), F.col("toks").alias("toks_before")), "wording_before")
    return pairs.filter("NOT open").select("doc_id", "same").unionByName(told.select("doc_id", T.close_wording(F.col("toks"), F.col("toks_before")).alias("same")))


def tx02_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The number of tokens of each document and a digest of them in order; the tokens are worked out once."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    told = T.bound(T.tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.sha2(F.concat_ws(" ", F.sort_array(t)), 256).alias("digest")))
    return docs.select("doc_id", told.alias("told")).select("doc_id", "told.*")


TX10 = f"""
    WITH a AS (SELECT doc_id, text, {CANON} AS c FROM documents),
    b AS (SELECT *, list_distinct(list_filter(regexp_extract_all(c, '[a-z0-9_]+'), lambda t: length(t) >= 2)) AS t0,
        list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[._+#-][A-Za-z0-9]+)*[+#]*|\\d+(?:\\.\\d+)*'), lambda x: lower(x)))) AS k,
        regexp_matches(lower(text), '(^|[^a-z0-9_])(not|never|no|don''t|dont|without|avoid|stop)([^a-z0-9_]|$)') AS neg FROM a),
    e AS (SELECT *, list_distinct(flatten(list_transform(t0, lambda w: list_filter(string_split(regexp_replace(w, '_+', ' ', 'g'), ' ') || [w], lambda z: length(z) >= 2)))) AS t FROM b)
    SELECT x.doc_id, length(x.c) > 0 AND length(y.c) > 0 AND (x.c = y.c OR (x.neg = y.neg AND x.k = y.k AND len(x.t) >= 4 AND len(y.t) >= 4
        AND len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.9)) AS same
    FROM e x JOIN e y ON x.doc_id = y.doc_id + 1
"""


def ag26_topic_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The four most frequent words of each document, ties by word."""
    from pyspark.sql import Window

    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return counted.withColumn("place", place).filter("place <= 4")


def ag15_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return T.idf(T.postings(docs, "doc_id", "text"), docs.count()).select("tok", "df", F.round("w", 5).alias("w"))


def ag16_weighted_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """inter / sqrt(query weight * document weight) of the query set with every document, from 0.12 up."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = overlap.matching(docs.select(F.col("doc_id").alias("id"), "text"), asked.select(F.col("item_id").alias("id"), "text"), 0.12)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score")


AG16 = f"""
    WITH d AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest({D}) AS tok FROM documents)),
    q AS (SELECT DISTINCT item_id, tok FROM (SELECT item_id, unnest({D}) AS tok FROM benchmark)),
    n AS (SELECT greatest(1, count(*)) AS n FROM documents),
    w AS (SELECT tok, ln(1 + n.n / count(*)) AS w FROM d, n GROUP BY tok, n.n),
    dn AS (SELECT doc_id, sum(w) AS dn FROM d JOIN w USING (tok) GROUP BY doc_id),
    qw AS (SELECT item_id, q.tok, coalesce(w.w, ln(1 + n.n)) AS w FROM q CROSS JOIN n LEFT JOIN w ON q.tok = w.tok),
    qn AS (SELECT item_id, sum(w) AS qn FROM qw GROUP BY item_id),
    i AS (SELECT item_id, doc_id, sum(qw.w) AS inter FROM qw JOIN d USING (tok) GROUP BY item_id, doc_id)
    SELECT * FROM (SELECT item_id, doc_id, round(inter / sqrt(qn * dn), 5) AS score FROM i JOIN qn USING (item_id) JOIN dn USING (doc_id)) WHERE score >= 0.12
"""

TX13 = f"""
    WITH l AS (SELECT doc_id, p, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS s, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS p FROM documents)),
    f AS (SELECT doc_id, s, min(p) AS p FROM l WHERE regexp_matches(s, '{X.ERROR_LINE}') AND NOT regexp_matches(s, '{X.NOISE_LINE}') GROUP BY doc_id, s),
    e AS (SELECT doc_id, array_to_string(list_transform((list(s ORDER BY p))[1:5], lambda x: CASE WHEN length(x) > 200 THEN substr(x, 1, 199) || '…' ELSE x END), chr(10)) AS x FROM f GROUP BY doc_id)
    SELECT doc_id, sha256(regexp_replace(coalesce(x, ''), '\\b(token\\s*=\\s*")[0-9a-f]{{40}}(")', '\\1{{token}}\\2', 'g')) AS excerpt FROM documents LEFT JOIN e USING (doc_id)
"""


def hidden_in(text: Column) -> Column:
    """A text with a sign that does not show after every blank: what is to be taken out again."""
    return F.regexp_replace(text, " ", " \u2066")


def pf19_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three topics each document names: its source, its language, and the third word of the document before it."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.try_element_at(F.split("text", r"[\s.,!?]+"), F.lit(3)).alias("word"))
    topics = F.array_compact(F.array("source", "lang", "word"))
    return docs.join(before, "doc_id", "left").select("doc_id", F.array_join(F.filter(topics, lambda t: T.names_topic(F.col("text"), t)), "|").alias("named"))


PF19 = r"""
    WITH d AS (SELECT a.doc_id, lower(a.text) AS low, list_filter([a.source, a.lang, string_split_regex(b.text, '[\s.,!?]+')[3]], lambda t: t IS NOT NULL) AS topics FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1)
    SELECT doc_id, coalesce(array_to_string(list_filter(topics, lambda t: length(t) >= 2 AND CASE WHEN regexp_full_match(t, '[\x20-\x7e]+') THEN regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(lower(t)) || '($|[^a-z0-9])') ELSE contains(low, lower(t)) END), '|'), '') AS named FROM d
"""


def pf26_models(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as models, described by their types: those that are no general models, and the tier that the others' names hint at."""
    k = F.col("p_partkey") % 9
    name = F.concat("p_name", F.when(k == 0, "-embedding").when(k == 1, "_ultra.1").when(k == 2, "-Security").otherwise(""))
    told = F.concat_ws(" ", name, F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", models.excluded(told).alias("excluded"), models.tier_hint(told).alias("tier"))


PF26 = r"""
    WITH m AS (SELECT p_partkey, p_name || CASE p_partkey % 9 WHEN 0 THEN '-embedding' WHEN 1 THEN '_ultra.1' WHEN 2 THEN '-Security' ELSE '' END || ' ' || lower(p_type) AS told FROM part)
    SELECT p_partkey, p_partkey % 9 IN (0, 2) AS excluded, CASE WHEN p_partkey % 9 = 1 THEN 'large' WHEN regexp_matches(told, '(^|[^a-z])(small|economy)($|[^a-z])') THEN 'small' ELSE 'medium' END AS tier FROM m
"""

QUERIES = [
    per_row("tx01_normalise", "documents", "doc_id", {"digest": lambda t: F.sha2(T.collapse(t), 256)}, r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents"),
    Query("tx02_tokens", tx02_tokens, f"SELECT doc_id, len({D}) AS n, sha256(array_to_string(list_sort({D}), ' ')) AS digest FROM documents"),
    per_row("tx04_token_estimate", "documents", "doc_id", {"n": T.approx_tokens}, r"SELECT doc_id, ceil((length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / 4 + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / 1.3)::BIGINT AS n FROM documents"),
    per_row("tx05_truncate_slug", "documents", "doc_id", {"short": lambda t: T.truncate(F.regexp_replace(t, r"\s+", " "), 30), "slug": T.slug}, r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s+', ' ', 'g')) > 30 THEN substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 29) || '…' ELSE regexp_replace(text, '\s+', ' ', 'g') END AS short, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), ''), 'item') AS slug FROM documents"),
    per_row("tx05_sentences", "documents", "doc_id", {"n": lambda t: F.size(T.sentences(t))}, r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: length(trim(s)) > 0)) AS n FROM documents"),
    per_row("tx07_strip_invisible", "documents", "doc_id", {"digest": lambda t: F.sha2(T.strip_invisible(hidden_in(t)), 256)}, f"SELECT doc_id, sha256(regexp_replace(text, '[{X.INVISIBLE}]', '', 'g')) AS digest FROM documents"),
    per_row("tx09_canonical", "documents", "doc_id", {"digest": lambda t: F.sha2(T.canonical(t), 256), "negated": T.negated}, f"SELECT doc_id, sha256({CANON}) AS digest, regexp_matches(lower(text), '(^|[^a-z0-9_])(not|never|no|don''t|dont|without|avoid|stop)([^a-z0-9_]|$)') AS negated FROM documents"),
    per_row("tx09_key_terms", "documents", "doc_id", {"n": lambda t: F.size(T.key_terms(t))}, r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[._+#-][A-Za-z0-9]+)*[+#]*|\d+(?:\.\d+)*'), lambda x: lower(x)))) AS n FROM documents"),
    Query("tx10_same_rule", tx10_same_rule, TX10),
    per_row("tx13_error_excerpt", "documents", "doc_id", {"excerpt": lambda t: T.bound(T.error_excerpt(t), lambda x: F.sha2(F.coalesce(redact_secrets(x), F.lit("")), 256))}, TX13),
    per_row("pf18_path_hints", "pages", "page_id", {"hints": lambda t: F.array_join(T.path_hints(t), "|")}, r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(url, '[A-Za-z0-9_@.\-/]*/[A-Za-z0-9_@.\-/]+|[A-Za-z0-9_-]+\.[A-Za-z][A-Za-z0-9_]{0,7}\b'), lambda h: regexp_replace(h, '^[./]+', '')), lambda h: length(h) >= 3 AND NOT regexp_matches(h, '^\d+(\.\d+)*$')))), '|') AS hints FROM pages", "url"),
    Query("pf19_topic_named", pf19_topics, PF19),
    Query("pf26_model_exclusion", pf26_models, PF26),
    Query("ag15_document_frequency", ag15_document_frequency, f"SELECT tok, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / count(*)), 5) AS w FROM (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest({D}) AS tok FROM documents)) GROUP BY tok"),
    Query("ag16_weighted_overlap", ag16_weighted_overlap, AG16),
    Query("ag26_topic_frequency", ag26_topic_frequency, "SELECT doc_id, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY doc_id, word)) WHERE place <= 4"),
]
