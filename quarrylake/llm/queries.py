"""The registered queries of this subpackage: each applies its operator to its whole table.

All of them read whole texts of any length, name the columns they need and leave others alone, whatever
these are called, and give no rows for an empty table.  What nulls, empty texts, ties and repeated rows
come to is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_anchors, bpe, chat_template, doc_fingerprint, exact_dedup, filter_audit, langid, packing, quality, ranked_search, simhash, suffix_dedup, token_scan
from .common import ascii_lower, id_in, id_out, read_table

#: End-of-document id of the vocabulary below.
SEPARATOR = 50_256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; a null or empty text has no ids, a null id stays null, repeated rows come as often as they are there."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by scanning token streams; a null or empty text has none, a null id stays null, repeated rows are counted each."""
    return token_scan.document_token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(), SEPARATOR)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one more, numbered -7.

    Turns that tie are in the order of role and text, repeated rows are turns of their own, null roles and
    texts are empty, rows without a conversation form one without an id.
    """
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    table = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_template.format_conversations(table.unionByName(extra))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint zero, null ids name a component only where no other id is in it, repeated rows come as often as they are there."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences; see ``pack_documents``."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of every document in sequences that hold no source and no text twice.

    ``docs`` has doc_id, text and source.  Clusters are exact copies (letter case apart); near copies would
    take a fingerprint of every text beside its tokens.  A null text is empty and takes one token, its
    separator; a null source meets any other; ties are packed in the order of id, source and cluster;
    repeated rows are packed each.
    """
    cluster = F.xxhash64(ascii_lower(F.coalesce("text", F.lit("")))).alias("cluster")
    sized = bpe.token_lengths(docs.select(id_in("doc_id"), "source", cluster, "text"), tokenizer_path(), keep=("doc_id", "source", "cluster"))
    return id_out(packing.pack(sized.withColumn("n_tokens", F.col("n_tokens") + 1), cluster=F.col("cluster")))  # one for the separator


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null, empty and letterless texts are ``und`` with score 0, equal scores go to the language that sorts first, a null id is in no held-out fold, repeated rows come as often as they are there."""
    docs = read_table(spark, sf_dir, "documents")
    third = langid.fold("doc_id", 3)
    out = langid.identify(docs, third != 1)
    return out.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that an earlier one has; a null text is empty, a null id comes before all others, rows of one id take nothing from each other, texts under 50 bytes lose nothing."""
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; a null text is empty, a null id comes after all others, rows of one id follow each other in descending order of a hash of their texts, each with a row of its own."""
    return doc_fingerprint.edit_sensitivity(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; null and empty texts are scored like others, a label given twice counts as the larger, a null id is in the held-out fold, repeated rows come as often as they are there."""
    out = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), langid.fold("doc_id", 5) != 0)
    return out.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal documents stays; a null text is empty, a null id loses to every other, of rows equal in id and text one stays."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; a null text has no terms, equal scores go by id, a null one first, repeated documents are ranked each, rows of one item are one."""
    return ranked_search.search(ranked_search.build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words of 20-word windows that occur earlier; a null text has no words, a null id comes before all others, rows of one id take nothing from each other."""
    out = block_anchors.remove_repeated_windows(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in every order; null texts and sources are empty, a null id is below all others and has no label, a document with several labels has all of them, repeated rows count each."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_chat_format, op4_simhash, op5_packing, op6_language_id, op7_suffix_dedup, op8_fingerprint, op9_quality, op10_exact_dedup, op11_ranked_search, op12_substring_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op10_exact_dedup": f"""
            WITH t AS (SELECT doc_id, sha256({lower}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
            FROM t WINDOW g AS (PARTITION BY text_sha256)
        """,
        "op11_ranked_search": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
                FROM documents),
            c AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
            t AS (SELECT doc_id, n, word, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS word FROM d) GROUP BY ALL),
            w AS (SELECT word, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY word, docs),
            q AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
                FROM benchmark),
            s AS (
                SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
                FROM q JOIN t USING (word) JOIN w USING (word), c GROUP BY ALL)
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
        """,
        "op12_substring_dedup": r"""
            WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            s AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS sequence FROM w, unnest(range(1, len(words) - 18)) r(i)),
            g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, i) > 1 AS later FROM s),
            p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
            c AS (SELECT doc_id, i, word, coalesce(bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN g USING (doc_id, i)),
            k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
        """,
        "op13_filter_audit": r"""
            WITH d AS (
                SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low,
                       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                       doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
                FROM documents),
            f AS (
                SELECT part, good, toxic, count(*) AS n,
                       CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                       || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
                       || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
                FROM d GROUP BY ALL),
            l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
            o AS (
                SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a, l b, l c, l e, l g
                WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
            s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS own, substr(filter_order, 1, step::INT - 1) AS before FROM o, range(1, 6) r(step)),
            m AS (
                SELECT part, filter_order, step, own, n, good, toxic, fails = own AS alone, contains(fails, own) AS failing, translate(fails, before, '') = fails AS reached
                FROM s, f),
            t AS (
                SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (reached AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND failing), 0)::BIGINT AS removed,
                       coalesce(sum(n) FILTER (failing AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                       coalesce(sum(n) FILTER (reached AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (reached AND failing AND toxic), 0)::BIGINT AS toxic_lost
                FROM m GROUP BY ALL)
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t
        """,
        "op3_chat_format": r"""
            WITH t AS (
                SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            e AS (
                SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped FROM t)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
                   sum(length('### ' || role || ': ' || escaped || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id
        """,
    }
