"""Join-shaped queries: as-of, sequence pairing, anti, interval, containment, token joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import Query, sql_query, table
from . import asof, overlap


def jn04_reply_before(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return asof.nearest(events, "user_id", "ts", "event_id", value, "reply_id").select("event_id", "reply_id")


def jn05_request_and_reply(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    back = asof.nearest(events, "user_id", "ts", "event_id", F.when(F.col("event_type") == "view", F.col("event_id")), "request_id")
    both = asof.nearest(back, "user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "reply_id", forward=True)
    return both.filter("event_type = 'error'").select("event_id", "request_id", "reply_id")


def jn06_turn_pairing(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    turns = asof.pair_turns(events, "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return turns.select("user_id", F.col("prompt_tie").alias("prompt_id"), F.col("reply_tie").alias("reply_id"))


def jn17_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted token overlap of the query set with every document that shares a token with a query."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = overlap.covering(docs.select(F.col("doc_id").alias("id"), "text"), asked.select(F.col("item_id").alias("id"), "text"), 0.0, None)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("inter", 4).alias("inter"))


TOKENS = T.DUCK_TOKENS
JN17 = f"""
    WITH d AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS tok FROM documents)),
    q AS (SELECT DISTINCT item_id, tok FROM (SELECT item_id, unnest({TOKENS.format(c='text')}) AS tok FROM benchmark)),
    n AS (SELECT greatest(1, count(*)) AS n FROM documents),
    w AS (SELECT tok, ln(1 + n.n / count(*)) AS w FROM d, n GROUP BY tok, n.n)
    SELECT item_id, doc_id, round(sum(w), 4) AS inter FROM q JOIN d USING (tok) JOIN w USING (tok) GROUP BY item_id, doc_id
"""

QUERIES = [
    Query("jn04_reply_before", jn04_reply_before, "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reply_id FROM events"),
    Query("jn05_request_and_reply", jn05_request_and_reply, "SELECT event_id, request_id, reply_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS request_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reply_id FROM events) WHERE event_type = 'error'"),
    Query("jn06_turn_pairing", jn06_turn_pairing, "SELECT user_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS prompt_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS reply_id FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) WHERE turn > 0 GROUP BY user_id, turn"),
    Query("jn17_token_overlap", jn17_token_overlap, JN17),
    sql_query("jn01_supersede_edges", "SELECT s.o_orderkey AS source_id, t.o_orderkey AS target_id FROM (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM {orders}) s JOIN {orders} t ON s.supersedes = t.o_orderkey WHERE t.o_orderdate < s.o_orderdate OR (t.o_orderdate = s.o_orderdate AND t.o_orderkey < s.o_orderkey)"),
    sql_query("jn02_counters", "SELECT p.p_partkey, coalesce(s.reinforced, 0) AS reinforced, coalesce(s.violations, 0) AS violations FROM {part} p LEFT JOIN (SELECT l_partkey, count(*) AS reinforced, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS violations FROM {lineitem} GROUP BY l_partkey) s ON p.p_partkey = s.l_partkey"),
    sql_query("jn03_conflict_pairs", "SELECT DISTINCT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey"),
    sql_query("jn08_call_result", "SELECT o.o_orderkey AS call_id, l.lines, l.ok FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS lines, bool_and(l_returnflag <> 'R') AS ok FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey"),
    sql_query("jn09_orphan_counters", "SELECT DISTINCT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON l.doc_id = d.doc_id", "SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    sql_query("jn10_failure_counter", "SELECT o.o_orderkey, coalesce(r.n, 0) AS returns FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON o.o_orderkey = r.l_orderkey"),
    sql_query("jn11_ended_sessions", "SELECT s.user_id, s.ended, t.transcript FROM (SELECT user_id, max(ts) AS ended FROM {events} GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-10 00:00:00') s JOIN (SELECT user_id, max_by(event_id, struct(ts, event_id)) AS transcript FROM {events} WHERE event_type = 'click' GROUP BY user_id) t ON s.user_id = t.user_id WHERE t.transcript IS NOT NULL", "SELECT s.user_id, s.ended, t.transcript FROM (SELECT user_id, max(ts) AS ended FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-10 00:00:00') s JOIN (SELECT user_id, max_by(event_id, (ts, event_id)) AS transcript FROM events WHERE event_type = 'click' GROUP BY user_id) t ON s.user_id = t.user_id WHERE t.transcript IS NOT NULL"),
    sql_query("jn12_suppressed_turns", "SELECT c.conv_id, c.turn FROM {conversations} c LEFT ANTI JOIN (SELECT DISTINCT lower(trim(text)) AS t FROM {benchmark}) b ON lower(trim(c.text)) = b.t", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(trim(c.text)) = lower(trim(b.text)))"),
    sql_query("jn14_scope_globs", r"SELECT p.page_id, g.scope FROM {pages} p JOIN (SELECT * FROM VALUES ('^https?://[^/]*/(?:en|fr)/.*$'), ('^https://.*$'), ('^[^?]*[?]page=[0-9]+.*$') AS g(scope)) g ON p.url RLIKE g.scope", r"SELECT p.page_id, g.scope FROM pages p JOIN (VALUES ('^https?://[^/]*/(?:en|fr)/.*$'), ('^https://.*$'), ('^[^?]*[?]page=[0-9]+.*$')) g(scope) ON regexp_matches(p.url, g.scope)"),
    sql_query("jn16_interval_stabbing", "WITH s AS (SELECT l_orderkey AS f, l_linenumber AS lo, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS hi, l_partkey FROM {lineitem}) SELECT o.o_orderkey, max(s.lo) AS innermost FROM {orders} o JOIN s ON s.f = o.o_orderkey AND s.lo <= 3 AND s.hi >= 3 GROUP BY o.o_orderkey"),
    sql_query("jn20_containment", "SELECT m.l_suppkey AS struct_id, i.p_brand AS interface FROM (SELECT DISTINCT l_suppkey, p_brand, p_type FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) m JOIN (SELECT p_brand, p_type, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_type FROM {part})) i ON m.p_brand = i.p_brand AND m.p_type = i.p_type GROUP BY m.l_suppkey, i.p_brand, i.n HAVING count(DISTINCT m.p_type) = i.n"),
    sql_query("jn22_expected_existing", "SELECT coalesce(d.doc_id, l.doc_id) AS path, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'removed' WHEN l.quality = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id = l.doc_id"),
    sql_query("jn24_audit_log", "SELECT l.l_orderkey, l.l_linenumber, p.p_name AS summary, o.o_orderstatus AS status FROM {lineitem} l LEFT JOIN {part} p ON l.l_partkey = p.p_partkey LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey"),
    sql_query("jn25_conflict_partners", "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM {lineitem} UNION ALL SELECT l_suppkey AS a, l_partkey AS b FROM {lineitem}) JOIN {part} ON a = p_partkey"),
    # incremental synchronisation and set operations
    sql_query("sc11_pending_changes", "SELECT count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS added, count(CASE WHEN d.doc_id IS NULL THEN 1 END) AS removed, count(CASE WHEN d.doc_id = l.doc_id AND l.quality = 0 THEN 1 END) AS changed FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id = l.doc_id"),
    sql_query("sc13_latest_file_rows", "SELECT l_orderkey, l_linenumber, max_by(l_partkey, struct(l_shipdate, l_partkey)) AS part FROM {lineitem} GROUP BY l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber, max_by(l_partkey, (l_shipdate, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber"),
    sql_query("st01_union_of_sources", "SELECT kind, count(*) AS docs FROM (SELECT 'history' AS kind, text FROM {documents} UNION ALL SELECT 'turn', text FROM {conversations} UNION ALL SELECT 'case', props FROM {events} UNION ALL SELECT 'decision', text FROM {benchmark}) GROUP BY kind"),
    sql_query("st02_union_dedup_cap", "SELECT p_partkey, array_join(slice(array_union(split(p_name, ' '), array(p_brand, p_type)), 1, 8), ',') AS topics FROM {part}", "SELECT p_partkey, array_to_string(string_split(p_name, ' ') || [p_brand, p_type], ',') AS topics FROM part"),
    sql_query("st03_jaccard", "SELECT a.p_partkey AS l, b.p_partkey AS r, round(size(array_intersect(split(a.p_name, ' '), split(b.p_name, ' '))) / size(array_union(split(a.p_name, ' '), split(b.p_name, ' '))), 6) AS jaccard FROM {part} a JOIN {part} b ON a.p_partkey + 1 = b.p_partkey", "SELECT a.p_partkey AS l, b.p_partkey AS r, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(string_split(a.p_name, ' ') || string_split(b.p_name, ' '))), 6) AS jaccard FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey"),
    sql_query("st04_except", "SELECT p_partkey FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_discount > 0.08"),
    sql_query("st05_distinct_by_key", "SELECT p_brand, p_type, min(p_partkey) AS first FROM {part} GROUP BY p_brand, p_type"),
    sql_query("st06_tier_split", "SELECT bucket, count(*) AS rules FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'core' WHEN o_totalprice > 250000 THEN 'scoped' WHEN o_orderstatus = 'F' THEN 'on-demand' ELSE 'overflow' END AS bucket FROM {orders}) GROUP BY bucket"),
    sql_query("st07_union_missing_columns", "SELECT doc_id AS id, source, NULL AS quality FROM {documents} UNION ALL SELECT doc_id, NULL, quality FROM {labels}"),
]
