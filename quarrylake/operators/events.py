"""Event-store queries: scans, predicates, aggregates and queues over the append-only log.

``events`` stands for the hook log (session = user_id, kind = event_type: view is a prompt, purchase a
turn end, error a failed check), ``lineitem`` for the call log, ``orders`` for queue rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query, sql_query, table
from . import asof

K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def with_k(name: str, text: str, oracle: str | None = None):
    return sql_query(name, text.replace("$K", K), oracle and oracle.replace("$K", DUCK_K))


#: Events of the same session in the hour up to a row.
HOUR = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)"
AG23 = "SELECT event_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)"


def ag23_failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of a session since its last pass, at every event."""
    events = table(spark, sf, "events")
    return asof.streak(events, "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase", "streak").select("event_id", "streak")


QUERIES = [
    with_k("sc02_decode_events", "SELECT event_id, ts, user_id, event_type, $K AS k, event_type = 'purchase' AS candidate FROM {events}"),
    with_k("sc14_invalidate_for_limit", "SELECT doc_id, CASE WHEN n_chars > 4000 THEN '' ELSE sha2(text, 256) END AS hash FROM {documents}", "SELECT doc_id, CASE WHEN n_chars > 4000 THEN '' ELSE sha256(text) END AS hash FROM documents"),
    with_k("sc19_last_reply", "SELECT conv_id, max_by(text, turn) AS reply FROM {conversations} WHERE role = 'assistant' AND length(trim(text)) > 0 GROUP BY conv_id"),
    with_k("sc21_latest_run_per_command", "SELECT user_id, k, max_by(event_type, struct(ts, event_id)) AS outcome, max(ts) AS at FROM (SELECT *, $K AS k FROM {events} WHERE event_type IN ('error', 'purchase')) GROUP BY user_id, k", "SELECT user_id, k, max_by(event_type, (ts, event_id)) AS outcome, max(ts) AS at FROM (SELECT *, $K AS k FROM events WHERE event_type IN ('error', 'purchase')) GROUP BY user_id, k"),
    # predicates
    with_k("pf01_pending_events", "SELECT e.event_id, e.ts, coalesce(f.n, 0) AS failures FROM {events} e LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id) f ON e.user_id = f.user_id WHERE e.event_type = 'view' ORDER BY failures, e.ts, e.event_id LIMIT 50"),
    with_k("pf02_existence", "SELECT count(CASE WHEN event_type = 'error' THEN 1 END) > 0 AS has_errors, count(CASE WHEN event_type = 'refund' THEN 1 END) > 0 AS has_refunds FROM {events}"),
    with_k("pf03_time_window", "SELECT event_id, user_id, event_type FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'", None),
    with_k("pf04_null_safe_exclusion", "SELECT e.event_id FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS session FROM {events}) e WHERE session IS NULL OR session <> 3"),
    with_k("pf05_null_unsafe_exclusion", "SELECT e.event_id FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS session FROM {events}) e WHERE session <> 3"),
    with_k("pf06_in_lists", "SELECT l_returnflag, l_linestatus, count(*) AS calls FROM {lineitem} WHERE l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('O') GROUP BY l_returnflag, l_linestatus"),
    with_k("pf07_flag_membership", "SELECT event_id, array_contains(array(event_type, CASE WHEN value > 50 THEN 'large' ELSE 'small' END), 'large') AS flagged FROM {events}", "SELECT event_id, list_contains([event_type, CASE WHEN value > 50 THEN 'large' ELSE 'small' END], 'large') AS flagged FROM events"),
    with_k("pf08_key_prefix", "SELECT c_custkey, c_name FROM {customer} WHERE startswith(c_name, 'Customer#00000001')", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')"),
    with_k("pf09_ready_queue", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25"),
    with_k("pf10_deliverable", "SELECT o_orderkey, o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_totalprice < 400000 AS deliverable FROM {orders}"),
    with_k("pf11_escalated", "SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) >= 1 OR count(CASE WHEN event_type = 'click' THEN 1 END) >= 3 AS escalated, max(ts) < TIMESTAMP '2024-01-29 00:00:00' AS expired FROM {events} GROUP BY user_id"),
    with_k("pf17_extraction_due", "SELECT user_id, explicit > 0 OR (implicit > 0 AND (implicit >= 5 OR oldest <= TIMESTAMP '2024-01-29 23:00:00')) AS due FROM (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS explicit, count(CASE WHEN event_type = 'view' THEN 1 END) AS implicit, min(CASE WHEN event_type = 'view' THEN ts END) AS oldest FROM {events} GROUP BY user_id)"),
    with_k("pf25_authority", "SELECT source_kind, target_kind, a >= b AS may_override, CASE WHEN a >= 2 THEN 'active' ELSE 'proposed' END AS initial_status FROM (SELECT s.o_orderpriority AS source_kind, t.o_orderpriority AS target_kind, 6 - CAST(substr(s.o_orderpriority, 1, 1) AS INT) AS a, 6 - CAST(substr(t.o_orderpriority, 1, 1) AS INT) AS b FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}) s JOIN (SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}) t ON s.o_orderstatus = t.o_orderstatus)"),
    # aggregates
    with_k("ag01_pending_count", "SELECT count(*) AS pending FROM {events} WHERE event_type = 'view'"),
    with_k("ag02_pending_candidates", "SELECT count(CASE WHEN event_type = 'error' THEN 1 END) AS explicit, count(CASE WHEN event_type = 'view' THEN 1 END) AS implicit, min(CASE WHEN event_type = 'view' THEN ts END) AS oldest_implicit FROM {events}"),
    with_k("ag03_event_counts", "SELECT count(*) AS total, count(CASE WHEN event_type = 'view' THEN 1 END) AS pending, min(CASE WHEN event_type = 'view' THEN ts END) AS oldest FROM {events}"),
    with_k("ag04_session_span", "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(CASE WHEN event_type = 'view' THEN 1 END) AS prompts FROM {events} GROUP BY user_id"),
    with_k("ag05_last_times", "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_turn_end, max(ts) AS last_event FROM {events} GROUP BY user_id"),
    with_k("ag06_sessions_ended_after", "SELECT user_id, event_type, max(ts) AS ended FROM {events} GROUP BY user_id, event_type HAVING max(ts) > TIMESTAMP '2024-01-15 00:00:00' ORDER BY ended DESC, user_id, event_type LIMIT 200"),
    with_k("ag07_state_histogram", "SELECT count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open_turns, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done_turns, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS done_sessions FROM {orders}"),
    with_k("ag08_usage_summary", "SELECT l_returnflag AS provider, l_linestatus AS model, l_linenumber AS task, count(*) AS calls, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS ok, round(avg(l_quantity), 4) AS mean_ms, round(sum(l_extendedprice), 2) AS cost FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber", "SELECT l_returnflag AS provider, l_linestatus AS model, l_linenumber AS task, count(*) AS calls, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS ok, round(avg(l_quantity), 4) AS mean_ms, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY ALL"),
    Query("ag09_calls_in_sliding_hour", lambda s, sf: asof.rolling_count(table(s, sf, "events"), "user_id", "ts", "event_id", 1, "calls").select("event_id", "calls"), f"SELECT event_id, {HOUR} AS calls FROM events"),
    with_k("ag10_injection_summary", "SELECT count(*) AS rows_total, count(CASE WHEN value > 10 THEN 1 END) AS non_empty, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean_tokens, count(CASE WHEN event_type = 'signup' THEN 1 END) AS handoffs FROM {events}"),
    with_k("ag10_injections_per_item", "SELECT $K AS item, count(*) AS injections FROM {events} GROUP BY $K"),
    with_k("ag11_file_counts", "SELECT count(*) AS files, count(CASE WHEN length(html) > 0 THEN 1 END) AS parsed, count(CASE WHEN length(coalesce(html, '')) = 0 THEN 1 END) AS failed FROM {pages}"),
    with_k("ag12_failures_per_language", "SELECT lang, count(*) AS files, count(CASE WHEN n_chars < 200 THEN 1 END) AS bad, array_join(slice(array_sort(collect_list(CASE WHEN n_chars < 200 THEN doc_id END)), 1, 3), ',') AS first_bad FROM (SELECT lang, n_chars, doc_id, row_number() OVER (PARTITION BY lang, n_chars < 200 ORDER BY doc_id) AS r FROM {documents}) GROUP BY lang HAVING count(CASE WHEN n_chars < 200 THEN 1 END) > 0".replace("collect_list(CASE WHEN n_chars < 200 THEN doc_id END)", "collect_list(CASE WHEN n_chars < 200 AND r <= 3 THEN doc_id END)"), "SELECT lang, count(*) AS files, count(CASE WHEN n_chars < 200 THEN 1 END) AS bad, array_to_string(list_sort(list(doc_id) FILTER (WHERE n_chars < 200))[1:3], ',') AS first_bad FROM documents GROUP BY lang HAVING count(CASE WHEN n_chars < 200 THEN 1 END) > 0"),
    with_k("ag13_language_histogram", "SELECT lang, count(*) AS files FROM {documents} GROUP BY lang"),
    with_k("ag14_cheapest_per_model", "SELECT p_brand, min_by(p_partkey, struct(0.85 * p_retailprice + 0.15 * p_size, p_partkey)) AS model, min(round(0.85 * p_retailprice + 0.15 * p_size, 6)) AS blended FROM {part} GROUP BY p_brand", "SELECT p_brand, arg_min(p_partkey, (0.85 * p_retailprice + 0.15 * p_size, p_partkey)) AS model, min(round(0.85 * p_retailprice + 0.15 * p_size, 6)) AS blended FROM part GROUP BY p_brand"),
    with_k("ag18_symbols_per_directory", "SELECT p_brand AS directory, count(*) AS symbols FROM {part} GROUP BY p_brand ORDER BY symbols DESC, directory LIMIT 15"),
    with_k("ag19_hubs", "SELECT l_partkey AS symbol, count(*) AS in_degree FROM {lineitem} GROUP BY l_partkey ORDER BY in_degree DESC, symbol LIMIT 15"),
    with_k("ag19_hierarchies", "SELECT l_suppkey AS base, count(DISTINCT l_partkey) AS subtypes FROM {lineitem} GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 2 ORDER BY subtypes DESC, base LIMIT 10"),
    with_k("ag19_entry_points", "SELECT o.o_orderkey AS symbol FROM {orders} o LEFT ANTI JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey", "SELECT o.o_orderkey AS symbol FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"),
    with_k("ag20_turn_ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal FROM {conversations}"),
    with_k("ag21_group_by_scope", "SELECT scope, count(*) AS rules FROM (SELECT concat_ws('|', array_sort(array_distinct(array(p_brand, p_type)))) AS scope FROM {part}) GROUP BY scope", "SELECT scope, count(*) AS rules FROM (SELECT array_to_string(list_sort(list_distinct([p_brand, p_type])), '|') AS scope FROM part) GROUP BY scope"),
    with_k("ag22_status_groups", "SELECT CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'P' THEN 'proposed' ELSE 'retired' END AS bucket, count(*) AS rules FROM {orders} GROUP BY 1"),
    Query("ag23_failure_streak", ag23_failure_streak, AG23),
    with_k("ag24_mean_known_cost", "SELECT l_returnflag, round(avg(CASE WHEN l_tax > 0 THEN l_extendedprice END), 4) AS mean_cost FROM {lineitem} GROUP BY l_returnflag"),
    with_k("ag25_precision_recall", "SELECT round(sum(hit) / greatest(1, sum(picked)), 6) AS precision, round(sum(hit) / greatest(1, sum(relevant)), 6) AS recall FROM (SELECT CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS picked, l.quality AS relevant, CASE WHEN d.n_chars > 500 THEN l.quality ELSE 0 END AS hit FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id)"),
    # queues, counters, logs
    with_k("ad03_distinct_items_last_host", "SELECT user_id, count(DISTINCT $K) AS items, max_by(event_type, struct(ts, event_id)) AS last_host FROM {events} GROUP BY user_id", "SELECT user_id, count(DISTINCT $K) AS items, max_by(event_type, (ts, event_id)) AS last_host FROM events GROUP BY user_id"),
    with_k("ad04_failure_counters", "SELECT e.event_id, coalesce(f.n, 0) AS failures FROM {events} e LEFT JOIN (SELECT user_id, $K AS k, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id, $K) f ON e.user_id = f.user_id AND $EK = f.k WHERE e.event_type = 'view'".replace("$EK", "CAST(get_json_object(e.props, '$.k') AS BIGINT)"), "SELECT e.event_id, coalesce(f.n, 0) AS failures FROM events e LEFT JOIN (SELECT user_id, $K AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id, $K) f ON e.user_id = f.user_id AND CAST(json_extract_string(e.props, '$.k') AS BIGINT) = f.k WHERE e.event_type = 'view'"),
    with_k("ad09_index_status", "SELECT (SELECT count(*) FROM {pages}) AS files, (SELECT count(DISTINCT lang) FROM {documents}) AS languages, (SELECT sum(n_chars) FROM {documents}) AS size, (SELECT count(*) FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id) AS stale", "SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(DISTINCT lang) FROM documents) AS languages, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS size, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS stale"),
    with_k("ad11_switch_resolution", "SELECT d.doc_id, coalesce(CAST(l.quality AS INT), CASE WHEN d.source = 'src0' THEN 1 END, 0) AS enabled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"),
    with_k("ad14_suite_evaluation", "SELECT l_partkey AS model, bool_and(l_discount >= 0.02) AS passed, min(CASE WHEN l_discount < 0.02 THEN l_orderkey END) AS first_failing_run FROM {lineitem} GROUP BY l_partkey"),
    with_k("ad15_stale_anchors", "SELECT p.p_partkey, p.p_name, s.last_ship < TIMESTAMP '2001-01-01 00:00:00' AS stale FROM {part} p LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_partkey) s ON p.p_partkey = s.l_partkey"),
    # mutations as derived tables
    with_k("dm01_upsert", "SELECT user_id, event_type, max_by(value, struct(ts, event_id)) AS value, max(ts) AS version FROM {events} GROUP BY user_id, event_type", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS version FROM events GROUP BY user_id, event_type"),
    with_k("dm02_case_transitions", "SELECT user_id, k, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN ts END) >= max(CASE WHEN event_type = 'error' THEN ts END) THEN 'resolved' WHEN max(CASE WHEN event_type = 'error' THEN ts END) IS NOT NULL THEN 'failed' ELSE 'none' END AS state FROM (SELECT *, $K AS k FROM {events}) GROUP BY user_id, k"),
    with_k("dm03_timed_expiry", "SELECT event_id, CASE WHEN event_type <> 'view' THEN 'done' WHEN ts < TIMESTAMP '2024-01-29 12:00:00' THEN 'expired' ELSE 'open' END AS state FROM {events}"),
    with_k("dm04_retention", "SELECT event_id, ts FROM {events} WHERE NOT (ts < TIMESTAMP '2024-01-08 00:00:00' OR (event_type <> 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00'))"),
    with_k("dm05_purge_personal_text", "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN NULL ELSE text END AS text FROM {conversations}"),
    with_k("dm07_tombstones", "SELECT e.event_id FROM {events} e LEFT ANTI JOIN (SELECT user_id, max(ts) AS cut FROM {events} WHERE event_type = 'signup' GROUP BY user_id) t ON e.user_id = t.user_id AND e.ts <= t.cut", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, max(ts) AS cut FROM events WHERE event_type = 'signup' GROUP BY user_id) t WHERE e.user_id = t.user_id AND e.ts <= t.cut)"),
    # streaming-like, batch form
    with_k("sm07_session_gap", "SELECT user_id, session_window.start AS started, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '6 hours')", "SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, island"),
]
