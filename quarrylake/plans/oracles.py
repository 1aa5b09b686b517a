"""Second forms, in DuckDB's own idiom, of queries that Spark runs as plain SQL: the same question asked another way."""

from __future__ import annotations

K = "json_extract_string(props, '$.k')::BIGINT"

ORACLES = {
    "ad11_switch_resolution": "SELECT doc_id, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id), (source = 'src0')::INT, 0)::INT AS enabled FROM documents d",
    "ad14_suite_evaluation": "SELECT l_partkey AS model, count(*) FILTER (l_discount < 0.02) = 0 AS passed, min(l_orderkey) FILTER (l_discount < 0.02) AS first_failing_run FROM lineitem GROUP BY ALL",
    "ad15_stale_anchors": "SELECT p_partkey, p_name, (SELECT CASE WHEN count(*) > 0 THEN NOT bool_or(l_shipdate >= TIMESTAMP '2001-01-01') END FROM lineitem WHERE l_partkey = p_partkey) AS stale FROM part",
    "ag01_pending_count": "SELECT coalesce(sum((event_type = 'view')::INT), 0)::BIGINT AS pending FROM events",
    "ag02_pending_candidates": "SELECT count(*) FILTER (event_type = 'error') AS explicit, count(*) FILTER (event_type = 'view') AS implicit, (SELECT ts FROM events WHERE event_type = 'view' ORDER BY ts LIMIT 1) AS oldest_implicit FROM events",
    "ag03_event_counts": "SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS pending, (SELECT ts FROM events WHERE event_type = 'view' ORDER BY ts LIMIT 1) AS oldest FROM events",
    "ag04_session_span": "SELECT DISTINCT user_id, first_value(ts) OVER (PARTITION BY user_id ORDER BY ts) AS started, first_value(ts) OVER (PARTITION BY user_id ORDER BY ts DESC) AS ended, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS prompts FROM events",
    "ag05_last_times": "SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last_turn_end, arg_max(ts, ts) AS last_event FROM events GROUP BY ALL",
    "ag06_sessions_ended_after": "SELECT user_id, event_type, ts AS ended FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1 AND ts > TIMESTAMP '2024-01-15' ORDER BY ended DESC, user_id, event_type LIMIT 200",
    "ag07_state_histogram": "SELECT count(*) FILTER (o_orderstatus = 'O') AS open_turns, count(*) FILTER (o_orderstatus = 'F') AS done_turns, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)) AS done_sessions FROM orders",
    "ag10_injection_summary": "SELECT count(*) AS rows_total, count(*) FILTER (value > 10) AS non_empty, round(sum(value) FILTER (value > 10) / count(*) FILTER (value > 10), 6) AS mean_tokens, count(*) FILTER (event_type = 'signup') AS handoffs FROM events",
    "ag10_injections_per_item": f"SELECT DISTINCT {K} AS item, count(*) OVER (PARTITION BY {K}) AS injections FROM events",
    "ag11_file_counts": "SELECT count(*) AS files, count(*) FILTER (html <> '') AS parsed, count(*) - count(*) FILTER (html <> '') AS failed FROM pages",
    "ag13_language_histogram": "SELECT DISTINCT lang, count(*) OVER (PARTITION BY lang) AS files FROM documents",
    "ag18_symbols_per_directory": "SELECT DISTINCT p_brand AS directory, count(*) OVER (PARTITION BY p_brand) AS symbols FROM part ORDER BY symbols DESC, directory LIMIT 15",
    "ag19_hierarchies": "SELECT l_suppkey AS base, len(list(DISTINCT l_partkey)) AS subtypes FROM lineitem GROUP BY ALL HAVING min(l_partkey) <> max(l_partkey) ORDER BY subtypes DESC, base LIMIT 10",
    "ag19_hubs": "SELECT DISTINCT l_partkey AS symbol, count(*) OVER (PARTITION BY l_partkey) AS in_degree FROM lineitem ORDER BY in_degree DESC, symbol LIMIT 15",
    "ag20_turn_ordinal": "SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND (b.turn, b.role, b.text) <= (a.turn, a.role, a.text)) AS ordinal FROM conversations a",
    "ag22_status_groups": "SELECT b AS bucket, count(*) AS rules FROM orders JOIN (VALUES ('O', 'active'), ('P', 'proposed'), ('F', 'retired')) s(o_orderstatus, b) USING (o_orderstatus) GROUP BY ALL",
    "ag24_mean_known_cost": "SELECT l_returnflag, round(sum(l_extendedprice) FILTER (l_tax > 0) / count(*) FILTER (l_tax > 0), 4) AS mean_cost FROM lineitem GROUP BY ALL",
    "ag25_precision_recall": "WITH j AS (SELECT n_chars > 500 AS picked, quality = 1 AS relevant FROM documents JOIN labels USING (doc_id)) SELECT round(count(*) FILTER (picked AND relevant) / greatest(1, count(*) FILTER (picked)), 6) AS precision, round(count(*) FILTER (picked AND relevant) / greatest(1, count(*) FILTER (relevant)), 6) AS recall FROM j",
    "dm02_case_transitions": f"WITH l AS (SELECT user_id, {K} AS k, max(ts) FILTER (event_type = 'purchase') AS passed, max(ts) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2) SELECT user_id, k, CASE WHEN failed IS NULL THEN 'none' WHEN passed IS NULL OR passed < failed THEN 'failed' ELSE 'resolved' END AS state FROM l",
    "dm03_timed_expiry": "SELECT event_id, 'done' AS state FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, ['open', 'expired'][(ts < TIMESTAMP '2024-01-29 12:00:00')::INT + 1] FROM events WHERE event_type = 'view'",
    "dm04_retention": "SELECT event_id, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-08' UNION ALL SELECT event_id, ts FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-15'",
    "dm05_purge_personal_text": "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, role, NULL FROM conversations WHERE role = 'user'",
    "gr04_namespaced_index": "SELECT DISTINCT p_brand || '::' || p_name AS qname, count(*) OVER w AS declarations, first_value(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS first FROM part WINDOW w AS (PARTITION BY p_brand, p_name)",
    "jn01_supersede_edges": "SELECT o_orderkey AS source_id, (SELECT p.o_orderkey FROM orders p WHERE p.o_custkey = o.o_custkey AND (p.o_orderdate, p.o_orderkey) < (o.o_orderdate, o.o_orderkey) ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) AS target_id FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND (p.o_orderdate, p.o_orderkey) < (o.o_orderdate, o.o_orderkey))",
    "jn02_counters": "SELECT p_partkey, count(l_orderkey) AS reinforced, count(l_orderkey) FILTER (l_returnflag = 'R') AS violations FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL",
    "jn03_conflict_pairs": "WITH g AS (SELECT list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1), x AS (SELECT ids, unnest(ids) AS left_id FROM g) SELECT left_id, unnest(list_filter(ids, lambda i: i > left_id)) AS right_id FROM x",
    "jn08_call_result": "SELECT o_orderkey AS call_id, nullif(count(l_partkey), 0) AS lines, CASE WHEN count(l_partkey) > 0 THEN count(*) FILTER (l_returnflag = 'R') = 0 END AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "jn10_failure_counter": "SELECT o_orderkey, count(l_partkey) FILTER (l_returnflag = 'R') AS returns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "jn16_interval_stabbing": "SELECT o_orderkey, max(l_linenumber) FILTER (l_linenumber <= 3) AS innermost FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_linenumber) >= 3 AND min(l_linenumber) <= 3",
    "jn20_containment": "WITH i AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS need FROM part GROUP BY 1), m AS (SELECT l_suppkey, p_brand, list_sort(list(DISTINCT p_type)) AS have FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT l_suppkey AS struct_id, p_brand AS interface FROM m JOIN i USING (p_brand) WHERE have = need",
    "jn22_expected_existing": "SELECT doc_id AS path, 'new' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'removed' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, ['changed', 'unchanged'][quality + 1] FROM documents JOIN labels USING (doc_id)",
    "jn24_audit_log": "SELECT l_orderkey, l_linenumber, (SELECT p_name FROM part WHERE p_partkey = l_partkey) AS summary, (SELECT o_orderstatus FROM orders WHERE o_orderkey = l_orderkey) AS status FROM lineitem",
    "jn25_conflict_partners": "SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part)",
    "pf01_pending_events": "SELECT event_id, ts, failures FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS failures FROM events) WHERE event_type = 'view' ORDER BY failures, ts, event_id LIMIT 50",
    "pf02_existence": "SELECT EXISTS (FROM events WHERE event_type = 'error') AS has_errors, EXISTS (FROM events WHERE event_type = 'refund') AS has_refunds",
    "pf03_time_window": "SELECT event_id, user_id, event_type FROM events EXCEPT ALL SELECT event_id, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20'",
    "pf04_null_safe_exclusion": "SELECT event_id FROM events WHERE event_type = 'signup' OR user_id IS DISTINCT FROM 3",
    "pf05_null_unsafe_exclusion": "SELECT event_id FROM events WHERE NOT (event_type = 'signup' OR user_id = 3)",
    "pf06_in_lists": "SELECT l_returnflag, l_linestatus, count(*) AS calls FROM lineitem WHERE list_contains(['A', 'R'], l_returnflag) AND l_linestatus <> 'O' GROUP BY ALL",
    "pf09_ready_queue": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 25",
    "pf10_deliverable": "SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW') AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice < 400000) AS deliverable FROM orders",
    "pf11_escalated": "WITH c AS (SELECT user_id, list(event_type) AS kinds, list_max(list(ts)) AS last FROM events GROUP BY 1) SELECT user_id, list_contains(kinds, 'error') OR len(list_filter(kinds, lambda x: x = 'click')) >= 3 AS escalated, last < TIMESTAMP '2024-01-29' AS expired FROM c",
    "pf17_extraction_due": "WITH c AS (SELECT user_id, list(event_type) AS kinds, min(ts) FILTER (event_type = 'view') AS oldest FROM events GROUP BY 1) SELECT user_id, list_contains(kinds, 'error') OR len(list_filter(kinds, lambda x: x = 'view')) >= 5 OR coalesce(oldest <= TIMESTAMP '2024-01-29 23:00:00', false) AS due FROM c",
    "pf25_authority": "WITH p AS (SELECT DISTINCT o_orderpriority AS kind, o_orderstatus AS s, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS power FROM orders) SELECT a.kind AS source_kind, b.kind AS target_kind, a.power >= b.power AS may_override, CASE WHEN a.kind = '5-LOW' THEN 'proposed' ELSE 'active' END AS initial_status FROM p a JOIN p b USING (s)",
    "sc02_decode_events": "SELECT event_id, ts, user_id, event_type, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS k, event_type IN ('purchase') AS candidate FROM events",
    "sc11_pending_changes": "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS added, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS removed, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 0) AS changed",
    "sc15_stable_ids": "SELECT a.p_partkey, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND (b.p_name, b.p_partkey) <= (a.p_name, a.p_partkey))::INT AS local_id FROM part a",
    "sc19_last_reply": "SELECT conv_id, text AS reply FROM conversations WHERE role = 'assistant' AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "sc33_recent_errors": "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 20",
    "sm05_dedup_in_window": "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS window_start, min(event_id) OVER w AS first, count(*) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id, event_type, date_trunc('hour', ts))",
    "so01_score_threshold": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_totalprice >= 100000 QUALIFY place <= 3",
    "so04_neighbour_bonus": "WITH t AS (SELECT *, l_discount * 5 AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_linenumber, l_suppkey) <= 6) SELECT l_orderkey, l_partkey, l_linenumber, round(score + 0.2 * (l_returnflag = 'A')::INT, 6) AS final FROM t WHERE score >= 0.15",
    "st01_union_of_sources": "SELECT 'history' AS kind, (SELECT count(*) FROM documents) AS docs UNION ALL SELECT 'turn', (SELECT count(*) FROM conversations) UNION ALL SELECT 'case', (SELECT count(*) FROM events) UNION ALL SELECT 'decision', (SELECT count(*) FROM benchmark)",
    "st04_except": "SELECT DISTINCT p_partkey FROM part WHERE NOT EXISTS (FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.08)",
    "st05_distinct_by_key": "SELECT p_brand, p_type, p_partkey AS first FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1",
    "st06_tier_split": "WITH b AS (SELECT o_orderpriority = '1-URGENT' AS u, o_totalprice > 250000 AS d, o_orderstatus = 'F' AS f FROM orders) SELECT 'core' AS bucket, count(*) AS rules FROM b WHERE u HAVING count(*) > 0 UNION ALL SELECT 'scoped', count(*) FROM b WHERE NOT u AND d HAVING count(*) > 0 UNION ALL SELECT 'on-demand', count(*) FROM b WHERE NOT u AND NOT d AND f HAVING count(*) > 0 UNION ALL SELECT 'overflow', count(*) FROM b WHERE NOT (u OR d OR f) HAVING count(*) > 0",
    "st07_union_missing_columns": "SELECT doc_id AS id, source, NULL::BIGINT AS quality FROM documents UNION ALL BY NAME SELECT doc_id AS id, quality FROM labels",
    "wn03_first_and_last_prompts": "WITH v AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events WHERE event_type = 'view' GROUP BY 1), x AS (SELECT user_id, len(ids) AS n, unnest(ids) AS event_id, generate_subscripts(ids, 1) AS place FROM v) SELECT user_id, event_id, place AS first_place, n - place + 1 AS last_place FROM x WHERE place <= 3 OR n - place < 3",
    "wn07_seniority": "WITH l AS (SELECT a.o_orderkey AS a, max(b.o_orderkey) AS b FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY 1) SELECT a AS younger, b AS elder FROM l JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b WHERE y.o_orderdate <= x.o_orderdate",
    "wn10_core_priority": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (ORDER BY o_orderpriority <> '1-URGENT', o_totalprice DESC, o_orderdate DESC, o_orderkey) <= 40",
    "wn12_recent_supersedes": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders o WHERE EXISTS (FROM orders p WHERE p.o_custkey = o.o_custkey AND (p.o_orderdate, p.o_orderkey) < (o.o_orderdate, o.o_orderkey) AND p.o_orderdate >= o.o_orderdate - INTERVAL '7 days') ORDER BY o_orderdate DESC, o_orderkey LIMIT 5",
}
