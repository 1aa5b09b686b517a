"""What people decide by command: proposals confirmed or dropped, conflicts settled, payloads of hooks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import normalised
from ..lineage import checkpointed
from ..plans.query import Query, table


def known_ends(commands: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, affix, id): the beginnings and ends of items in small letters, of the lengths that commands have, which are few."""
    sizes = commands.filter(F.length("affix") > 0).select("kind", F.length("affix").alias("size")).distinct()
    sized = items.select("id", "kind", F.lower("id").alias("low")).join(sizes, "kind").filter(F.length("low") >= F.col("size"))
    ends = F.array_distinct(F.array(F.left("low", F.col("size")), F.right("low", F.col("size"))))
    return sized.select("kind", F.explode(ends).alias("affix"), "id")


def by_affix(commands: DataFrame, items: DataFrame) -> DataFrame:
    """(n, hits, id): of the items of a command's kind whose id begins or ends with its affix, in any case, how many there are and the least.

    Both sides meet by equal text.  Items are counted by their ends before commands are looked at, so a short
    affix of many commands that names many items makes no pairs.  ``commands`` has n, kind and affix, ``items``
    id and kind.
    """
    asked = commands.filter(F.length("affix") > 0).select("n", "kind", F.lower("affix").alias("affix"))
    counted = known_ends(commands, items).groupBy("kind", "affix").agg(F.count("*").alias("hits"), F.min("id").alias("id"))
    return asked.join(counted, ["kind", "affix"]).groupBy("n").agg(F.sum("hits").alias("hits"), F.min("id").alias("id"))


def decide(commands: DataFrame, items: DataFrame) -> DataFrame:
    """(n, outcome, id, replaced): what each command comes to.

    ``commands`` has n, action (approve, discard, resolve) and affix; ``items`` id, status, local, held,
    conflict_with.  Approving and discarding look among local proposals, resolving among rules in conflict.
    An affix that names none or several decides nothing; a proposal that is held cannot be approved.
    Resolving replaces the rule and the live ones it is in conflict with, whichever side says so.
    """
    items = checkpointed(items)
    kind = F.when(F.col("action") == "resolve", "conflict").otherwise("proposal")
    own = F.when(F.col("local"), "proposal").when(F.col("status") == "conflict", "conflict")
    one = by_affix(commands.withColumn("kind", kind), items.withColumn("kind", own).filter("kind IS NOT NULL"))
    told = commands.join(one, "n", "left").join(items.select("id", "held"), "id", "left")
    live = items.filter("NOT local AND status IN ('active', 'conflict')").select(F.col("id").alias("other"))
    links = items.filter("NOT local AND status = 'conflict'").select("id", F.explode("conflict_with").alias("other"))
    both = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().filter("id <> other").join(live, "other", "left_semi")
    partners = both.groupBy("id").agg(F.collect_set("other").alias("partners"))
    outcome = (
        F.when(F.coalesce("hits", F.lit(0)) == 0, "none").when(F.col("hits") > 1, "several").when((F.col("action") == "approve") & F.col("held"), "held")
        .when(F.col("action") == "approve", "approved").when(F.col("action") == "discard", "discarded").otherwise("resolved")
    )
    told = told.withColumn("outcome", outcome).join(partners, "id", "left")
    replaced = F.when(F.col("outcome") == "resolved", F.array_join(F.array_sort(F.concat(F.array("id"), F.coalesce("partners", F.array().cast("array<string>")))), ",")).otherwise("")
    return told.select("n", "outcome", F.when(F.col("hits") == 1, F.col("id")).alias("id"), replaced.alias("replaced"))


def er07_decided(spark: SparkSession, sf: str) -> DataFrame:
    """Commands of customers on orders as rules, by beginnings and ends of different lengths."""
    k = F.col("o_orderkey")
    ident = lambda x: F.concat(F.lit("R"), F.lpad(x.cast("string"), 9, "0"))
    partner = F.when(k % 17 == 0, F.array(ident(k + 1))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("o_orderstatus") == "P", "proposed").when(k % 17 < 2, "conflict").otherwise("active")
    items = table(spark, sf, "orders").select(ident(k).alias("id"), status.alias("status"), (F.col("o_orderstatus") == "P").alias("local"), (k % 10 == 0).alias("held"), partner.alias("conflict_with"))
    c = F.col("c_custkey")
    action = F.element_at(F.array(*map(F.lit, ("approve", "discard", "resolve"))), (c % 3 + 1).cast("int"))
    number = F.lpad((c * 7 % 1000).cast("string"), 3, "0")
    affix = F.when(c % 4 == 0, F.lower(ident(c))).when(c % 4 == 1, F.lpad((c * 3).cast("string"), 6, "0")).when(c % 4 == 2, number).otherwise("")
    return decide(table(spark, sf, "customer").select(c.alias("n"), action.alias("action"), affix.alias("affix")), items)


ER07 = """
    WITH i AS (SELECT 'R' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, CASE WHEN o_orderstatus = 'P' THEN 'proposed' WHEN o_orderkey % 17 < 2 THEN 'conflict' ELSE 'active' END AS status, o_orderkey % 10 = 0 AS held, CASE WHEN o_orderkey % 17 = 0 THEN 'R' || lpad((o_orderkey + 1)::VARCHAR, 9, '0') END AS other FROM orders),
    c AS (SELECT c_custkey AS n, ['approve', 'discard', 'resolve'][c_custkey % 3 + 1] AS action, CASE c_custkey % 4 WHEN 0 THEN 'r' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN lpad((c_custkey * 3)::VARCHAR, 6, '0') WHEN 2 THEN lpad((c_custkey * 7 % 1000)::VARCHAR, 3, '0') ELSE '' END AS affix FROM customer),
    h AS (SELECT n, any_value(action) AS action, count(id) AS hits, min(id) AS id, bool_or(held) AS held FROM c LEFT JOIN i ON affix <> '' AND status = CASE WHEN action = 'resolve' THEN 'conflict' ELSE 'proposed' END AND (starts_with(lower(id), affix) OR ends_with(lower(id), affix)) GROUP BY n),
    l AS (SELECT id, other FROM i WHERE status = 'conflict' AND other IS NOT NULL UNION SELECT other, id FROM i WHERE status = 'conflict' AND other IS NOT NULL),
    p AS (SELECT l.id, list_sort(list(DISTINCT l.other)) AS partners FROM l JOIN i x ON x.id = l.other AND x.status IN ('active', 'conflict') GROUP BY l.id),
    o AS (SELECT *, CASE WHEN hits = 0 THEN 'none' WHEN hits > 1 THEN 'several' WHEN action = 'approve' AND held THEN 'held' WHEN action = 'approve' THEN 'approved' WHEN action = 'discard' THEN 'discarded' ELSE 'resolved' END AS outcome FROM h)
    SELECT n, outcome, CASE WHEN hits = 1 THEN o.id END AS id, CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort([o.id] || coalesce(partners, [])), ',') ELSE '' END AS replaced FROM o LEFT JOIN p ON p.id = o.id
"""


def sc30_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the payloads of five tools, each with its own names of fields, read as one shape; some run inside another host."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    form = (n % 5).cast("int")
    tool = F.element_at(F.array(*map(F.lit, ("claude", "copilot", "cursor", "kiro", "codex"))), form + 1)
    kind = F.when(F.col("event_type") == "view", "prompt").when(F.col("event_type") == "purchase", "turn_end").when(F.col("event_type") == "signup", "session_start").otherwise("other")
    session, said = F.concat(F.lit("s"), "user_id"), F.concat(F.lit('say "it" '), n)
    shapes = (
        F.to_json(F.struct(session.alias("session_id"), F.lit("/repo").alias("cwd"), said.alias("prompt"), said.alias("last_assistant_message"), F.lit("startup").alias("source"), F.lit("t.jsonl").alias("transcript_path"), F.lit("big").alias("model"))),
        F.to_json(F.struct(session.alias("sessionId"), F.lit("").alias("cwd"), said.alias("prompt"), said.alias("lastAssistantMessage"), F.lit("new").alias("trigger"), F.lit("t.json").alias("transcriptPath"), F.lit("small").alias("model_id"))),
        F.to_json(F.struct(session.alias("conversation_id"), F.array(F.lit("/root1"), F.lit("/root2")).alias("workspace_roots"), said.alias("user_prompt"), F.lit("2.1").alias("cursor_version"))),
        F.to_json(F.struct(F.lit(7).alias("session_id"), F.lit("/kiro").alias("cwd"), F.lit("").alias("prompt"))),
        F.when(n % 2 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(session.alias("session_id"), F.lit("9").alias("cursor_version")))),
    )
    payload = F.element_at(F.array(*shapes), form + 1)
    env = F.when(form == 3, F.to_json(F.struct(said.alias("USER_PROMPT")))).when(form == 1, F.to_json(F.struct(F.lit("/project").alias("CLAUDE_PROJECT_DIR")))).otherwise("{}")
    return e.select("event_id", normalised(tool, kind, payload, env).alias("x")).select("event_id", "x.*")


SC30 = """
    WITH e AS (SELECT event_id, event_id % 5 AS f, event_id % 5 = 4 AND event_id % 2 = 0 AS broken, 's' || user_id AS s, 'say "it" ' || event_id AS said, event_type AS k FROM events)
    SELECT event_id, CASE f WHEN 0 THEN 'claude' WHEN 1 THEN 'copilot' WHEN 2 THEN 'cursor' WHEN 3 THEN 'kiro' ELSE CASE WHEN broken THEN 'codex' ELSE 'cursor' END END AS host, CASE WHEN f = 3 OR broken THEN NULL ELSE s END AS session,
        ['/repo', '/project', '/root1', '/kiro', NULL][f + 1] AS cwd, ['t.jsonl', 't.json', NULL, NULL, NULL][f + 1] AS transcript, ['big', 'small', NULL, NULL, NULL][f + 1] AS model, CASE WHEN k = 'view' AND f < 4 THEN said END AS prompt,
        CASE WHEN k = 'purchase' AND f < 2 THEN said END AS last_assistant, CASE WHEN k = 'signup' THEN ['startup', 'new', NULL, NULL, NULL][f + 1] END AS source, f = 4 AND NOT broken AS skip FROM e
"""

QUERIES = [Query("er07_lookup_by_affix", er07_decided, ER07), Query("sc30_normalise_payload", sc30_payloads, SC30)]
