"""The rule book: status from links, tiers under budgets, selection for a prompt, verdicts on candidates.

Orders stand for rules, each customer's orders for the rules of one repository; documents are the pool
that prompts (the benchmark texts) are matched with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import prompts as prompts_
from ..functions import text as T
from ..functions.globs import path_regex
from ..functions.signals import column, is_file_path, path_hints
from ..plans.query import Query, table
from . import asof, overlap
from .codegraph import ancestors, prefixes, union
from .graph import checkpointed, live_heads

LIVE = ("active", "proposed", "conflict")

# ---- status from links ---------------------------------------------------------------------------


def supersede_edges(rules: DataFrame) -> DataFrame:
    """(src, dst, src_at, dst_at): links to older rules; a link to a newer one or to nothing does not count."""
    place = F.struct("captured", "id")
    links = rules.select(F.col("id").alias("src"), place.alias("src_at"), F.explode("supersedes").alias("dst"))
    olds = rules.select(F.col("id").alias("dst"), place.alias("dst_at"))
    return links.join(olds, "dst").filter("dst_at < src_at").select("src", "dst", "src_at", "dst_at").distinct()


def first_texts(rows: DataFrame) -> DataFrame:
    """(id, superseded_by): copies of a text that give way; ``rows`` has key, captured, id, status, superseded_by, lineage.

    ``lineage`` holds the rule's ancestors with the same text.  The first rule of a text stands and a
    copy gives way to it, or to what has replaced it; a rule that restates a text of its own ancestors
    takes over instead.  Keys are streamed in the order of their rules.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first = None, None  # of the first: id, status, superseded_by
        for batch in batches:
            out = []
            for k, i, status, by, lineage in zip(batch["key"], batch["id"].tolist(), batch["status"], batch["superseded_by"], batch["lineage"], strict=True):
                by = None if pd.isna(by) else int(by)
                if k != key:
                    key, first = k, (i, status, by)
                elif status == "active" and lineage is not None and len(lineage):
                    if first[1] == "active" and first[0] not in set(lineage):
                        out.append((first[0], i))
                    first = (i, status, by)
                elif status == "active":
                    out.append((i, first[2] if first[1] == "superseded" and first[2] is not None else first[0]))
            yield pd.DataFrame(out, columns=["id", "superseded_by"], dtype="int64")

    dealt = rows.repartition("key").sortWithinPartitions("key", "captured", "id")
    return dealt.select("key", "id", "status", "superseded_by", "lineage").mapInPandas(run, "id long, superseded_by long")


def same_key_ancestors(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ancestor): what a rule replaces, directly or through others, and has the same text.

    Walks start only from rules whose text there is an older one of, carry the text along, and go no
    further back than its oldest rule.
    """
    place = F.struct("captured", "id")
    oldest = rules.groupBy("text_key").agg(F.min(place).alias("floor"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = checkpointed(rules.select("id", "text_key", place.alias("at")).join(oldest, "text_key"))
    seeds = keyed.filter("at > floor").select(F.col("id").alias("node"), "floor")
    walked = ancestors(edges.select("src", "dst", "dst_at"), seeds)
    own = keyed.select(F.col("id").alias("node"), "text_key")
    return walked.join(own, "node").join(keyed.select(F.col("id").alias("ancestor"), "text_key"), ["ancestor", "text_key"]).select(F.col("node").alias("id"), "ancestor")


def conflicting_heads(pairs: DataFrame, nodes: DataFrame, onward: DataFrame) -> DataFrame:
    """(a, b): conflicts carried to the live versions of both sides, in both directions.

    ``pairs`` has a and b, ``nodes`` id and status, ``onward`` leads from a replaced rule to what replaced
    it.  Sides that arrive at the same rule, at none, or at a mere proposal are settled.
    """
    live = nodes.filter(F.col("status").isin(*LIVE)).select(F.col("id").alias("node"))
    heads = live_heads(onward, live).unionByName(live.select("node", F.col("node").alias("head"))).distinct()
    real = heads.join(nodes.filter("status <> 'proposed'").select(F.col("id").alias("head")), "head", "left_semi").select("node", "head")
    both = pairs.join(real.toDF("a", "x"), "a").join(real.toDF("b", "y"), "b").filter("x <> y")
    return both.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(both.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()


def conflict_pairs(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): explicit links, and rules that replaced the same one unless one of them replaces the other."""
    named = rules.select(F.col("id").alias("a"), F.explode("conflict_with").alias("b")).filter("a <> b").join(rules.select(F.col("id").alias("b")), "b", "left_semi")
    mates = edges.select("dst", F.col("src").alias("a"), F.col("src_at").alias("at")).join(edges.select("dst", F.col("src").alias("b"), F.col("src_at").alias("bt")), "dst").filter("at < bt").select("a", "b")
    direct = rules.select(F.col("id").alias("x"), F.explode("supersedes").alias("y"))
    pair = direct.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()
    mates = mates.join(pair, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")
    return named.select("a", "b").unionByName(mates).distinct()


def derive_status(rules: DataFrame, day: str, proposed_days: int) -> DataFrame:
    """(id, status, superseded_by, archived, conflict_with, needs_review): what the links make of each rule.

    ``rules`` has id, captured, status, text_key, valid_until, reinforced, supersedes, conflict_with, review.
    Phases, each reading what the one before left: replacement, copies of a text, end dates and old
    proposals, conflicts between live versions, rules to be checked again.
    """
    rules = checkpointed(rules)
    edges = checkpointed(supersede_edges(rules))
    first = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src_at")["id"].alias("by"))
    one = rules.join(first, "id", "left").withColumn("superseded_by", F.when(F.col("status") != "retired", F.col("by")))
    one = checkpointed(one.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status"))).drop("by"))
    lineage = same_key_ancestors(rules, edges).groupBy("id").agg(F.collect_set("ancestor").alias("lineage"))
    standing = one.filter("status in ('active', 'superseded')").join(lineage, "id", "left").withColumnRenamed("text_key", "key")
    copies = first_texts(standing).withColumnRenamed("superseded_by", "copy_of")
    two = one.join(copies, "id", "left").withColumn("superseded_by", F.coalesce("copy_of", "superseded_by")).withColumn("status", F.when(F.col("copy_of").isNotNull(), "superseded").otherwise(F.col("status")))
    today = F.lit(day).cast("date")
    over = F.col("status").isin(*LIVE) & (F.col("valid_until") < today)
    old = (F.col("status") == "proposed") & (F.col("reinforced") == 0) & (F.col("captured") < F.date_sub(today, proposed_days).cast("timestamp_ntz")) & ~F.coalesce(over, F.lit(False))
    three = checkpointed(two.withColumn("archived", F.coalesce(old, F.lit(False))).withColumn("status", F.when(F.coalesce(over, F.lit(False)) | F.col("archived"), "retired").otherwise(F.col("status"))))
    onward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(three.filter("status = 'superseded'").select(F.col("id").alias("src")), "src", "left_semi")
    onward = onward.unionByName(three.filter("status = 'superseded' AND superseded_by IS NOT NULL").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"))).distinct()
    partners = conflicting_heads(conflict_pairs(rules, edges), three.select("id", "status"), onward).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("partners"))
    four = three.join(partners, "id", "left").withColumn("status", F.when(F.col("partners").isNotNull(), "conflict").when(F.col("status") == "conflict", "active").otherwise(F.col("status")))
    four = checkpointed(four)
    asked = four.filter(F.col("status").isin(*LIVE)).select(F.struct("captured", "id").alias("asks_at"), F.explode("review").alias("id"))
    due = four.filter("status = 'active'").select("id", F.struct("captured", "id").alias("at")).join(asked, "id").filter("at < asks_at").select("id", F.lit(True).alias("due")).distinct()
    done = four.join(due, "id", "left")
    return done.select("id", "status", "superseded_by", "archived", F.array_join(F.coalesce("partners", F.array().cast("array<long>")).cast("array<string>"), ",").alias("conflict_with"), F.coalesce("due", F.lit(False)).alias("needs_review"))


#: Orders as rules in both engines; {list} and {date} are what differs.
RULES = """
    SELECT o_orderkey AS id, o_orderdate AS captured, CASE WHEN o_orderstatus = 'P' THEN 'proposed' WHEN o_orderkey % 17 = 0 THEN 'conflict' ELSE 'active' END AS status,
        concat(o_custkey, '/', CASE WHEN o_orderkey % 5 < 2 THEN 'common' ELSE concat('own', o_orderkey) END) AS text_key,
        CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate + INTERVAL '900' DAY AS DATE) END AS valid_until, o_orderkey % 3 AS reinforced, o_custkey AS pool,
        CASE WHEN o_orderpriority = '1-URGENT' THEN before1 WHEN o_orderpriority = '2-HIGH' THEN before2 END AS replaces, CASE WHEN o_orderpriority = '3-MEDIUM' THEN after1 END AS contradicts,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN before1 END AS asks
    FROM (SELECT *, lag(o_orderkey) OVER w AS before1, lag(o_orderkey, 2) OVER w AS before2, lead(o_orderkey) OVER w AS after1 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
"""


def order_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(RULES, orders=table(spark, sf, "orders"))
    none = F.array().cast("array<long>")
    single = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)
    return rows.select("id", "captured", "status", "text_key", "valid_until", "reinforced", "pool", single("replaces").alias("supersedes"), single("contradicts").alias("conflict_with"), single("asks").alias("review"))


DAY, TTL = "2000-06-01", 365
#: All phases as one query; copies of a text are followed rule by rule.
STATUS = f"""
    WITH RECURSIVE r0 AS ({RULES.replace('{orders}', 'orders')}), r AS (SELECT *, row_number() OVER (ORDER BY captured, id) AS rn FROM r0),
    e AS (SELECT s.id AS s, t.id AS t, s.rn FROM r s JOIN r t ON s.replaces = t.id WHERE t.rn < s.rn),
    fb AS (SELECT t AS id, arg_min(s, rn) AS "by" FROM e GROUP BY t),
    s1 AS (SELECT r.*, fb."by" AS by1, CASE WHEN fb."by" IS NOT NULL THEN 'superseded' ELSE status END AS st1 FROM r LEFT JOIN fb USING (id)),
    anc AS (SELECT s AS node, t AS up FROM e UNION SELECT anc.node, e.t FROM anc JOIN e ON e.s = anc.up),
    lin AS (SELECT node AS id, list(up) AS lineage FROM anc JOIN r a ON a.id = node JOIN r b ON b.id = up WHERE a.text_key = b.text_key GROUP BY node),
    k AS (SELECT s1.id, text_key, st1, by1, coalesce(lineage, []) AS lineage, row_number() OVER (PARTITION BY text_key ORDER BY rn) AS n FROM s1 LEFT JOIN lin USING (id) WHERE st1 IN ('active', 'superseded')),
    f AS (
        SELECT text_key, n, id AS fid, st1 AS fst, by1 AS fby, NULL::BIGINT AS cid, NULL::BIGINT AS cby FROM k WHERE n = 1
        UNION ALL
        SELECT k.text_key, k.n, CASE WHEN k.st1 = 'active' AND len(k.lineage) > 0 THEN k.id ELSE f.fid END, CASE WHEN k.st1 = 'active' AND len(k.lineage) > 0 THEN 'active' ELSE f.fst END, CASE WHEN k.st1 = 'active' AND len(k.lineage) > 0 THEN k.by1 ELSE f.fby END,
            CASE WHEN k.st1 <> 'active' THEN NULL WHEN len(k.lineage) > 0 THEN CASE WHEN f.fst = 'active' AND NOT list_contains(k.lineage, f.fid) THEN f.fid END ELSE k.id END,
            CASE WHEN k.st1 <> 'active' THEN NULL WHEN len(k.lineage) > 0 THEN k.id ELSE CASE WHEN f.fst = 'superseded' AND f.fby IS NOT NULL THEN f.fby ELSE f.fid END END
        FROM f JOIN k ON k.text_key = f.text_key AND k.n = f.n + 1),
    s2 AS (SELECT s1.*, coalesce(cby, by1) AS by2, CASE WHEN cid IS NOT NULL THEN 'superseded' ELSE st1 END AS st2 FROM s1 LEFT JOIN f ON f.cid = s1.id),
    s3 AS (
        SELECT *, st2 = 'proposed' AND reinforced = 0 AND captured < DATE '{DAY}' - INTERVAL '{TTL}' DAY AND NOT coalesce(valid_until < DATE '{DAY}', false) AS archived,
            CASE WHEN st2 IN ('active', 'proposed', 'conflict') AND valid_until < DATE '{DAY}' THEN 'retired' WHEN st2 = 'proposed' AND reinforced = 0 AND captured < DATE '{DAY}' - INTERVAL '{TTL}' DAY THEN 'retired' ELSE st2 END AS st3 FROM s2),
    nx AS (SELECT e.t AS src, e.s AS dst FROM e JOIN s3 ON s3.id = e.t AND st3 = 'superseded' UNION SELECT id, by2 FROM s3 WHERE st3 = 'superseded' AND by2 IS NOT NULL),
    w AS (SELECT id AS node, id AS here FROM s3 UNION SELECT w.node, nx.dst FROM w JOIN nx ON nx.src = w.here),
    h AS (SELECT w.node, w.here AS head FROM w JOIN s3 ON s3.id = w.here WHERE st3 IN ('active', 'conflict')),
    pr AS (
        SELECT id AS a, contradicts AS b FROM r WHERE contradicts IS NOT NULL
        UNION SELECT x.s, y.s FROM e x JOIN e y ON x.t = y.t AND x.rn < y.rn WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.id = x.s AND r.replaces = y.s) OR (r.id = y.s AND r.replaces = x.s))),
    cf AS (SELECT x.head AS a, y.head AS b FROM pr JOIN h x ON x.node = pr.a JOIN h y ON y.node = pr.b WHERE x.head <> y.head),
    pt AS (SELECT a AS id, list_sort(list(DISTINCT b)) AS partners FROM (SELECT a, b FROM cf UNION SELECT b, a FROM cf) GROUP BY a),
    s4 AS (SELECT s3.*, partners, CASE WHEN partners IS NOT NULL THEN 'conflict' WHEN st3 = 'conflict' THEN 'active' ELSE st3 END AS st4 FROM s3 LEFT JOIN pt USING (id))
"""
GR28 = f"{STATUS} SELECT id, st4 AS status, by2 AS superseded_by, archived, coalesce(array_to_string(partners, ','), '') AS conflict_with, st4 = 'active' AND EXISTS (SELECT 1 FROM s4 q WHERE q.asks = s4.id AND q.st4 IN ('active', 'proposed', 'conflict') AND q.rn > s4.rn) AS needs_review FROM s4"


def gr28_status(spark: SparkSession, sf: str) -> DataFrame:
    return derive_status(order_rules(spark, sf), DAY, TTL)


def gr25_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """How many rules each rule replaces, directly and through others, and the oldest of them."""
    return ancestors(supersede_edges(order_rules(spark, sf))).groupBy("node").agg(F.count("*").alias("ancestors"), F.min("ancestor").alias("least"))


GR25 = f"{STATUS} SELECT node, count(*) AS ancestors, min(up) AS least FROM anc GROUP BY node"


def gr27_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of the order rules carried to the live versions of both sides; replacement alone decides what is live."""
    rules = checkpointed(order_rules(spark, sf))
    edges = checkpointed(supersede_edges(rules))
    gone = edges.select(F.col("dst").alias("id"), F.lit("superseded").alias("gone")).distinct()
    nodes = rules.join(gone, "id", "left").select("id", F.coalesce("gone", "status").alias("status"))
    return conflicting_heads(conflict_pairs(rules, edges), nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


GR27 = f"""
    WITH RECURSIVE r0 AS ({RULES.replace('{orders}', 'orders')}), r AS (SELECT *, row_number() OVER (ORDER BY captured, id) AS rn FROM r0), e AS (SELECT s.id AS s, t.id AS t, s.rn FROM r s JOIN r t ON s.replaces = t.id WHERE t.rn < s.rn),
    w AS (SELECT id AS node, id AS here FROM r UNION SELECT w.node, e.s FROM w JOIN e ON e.t = w.here), h AS (SELECT node, here AS head FROM w JOIN r ON r.id = here WHERE status <> 'proposed' AND NOT EXISTS (SELECT 1 FROM e WHERE e.t = here)),
    pr AS (
        SELECT id AS a, contradicts AS b FROM r WHERE contradicts IS NOT NULL
        UNION SELECT x.s, y.s FROM e x JOIN e y ON x.t = y.t AND x.rn < y.rn WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.id = x.s AND r.replaces = y.s) OR (r.id = y.s AND r.replaces = x.s))),
    cf AS (SELECT x.head AS a, y.head AS b FROM pr JOIN h x ON x.node = pr.a JOIN h y ON y.node = pr.b WHERE x.head <> y.head)
    SELECT a, b FROM cf UNION SELECT b, a FROM cf
"""


def wn08_first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a text by customer and priority that give way, a third of them restating an ancestor of their own."""
    rows = table(spark, sf, "orders").select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("key"), F.col("o_orderdate").alias("captured"), F.col("o_orderkey").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"))
    before = F.lag("id").over(Window.partitionBy("key").orderBy("captured", "id"))
    lineage = F.when((F.col("id") % 3 == 0) & before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<long>"))
    return first_texts(rows.withColumn("lineage", lineage))


WN08 = """
    WITH RECURSIVE k AS (SELECT o_custkey || '/' || o_orderpriority AS key, o_orderkey AS id, lag(o_orderkey) OVER w AS before, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)),
    f AS (
        SELECT key, n, id AS fid, NULL::BIGINT AS cid, NULL::BIGINT AS cby FROM k WHERE n = 1
        UNION ALL SELECT k.key, k.n, CASE WHEN k.id % 3 = 0 THEN k.id ELSE f.fid END, CASE WHEN k.id % 3 <> 0 THEN k.id WHEN f.fid <> k.before THEN f.fid END, CASE WHEN k.id % 3 <> 0 THEN f.fid ELSE k.id END FROM f JOIN k ON k.key = f.key AND k.n = f.n + 1)
    SELECT cid AS id, cby AS superseded_by FROM f WHERE cid IS NOT NULL
"""

# ---- tiers ---------------------------------------------------------------------------------------


def rule_line(summary: Column, must: Column, until: Column, paths: Column, stale: Column, with_scope: bool) -> Column:
    """A rule as one line: its mark, its end date unless it names it, the paths it applies to, what is missing."""
    end = F.when(until.isNotNull() & ~F.contains(summary, until.cast("string")), F.concat(F.lit(" (until "), until.cast("string"), F.lit(")"))).otherwise("")
    ticked = F.concat(F.lit("`"), F.array_join(paths, "`, `"), F.lit("`"))
    scope = F.when(F.size(paths) > 0, F.concat(F.lit(" (applies to: "), ticked, F.lit(")"))).otherwise("") if with_scope else F.lit("")
    gone = F.when(stale.isNotNull(), F.concat(F.lit(" ("), stale, F.lit(")"))).otherwise("")
    return F.regexp_replace(F.concat(F.lit("- "), F.when(must, "(must) ").otherwise(""), summary, end, scope, gone), r"[\r\n\x{2028}\x{2029}]+", " ")


def tx20_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rules, one line each."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    until = F.when(key % 4 == 0, F.to_date("o_orderdate"))
    summary = F.when(key % 8 == 0, F.concat(F.lit("Use it until "), F.to_date("o_orderdate").cast("string"))).otherwise(F.concat(F.lit("Use order\n"), key))
    paths = F.when(key % 3 == 0, F.array(F.concat(F.lit("src/"), key, F.lit("/**")), F.lit("*.md"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", rule_line(summary, F.col("o_totalprice") > 350000, until, paths, F.when(key % 11 == 0, F.lit("check needed")), True).alias("line"))


TX20 = r"""
    SELECT o_orderkey, '- ' || CASE WHEN o_totalprice > 350000 THEN '(must) ' ELSE '' END || CASE WHEN o_orderkey % 8 = 0 THEN 'Use it until ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'Use order ' || o_orderkey END || CASE WHEN o_orderkey % 8 = 4 THEN ' (until ' || strftime(o_orderdate, '%Y-%m-%d') || ')' ELSE '' END
        || CASE WHEN o_orderkey % 3 = 0 THEN ' (applies to: `src/' || o_orderkey || '/**`, `*.md`)' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN ' (check needed)' ELSE '' END AS line FROM orders
"""


def plan_tiers(rules: DataFrame, core_budget: int, scoped_budget: int) -> DataFrame:
    """(pool, id, tier, overflow, in_session): how each deliverable rule of a pool is delivered.

    ``rules`` has pool, id, tier, enforcement, has_paths, stale, violations, reinforced, captured, cost,
    scoped_cost.  Rules that want the core are packed in order of priority, passing over what does not
    fit, which is then given on demand; scoped ones join the session if all of a pool's fit together.
    """
    escalated = (F.col("violations") >= 1) | (F.col("reinforced") >= 3)
    wants = (
        F.when((F.col("tier") == "on-demand") | F.col("stale") & (F.col("tier") != "core"), "on-demand").when(F.col("tier") == "core", "core").when(F.col("has_paths"), "scoped")
        .when(F.col("tier") == "scoped", "on-demand").when((F.col("enforcement") == "info") & ~escalated, "on-demand").otherwise("core")
    )
    sorted_ = rules.withColumn("wants", wants).withColumn("pin", F.when(F.col("tier") == "core", 0).otherwise(1)).withColumn("broken", -F.col("violations"))
    sorted_ = sorted_.withColumn("must", F.when(F.col("enforcement") == "must", 0).otherwise(1)).withColumn("said", -F.col("reinforced")).withColumn("newest", -F.unix_micros(F.col("captured").cast("timestamp")))
    packed = asof.pack_budget(sorted_.filter("wants = 'core'"), "pool", ["pin", "broken", "must", "said", "newest", "id"], "cost", core_budget)
    core = packed.select("pool", "id", F.when(F.col("taken"), "core").otherwise("on-demand").alias("tier"), (~F.col("taken")).alias("overflow"), F.col("taken").alias("in_session"))
    fits = F.sum("scoped_cost").over(Window.partitionBy("pool")) <= scoped_budget
    scoped = sorted_.filter("wants = 'scoped'").select("pool", "id", F.lit("scoped").alias("tier"), F.lit(False).alias("overflow"), fits.alias("in_session"))
    rest = sorted_.filter("wants = 'on-demand'").select("pool", "id", F.lit("on-demand").alias("tier"), F.lit(False).alias("overflow"), F.lit(False).alias("in_session"))
    return union(core, scoped, rest)


def tier_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Live orders as rules of their customer, with the tokens that their lines take."""
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'F'")
    key = F.col("o_orderkey")
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "core").when(F.col("o_orderpriority") == "5-LOW", "on-demand").when(F.col("o_orderpriority") == "2-HIGH", "scoped").otherwise("auto")
    enforcement = F.when(F.col("o_totalprice") > 350000, "must").when(F.col("o_totalprice") < 150000, "info").otherwise("should")
    paths = F.when(key % 3 == 0, F.array(F.concat(F.lit("src/"), key, F.lit("/**")))).otherwise(F.array().cast("array<string>"))
    until = F.when(key % 4 == 0, F.to_date("o_orderdate"))
    stale = F.when(key % 11 == 0, F.lit("check needed"))
    summary = F.concat(F.lit("Use order "), key, F.lit(" é"))
    line = lambda scope: T.approx_tokens(rule_line(summary, enforcement == "must", until, paths, stale, scope))
    return o.select(F.col("o_custkey").alias("pool"), key.alias("id"), tier.alias("tier"), enforcement.alias("enforcement"), (F.size(paths) > 0).alias("has_paths"), stale.isNotNull().alias("stale"), (F.when(key % 4 == 0, key % 3).otherwise(0)).alias("violations"), (key % 5).alias("reinforced"), F.col("o_orderdate").alias("captured"), line(False).cast("long").alias("cost"), line(True).cast("long").alias("scoped_cost"))


def ct01_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return plan_tiers(tier_rules(spark, sf), 24, 30)


TIERS = r"""
    o AS (
        SELECT o_custkey AS pool, o_orderkey AS id, o_orderdate AS captured, o_orderkey % 3 = 0 AS has_paths, o_orderkey % 11 = 0 AS stale, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE 0 END AS violations, o_orderkey % 5 AS reinforced,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'core' WHEN '5-LOW' THEN 'on-demand' WHEN '2-HIGH' THEN 'scoped' ELSE 'auto' END AS tier, CASE WHEN o_totalprice > 350000 THEN 'must' WHEN o_totalprice < 150000 THEN 'info' ELSE 'should' END AS enforcement,
            '- ' || CASE WHEN o_totalprice > 350000 THEN '(must) ' ELSE '' END || 'Use order ' || o_orderkey || ' ' || CASE WHEN o_orderkey % 4 = 0 THEN ' (until ' || strftime(o_orderdate, '%Y-%m-%d') || ')' ELSE '' END AS front,
            CASE WHEN o_orderkey % 3 = 0 THEN ' (applies to: `src/' || o_orderkey || '/**`)' ELSE '' END AS scope, CASE WHEN o_orderkey % 11 = 0 THEN ' (check needed)' ELSE '' END AS gone
        FROM orders WHERE o_orderstatus <> 'F'),
    c AS (
        SELECT *, ceil(length(front || gone) / 4 + 1 / 1.3)::BIGINT AS cost, ceil(length(front || scope || gone) / 4 + 1 / 1.3)::BIGINT AS scoped_cost,
            CASE WHEN tier = 'on-demand' OR (stale AND tier <> 'core') THEN 'on-demand' WHEN tier = 'core' THEN 'core' WHEN has_paths THEN 'scoped' WHEN tier = 'scoped' THEN 'on-demand' WHEN enforcement = 'info' AND violations < 1 AND reinforced < 3 THEN 'on-demand' ELSE 'core' END AS wants FROM o),
    p AS (SELECT pool, list_reduce(list_prepend({'used': 0::BIGINT, 'ids': []::BIGINT[]}, list({'used': cost, 'ids': [id]} ORDER BY tier = 'core' DESC, violations DESC, enforcement = 'must' DESC, reinforced DESC, captured DESC, id)),
        lambda a, x: CASE WHEN a.used + x.used <= 24 THEN {'used': a.used + x.used, 'ids': a.ids || x.ids} ELSE a END) AS r FROM c WHERE wants = 'core' GROUP BY pool),
    s AS (SELECT pool, sum(scoped_cost) AS total FROM c WHERE wants = 'scoped' GROUP BY pool)
"""
CT01 = f"""
    WITH {TIERS}
    SELECT c.pool, c.id, CASE WHEN wants = 'core' AND NOT list_contains(r.ids, c.id) THEN 'on-demand' ELSE wants END AS tier, wants = 'core' AND NOT list_contains(r.ids, c.id) AS overflow,
        CASE wants WHEN 'core' THEN list_contains(r.ids, c.id) WHEN 'scoped' THEN total <= 30 ELSE false END AS in_session FROM c LEFT JOIN p USING (pool) LEFT JOIN s USING (pool)
"""

# ---- selection for a prompt ----------------------------------------------------------------------


def glob_matches(hints: DataFrame, globs: DataFrame) -> DataFrame:
    """(hint, glob): paths that globs match.  Both meet under the folders that a glob spells out; the rest is one pattern.

    ``hints`` has hint and ``globs`` glob; a glob that spells out no folder meets every hint.
    """
    fixed = F.regexp_extract("glob", r"^((?:[^*?{\[/]+/)*)", 1)
    at = F.regexp_replace(fixed, "/$", "")
    regex = column(path_regex, "string")
    keyed = globs.select("glob").distinct().select("glob", F.when(F.contains("glob", F.lit("/")), at).otherwise("").alias("at"), regex(F.col("glob")).alias("pattern"))
    asked = hints.select("hint").distinct().select("hint", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), prefixes(F.col("hint"))))).alias("at"))
    return asked.join(keyed, "at").filter("hint RLIKE pattern").select("hint", "glob")


def score_parts(rules: DataFrame, prompts: DataFrame, least: float) -> DataFrame:
    """(pid, id, lexical, topics, path, code, score) of every pair that scores ``least`` or more, and more than nothing.

    ``rules`` has id, text, topics, paths; ``prompts`` pid, text, code_paths.  A rule bound to paths scores
    nothing where the prompt names files and none of them is among those.  Pairs come from common words,
    weighed in blocks of rules and prompts, or from a topic or a path that is named.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    said = prompts.select("pid", F.explode(F.array_distinct(F.split(F.trim(spaced(F.col("text"))), " "))).alias("word"))
    named = rules.select("id", F.explode("topics").alias("topic")).filter(F.length("topic") >= 2).withColumn("word", F.split(F.trim(spaced(F.col("topic"))), " ")[0])
    topics = named.join(said, "word").join(prompts.select("pid", spaced(F.col("text")).alias("all")), "pid").filter(F.contains("all", F.trim(spaced(F.col("topic"))))).groupBy("pid", "id").agg(F.count_distinct("topic").alias("topics"))
    hints = prompts.select("pid", F.explode(column(path_hints, "array<string>")(F.col("text"))).alias("hint"))
    codes = prompts.select("pid", F.explode("code_paths").alias("hint"))
    globs = rules.select("id", F.explode("paths").alias("glob"))
    matched = checkpointed(glob_matches(hints.select("hint").unionByName(codes.select("hint")), globs).join(globs, "glob").select("hint", "id").distinct())
    path = hints.join(matched, "hint").select("pid", "id", F.lit(X.PATH_BONUS).alias("path")).distinct()
    code = codes.join(matched, "hint").select("pid", "id", F.lit(X.CODE_BONUS).alias("code")).distinct()
    files = hints.filter(column(is_file_path, "boolean")(F.col("hint"))).select("pid").unionByName(codes.select("pid")).distinct().withColumn("files", F.lit(True))
    files = checkpointed(files)
    scoped = rules.select("id", (F.size("paths") > 0).alias("scoped"))
    both = topics.join(path, ["pid", "id"], "full").join(code, ["pid", "id"], "full").join(scoped, "id").join(files, "pid", "left")
    bonus = checkpointed(both.withColumn("bound", F.col("scoped") & F.col("files").isNotNull()).drop("scoped", "files"))
    asked = overlap.asked_sets(rules.select("id", "text"), prompts.select(F.col("pid").alias("id"), "text"))
    held = asked.held.join(scoped.withColumnRenamed("scoped", "mark"), "id")
    wanted = asked.wanted.join(files.select(F.col("pid").alias("id"), F.col("files").alias("mark")), "id", "left").na.fill(False, ["mark"])
    lexical = overlap.likeness(asked._replace(held=checkpointed(held), wanted=checkpointed(wanted)), 0.0).toDF("pid", "id", "lexical", "marked")
    every = lexical.join(bonus, ["pid", "id"], "full").na.fill(0.0, ["lexical", "path", "code"]).na.fill(0, ["topics"])
    every = every.withColumn("topics", F.least(F.lit(X.TOPIC_CAP), F.col("topics") * X.TOPIC_BONUS)).withColumn("code", F.when(F.col("path") > 0, 0.0).otherwise(F.col("code")))
    off = F.coalesce("marked", "bound") & (F.col("path") == 0) & (F.col("code") == 0)
    score = F.round(F.col("lexical") + F.col("topics") + F.col("path") + F.col("code"), 5)
    return every.filter(~off).select("pid", "id", F.round("lexical", 5).alias("lexical"), F.round("topics", 5).alias("topics"), "path", "code", score.alias("score")).filter((F.col("score") >= least) & (F.col("score") > 0))


def first_fitting(rules: DataFrame, prompts: DataFrame, given: DataFrame, budget: int) -> DataFrame:
    """(pid, id, captured, cost): what of the new rules can be taken when a budget is filled in order.

    Of the rules of one cost, greedy packing takes the first ones that are new to the prompt, and no more
    than fit alone: once one is passed over for its cost, so are all later ones.  So for each cost the first
    ``budget // cost`` rules after the start of a session are enough, and as many more as the session has.
    Rules that every session loads are one list of that kind, rules since the start another.  ``captured``
    and ``since`` are days, so what meets the starts is bounded by the days, the costs and the budget.
    """
    able = rules.filter(~F.col("conflict") & (F.col("cost") <= budget)).select("id", "captured", "loaded", "cost")
    asks = checkpointed(prompts.filter("kind <> 'command' AND since IS NOT NULL").select("pid", "since"))
    had = checkpointed(given.join(able, "id").groupBy("pid", "cost").agg(F.count("*").alias("had")))
    most = had.groupBy("cost").agg(F.max("had").alias("most"))
    lists = able.join(most, "cost", "left").withColumn("most", F.coalesce("most", F.lit(0)) + F.floor(F.lit(budget) / F.greatest("cost", F.lit(1))))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("captured", "id"))
    loaded = lists.filter("loaded").withColumn("nth", nth("cost")).filter("nth <= most")
    # the rules since a start are the head of what was captured on its day, then of the days after
    days = lists.filter("NOT loaded").withColumn("nth", nth("cost", "captured")).filter("nth <= most")
    of_day = checkpointed(days.select("id", "captured", "cost", "most"))
    starts = asks.select("since").distinct()
    since = of_day.join(starts, F.col("captured") >= F.col("since")).withColumn("nth", nth("since", "cost")).filter("nth <= most")
    found = asks.join(since.select("since", "id", "captured", "cost"), "since").select("pid", "id", "captured", "cost")
    every = asks.select("pid", F.explode(F.array(F.lit(1))).alias("one")).join(loaded.select("id", "captured", "cost", F.lit(1).alias("one")), "one").select("pid", "id", "captured", "cost")
    return found.unionByName(every).join(given.select("pid", "id"), ["pid", "id"], "left_anti")


#: Rows of a few numbers that may be broadcast once they are counted.
FEW = 100_000


def if_few(rows: DataFrame) -> DataFrame:
    """``rows``, a checkpointed table, broadcast if it is small: what they are joined with is not shuffled."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def select_context(rules: DataFrame, prompts: DataFrame, given: DataFrame, budget: int, fresh_header: int, related_header: int, least: float = X.PROMPT_MIN_SCORE) -> DataFrame:
    """(pid, id, outcome and the parts of the score) of every rule that is new or given to a prompt or scores ``least`` or more for it.

    ``rules`` has id, text, topics, paths, captured, loaded (given at session start), conflict and cost;
    ``prompts`` kind and since (start of the session or null); ``given`` pid and id of what the session
    already has.  New rules go first; the best eight of the others share what is left of the budget.
    Outcomes of pairs: fresh, injected, already injected, below threshold, over budget, over limit.  What is
    left out here belongs to the prompt or the rule alone, see ``every_outcome`` and ``outcome_counts``.
    """
    rules, prompts, given = checkpointed(rules), checkpointed(prompts), checkpointed(given.select("pid", "id").distinct())
    fresh = asof.pack_budget(first_fitting(rules, prompts, given, budget - fresh_header), "pid", ["captured", "id"], "cost", budget - fresh_header).filter("taken")
    fresh = checkpointed(fresh.select("pid", "id", "cost"))
    spent = fresh.groupBy("pid").agg((F.sum("cost") + fresh_header).alias("spent"))
    pool = rules.filter("NOT loaded OR conflict")
    normal = prompts.filter("kind = 'normal'")
    new = if_few(fresh.select("pid", "id"))
    parts = checkpointed(score_parts(pool, normal, least).join(new, ["pid", "id"], "left_anti"))
    had = given.join(normal.select("pid"), "pid").join(pool.select("id"), "id").join(new, ["pid", "id"], "left_anti").withColumn("had", F.lit(True))
    every = parts.join(had, ["pid", "id"], "full").withColumn("had", F.coalesce("had", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "id"))
    able = parts.filter(F.col("score") >= X.PROMPT_MIN_SCORE).join(had.select("pid", "id"), ["pid", "id"], "left_anti")
    best = able.select("pid", "id", "score").withColumn("place", place).filter(F.col("place") <= X.PROMPT_LIMIT)
    hits = checkpointed(best.join(pool.select("id", "cost"), "id")).join(spent, "pid", "left")
    lists = hits.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("place", "cost", "id"))).alias("xs"), F.first(F.lit(budget) - F.coalesce("spent", F.lit(0)) - related_header).alias("left"))
    start = F.struct(F.col("left").cast("long").alias("left"), F.array().cast("array<long>").alias("ids"))
    packed = F.aggregate("xs", start, lambda a, x: F.when(x["cost"] <= a["left"], F.struct((a["left"] - x["cost"]).cast("long").alias("left"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a))
    chosen = lists.select("pid", F.explode(packed["ids"]).alias("id")).withColumn("chosen", F.lit(True))
    taken = checkpointed(hits.select("pid", "id", F.lit(True).alias("hit")).join(chosen, ["pid", "id"], "left"))
    told = every.join(if_few(taken), ["pid", "id"], "left")
    outcome = F.when(F.col("chosen"), "injected").when(F.col("had"), "already injected").when(F.col("score") < X.PROMPT_MIN_SCORE, "below threshold").when(F.col("hit"), "over budget").otherwise("over limit")
    told = told.select("pid", "id", outcome.alias("outcome"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical", "topics", "path", "code", "score")])
    return told.unionByName(fresh.select("pid", "id", F.lit("fresh").alias("outcome"), *[F.lit(0.0).alias(c) for c in ("lexical", "topics", "path", "code", "score")]))


def every_outcome(rules: DataFrame, prompts: DataFrame, selected: DataFrame) -> DataFrame:
    """(pid, id, outcome, score): one row for each rule and prompt; ``selected`` has all pairs that score anything."""
    always = F.col("loaded") & ~((F.col("kind") == "normal") & F.col("conflict"))
    rest = F.when(F.col("kind") == "command", "skipped prompt").when(always, "always loaded").otherwise("below threshold")
    rows = rules.select("id", "loaded", "conflict").crossJoin(prompts.select("pid", "kind"))
    told = rows.join(selected.select("pid", "id", "outcome", "score"), ["pid", "id"], "left")
    return told.select("pid", "id", F.coalesce("outcome", rest).alias("outcome"), F.coalesce("score", F.lit(0.0)).alias("score"))


def outcome_counts(rules: DataFrame, prompts: DataFrame, selected: DataFrame) -> DataFrame:
    """(pid, outcome, rules): how many rules each prompt has of each outcome, those included that need no pair.

    All rules are skipped by a command, an always loaded one is nothing but that, and whatever else is
    not among the selected pairs scores below the threshold.
    """
    total, loaded = rules.agg(F.count("*"), F.count_if(F.col("loaded") & ~F.col("conflict"))).first()
    found = checkpointed(selected.join(rules.select("id", (F.col("loaded") & ~F.col("conflict")).alias("always")), "id").groupBy("pid", "outcome", "always").agg(F.count("*").alias("rules")))
    taken = found.groupBy("pid").agg(F.sum("rules").alias("taken"), F.coalesce(F.sum(F.when(F.col("always"), F.col("rules"))), F.lit(0)).alias("always"))
    rest = prompts.join(taken, "pid", "left").na.fill(0, ["taken", "always"])
    command = F.col("kind") == "command"
    kinds = F.array(
        F.struct(F.lit("skipped prompt").alias("outcome"), F.when(command, F.lit(total)).otherwise(0).alias("rules")),
        F.struct(F.lit("always loaded").alias("outcome"), F.when(command, 0).otherwise(F.lit(loaded) - F.col("always")).alias("rules")),
        F.struct(F.lit("below threshold").alias("outcome"), F.when(command, 0).otherwise(F.lit(total - loaded) - F.col("taken") + F.col("always")).alias("rules")),
    )
    others = rest.select("pid", F.explode(kinds).alias("k")).select("pid", "k.outcome", "k.rules").filter("rules > 0")
    return found.groupBy("pid", "outcome").agg(F.sum("rules").alias("rules")).unionByName(others)


BUDGET, FRESH_HEADER, RELATED_HEADER = 60, 9, 7


def selection_inputs(spark: SparkSession, sf: str, share: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as rules, benchmark texts as prompts of sessions of their own, and what these have been given: one rule in ``share`` each."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    i, p = F.col("doc_id"), F.col("item_id")
    none = F.array().cast("array<string>")
    paths = F.when(i % 3 == 0, F.array(F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/**")))).otherwise(none)
    rules = docs.select(i.alias("id"), "text", F.array(F.coalesce("source", F.lit("none"))).alias("topics"), paths.alias("paths"), (i % 365).alias("captured"), (i % 10 == 0).alias("loaded"), (i % 10 == 1).alias("conflict"), T.approx_tokens(F.substring("text", 1, 80)).cast("long").alias("cost"))
    source = F.concat(F.lit("src"), p % 25)
    text = F.when(p % 10 == 9, F.concat(F.lit("/run "), "text")).when(p % 10 == 8, "ok").otherwise(F.concat("text", F.lit(" see "), source, F.when(p % 4 == 0, F.concat(F.lit(" in src/"), source, F.lit("/main.py"))).otherwise("")))
    code_paths = F.when(p % 4 == 1, F.array(F.concat(F.lit("src/"), source, F.lit("/other.py")))).otherwise(none)
    prompts = asked.select(p.alias("pid"), text.alias("text"), code_paths.alias("code_paths"), prompts_.kind(text).alias("kind"), F.when(p % 2 == 0, 363 - p % 3).alias("since"))
    given = docs.select(i.alias("id"), ((share - i % share) % share).alias("r")).join(prompts.select("pid", (F.col("pid") % share).alias("r")), "r").select("pid", "id")
    return rules, prompts, given


def selection(spark: SparkSession, sf: str, least: float = X.PROMPT_MIN_SCORE) -> DataFrame:
    return select_context(*selection_inputs(spark, sf), BUDGET, FRESH_HEADER, RELATED_HEADER, least)


D = T.DUCK_TOKENS.format(c="text")
#: The selection as one query.
SELECTION = f"""
    WITH r AS (SELECT doc_id AS id, text, coalesce(source, 'none') AS topic, doc_id % 3 = 0 AS scoped, doc_id % 365 AS captured, doc_id % 10 = 0 AS loaded, doc_id % 10 = 1 AS conflict,
        ceil((length(substr(text, 1, 80)) - length(regexp_replace(substr(text, 1, 80), '[\\x00-\\x7F]', '', 'g'))) / 4 + length(regexp_replace(substr(text, 1, 80), '[\\x00-\\x7F]', '', 'g')) / 1.3)::BIGINT AS cost FROM documents),
    q AS (
        SELECT item_id AS pid, 'src' || item_id % 25 AS src, item_id % 4 AS form, CASE item_id % 10 WHEN 9 THEN 'command' WHEN 8 THEN 'ack' ELSE 'normal' END AS kind, CASE WHEN item_id % 2 = 0 THEN 363 - item_id % 3 END AS since,
            CASE WHEN item_id % 10 IN (8, 9) THEN 'ok' ELSE text || ' see src' || item_id % 25 || CASE WHEN item_id % 4 = 0 THEN ' in src/src' || item_id % 25 || '/main.py' ELSE '' END END AS text FROM benchmark),
    x AS (SELECT q.pid, q.kind, q.since, q.src, q.form, r.*, (r.id + q.pid % 13) % 13 = 0 AS had FROM q CROSS JOIN r),
    fl AS (SELECT pid, list_reduce(list_prepend({{'used': 0::BIGINT, 'ids': []::BIGINT[]}}, list({{'used': cost, 'ids': [id]}} ORDER BY captured, id)),
        lambda a, b: CASE WHEN a.used + b.used <= {BUDGET - FRESH_HEADER} THEN {{'used': a.used + b.used, 'ids': a.ids || b.ids}} ELSE a END) AS f FROM x WHERE kind <> 'command' AND since IS NOT NULL AND NOT had AND NOT conflict AND (captured >= since OR loaded) GROUP BY pid),
    pool AS (SELECT * FROM r WHERE NOT loaded OR conflict), n AS (SELECT greatest(1, count(*)) AS n FROM pool),
    d AS (SELECT DISTINCT id, tok FROM (SELECT id, unnest({D}) AS tok FROM pool)), qt AS (SELECT DISTINCT pid, tok FROM (SELECT pid, unnest({D}) AS tok FROM q WHERE kind = 'normal')),
    w AS (SELECT tok, ln(1 + n.n / count(*)) AS w FROM d, n GROUP BY tok, n.n), dn AS (SELECT id, sum(w) AS dn FROM d JOIN w USING (tok) GROUP BY id),
    qw AS (SELECT pid, qt.tok, coalesce(w.w, ln(1 + n.n)) AS w FROM qt CROSS JOIN n LEFT JOIN w ON qt.tok = w.tok), qn AS (SELECT pid, sum(w) AS qn FROM qw GROUP BY pid),
    it AS (SELECT pid, id, sum(qw.w) AS inter FROM qw JOIN d USING (tok) GROUP BY pid, id), lx AS (SELECT pid, id, inter / sqrt(qn * dn) AS lexical FROM it JOIN qn USING (pid) JOIN dn USING (id)),
    p AS (
        SELECT x.*, list_contains(coalesce(f.ids, []), x.id) AS fresh, CASE WHEN len(coalesce(f.ids, [])) > 0 THEN f.used + {FRESH_HEADER} ELSE 0 END AS spent, (x.kind = 'normal' AND (NOT loaded OR conflict)) AS scoring,
            coalesce(lx.lexical, 0) AS lex, CASE WHEN x.topic = x.src THEN 0.15 ELSE 0 END AS top, CASE WHEN scoped AND form = 0 AND topic = src THEN 0.5 ELSE 0 END AS pth, CASE WHEN scoped AND form = 1 AND topic = src THEN 0.35 ELSE 0 END AS cod
        FROM x LEFT JOIN fl USING (pid) LEFT JOIN lx USING (pid, id)),
    sc AS (SELECT *, CASE WHEN scoring AND NOT fresh AND NOT (scoped AND form IN (0, 1) AND pth = 0 AND cod = 0) THEN round(lex + top + pth + cod, 5) ELSE 0 END AS score FROM p),
    hit AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) AS place FROM sc WHERE scoring AND NOT fresh AND NOT had AND score >= 0.12),
    ch AS (SELECT pid, list_reduce(list_prepend({{'left': ({BUDGET - RELATED_HEADER} - any_value(spent))::BIGINT, 'ids': []::BIGINT[]}}, list({{'left': cost, 'ids': [id]}} ORDER BY place)),
        lambda a, b: CASE WHEN b.left <= a.left THEN {{'left': a.left - b.left, 'ids': a.ids || b.ids}} ELSE a END) AS c FROM hit WHERE place <= 8 GROUP BY pid),
    o AS (
        SELECT sc.pid, sc.id, CASE WHEN kind = 'command' THEN 'skipped prompt' WHEN fresh THEN 'fresh' WHEN NOT scoring THEN CASE WHEN loaded THEN 'always loaded' ELSE 'below threshold' END WHEN list_contains(coalesce(c.ids, []), sc.id) THEN 'injected'
            WHEN had THEN 'already injected' WHEN sc.score < 0.12 THEN 'below threshold' WHEN hit8.id IS NOT NULL THEN 'over budget' ELSE 'over limit' END AS outcome,
            CASE WHEN scoring AND NOT fresh THEN round(lex, 5) ELSE 0 END AS lexical, CASE WHEN scoring AND NOT fresh THEN top ELSE 0 END AS topics, CASE WHEN scoring AND NOT fresh THEN pth ELSE 0 END AS path, CASE WHEN scoring AND NOT fresh THEN cod ELSE 0 END AS code, sc.score
        FROM sc LEFT JOIN ch USING (pid) LEFT JOIN (SELECT pid, id FROM hit WHERE place <= 8) hit8 ON hit8.pid = sc.pid AND hit8.id = sc.id)
"""


#: Outcomes are counted over sessions that have been given fewer rules.
COUNTED = SELECTION.replace("(r.id + q.pid % 13) % 13", "(r.id + q.pid % 97) % 97")


def ct02_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of every rule for every prompt."""
    rules, prompts, given = selection_inputs(spark, sf)
    return every_outcome(rules, prompts, select_context(rules, prompts, given, BUDGET, FRESH_HEADER, RELATED_HEADER, 0.0))


def ct02_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many rules each prompt has of each of the eight outcomes."""
    rules, prompts, given = selection_inputs(spark, sf, 97)
    return outcome_counts(rules, prompts, select_context(rules, prompts, given, BUDGET, FRESH_HEADER, RELATED_HEADER))


def so08_selected(spark: SparkSession, sf: str) -> DataFrame:
    """What is added to each prompt: at most eight rules from the threshold up, as far as the budget goes."""
    return selection(spark, sf).filter("outcome = 'injected'").select("pid", "id", "score")


def ct04_explained(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve best rules of each prompt with the parts of their scores, as text."""
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "id"))
    shown = selection(spark, sf, 0.0).filter("score > 0").withColumn("place", place).filter("place <= 12")
    more = [F.when(F.col(c) > 0, F.concat(F.lit(f", {c} +"), F.format_string("%.2f", c))).otherwise("") for c in ("topics", "path", "code")]
    return shown.select("pid", "place", "id", F.concat("outcome", F.lit(": "), F.lit("lexical "), F.format_string("%.2f", F.round("lexical", 2)), *more).alias("why"))


CT04 = f"""{SELECTION} SELECT pid, place, id, outcome || ': lexical ' || printf('%.2f', round(lexical, 2)) || CASE WHEN topics > 0 THEN ', topics +0.15' ELSE '' END || CASE WHEN path > 0 THEN ', path +0.50' ELSE '' END || CASE WHEN code > 0 THEN ', code +0.35' ELSE '' END AS why
    FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) AS place FROM o WHERE outcome NOT IN ('always loaded', 'skipped prompt') AND (score > 0 OR outcome = 'injected')) WHERE place <= 12"""

QUERIES = [
    Query("gr25_ancestor_counts", gr25_ancestors, GR25),
    Query("gr27_conflict_propagation", gr27_conflicts, GR27),
    Query("gr28_status_derivation", gr28_status, GR28),
    Query("wn08_first_occurrence", wn08_first_texts, WN08),
    Query("tx20_rule_line", tx20_lines, TX20),
    Query("ct01_tier_plan", ct01_tiers, CT01),
    Query("ct02_selection_outcomes", ct02_outcomes, f"{SELECTION} SELECT pid, id, outcome, score FROM o"),
    Query("ct02_outcome_counts", ct02_counts, f"{COUNTED} SELECT pid, outcome, count(*) AS rules FROM o GROUP BY ALL"),
    Query("so08_prompt_selection", so08_selected, f"{SELECTION} SELECT pid, id, score FROM o WHERE outcome = 'injected'"),
    Query("ct04_explain", ct04_explained, CT04),
]
