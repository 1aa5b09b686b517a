"""Candidates against the rule book: neighbours, verdicts, their application, re-judging; model choice and health.

Benchmark texts stand for candidates and rules, orders for the candidates of a pool one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, models
from ..functions import fixed as X
from ..functions import signals as S
from ..functions import text as T
from ..functions.globs import path_regex
from ..functions.signals import column
from ..plans.query import KEY, Query, table, worked
from . import overlap
from .codegraph import union
from .contexts import pack_blocks
from .graph import checkpointed
from .rulebook import score_parts

# ---- neighbours and verdicts ---------------------------------------------------------------------


def neighbours(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """(pid, id, score, place): the six best rules of each candidate from 0.15 up; sharing a path lifts a rule among them.

    ``candidates`` has pid, text, paths and ``pool`` id, text, paths, topics.
    """
    none = F.array().cast("array<string>")
    parts = score_parts(pool.withColumn("paths", none), candidates.select("pid", F.regexp_replace("text", r"[/.]", " ").alias("text"), none.alias("code_paths")), X.NEIGHBOUR_MIN)
    best = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "id"))
    top = parts.withColumn("nth", best).filter(F.col("nth") <= X.NEIGHBOUR_LIMIT)
    both = top.join(candidates.select("pid", F.col("paths").alias("mine")), "pid").join(pool.select("id", F.col("paths").alias("theirs")), "id")
    lifted = both.withColumn("score", F.round(F.col("score") + F.when(F.arrays_overlap("mine", "theirs"), X.NEIGHBOUR_PATH_BONUS).otherwise(0.0), 5))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "id"))
    return lifted.select("pid", "id", "score", place.alias("place"))


def verdicts(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """(pid, relation, target, why): a rule in the same scope that says the same settles a candidate without a model.

    Without one, the best neighbour is the same rule if it scores high enough and names nothing else.
    """
    near = neighbours(candidates, pool).join(candidates.select("pid", F.col("text").alias("said"), F.col("paths").alias("mine")), "pid").join(pool.select("id", "text", F.col("paths").alias("theirs")), "id")
    scope = F.array_sort(F.array_distinct("mine")) == F.array_sort(F.array_distinct("theirs"))
    same = scope & T.same_rule(F.col("said"), F.col("text"))
    differs = (T.negated(F.col("said")) != T.negated(F.col("text"))) | (T.key_terms(F.col("said")) != T.key_terms(F.col("text")))
    alike = (F.col("place") == 1) & (F.col("score") >= X.SAME_RULE_SCORE) & scope & ~differs
    near = near.withColumn("same", same).withColumn("alike", alike)
    judged = near.groupBy("pid").agg(F.min(F.when(F.col("same"), F.struct("place", "id")))["id"].alias("fast"), F.min(F.when(F.col("alike"), F.col("id"))).alias("close"))
    every = candidates.select("pid").join(judged, "pid", "left")
    target = F.coalesce("fast", "close")
    why = F.when(F.col("fast").isNotNull(), "same wording").when(F.col("close").isNotNull(), "close").otherwise("new")
    return every.select("pid", F.when(target.isNotNull(), "duplicate").otherwise("new").alias("relation"), target.alias("target"), why.alias("why"))


def er01_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    b, i = checkpointed(table(spark, sf, "benchmark")), F.col("item_id")
    text = F.when(i % 4 == 0, F.concat(F.upper("text"), F.lit("!"))).when(i % 4 == 1, F.concat("text", F.lit(" never"))).when(i % 4 == 2, F.concat(F.lit("Unrelated words "), i)).otherwise(F.concat("text", F.lit(" the the")))
    candidates = b.select(i.alias("pid"), text.alias("text"), F.array(F.concat(F.lit("p"), (i / 4).cast("long") % 3)).alias("paths"))
    pool = b.select(i.alias("id"), "text", F.array(F.concat(F.lit("p"), (i / 4).cast("long") % 2)).alias("paths"), F.array().cast("array<string>").alias("topics"))
    return verdicts(candidates, pool)


#: By hand: a text in capitals has the same canonical wording; one that gains a negation differs; " the the" adds no token.
ER01 = """
    WITH b AS (SELECT item_id AS pid, item_id % 4 AS form, (item_id // 4) % 3 = (item_id // 4) % 2 AS scoped, text FROM benchmark)
    SELECT pid, CASE WHEN scoped AND (form = 0 OR (form = 3 AND regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)'))) THEN 'duplicate' ELSE 'new' END AS relation, CASE WHEN scoped AND (form = 0 OR (form = 3 AND regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)'))) THEN pid END AS target,
        CASE WHEN scoped AND (form = 0 OR (form = 3 AND regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)'))) THEN 'same wording' ELSE 'new' END AS why FROM b
"""


@dataclass
class Rule:
    """A live rule of a pool while candidates are applied, with the rules that it is in conflict with."""

    kind: str
    actor: str | None
    status: str
    until: str | None
    partners: set[int]

    @property
    def local(self) -> bool:
        return self.status == "proposed"


USER_KINDS = ("user-instruction", "user-correction", "human-edit")
SURE, FIRM = 0.5, 0.6


def applied_relation(verdict: str, confidence: float, merged: bool, kind: str, actor: str | None, target: Rule | None) -> str:
    """What a verdict comes to: the first step of its row below that the candidate may take.

    A person who answers an open conflict may settle it whoever made the rules; otherwise the candidate
    needs the authority, and replaces another person's rule only by way of a conflict.
    """
    if target is None:
        return "new"
    people = {a.lower() for a in (actor, target.actor) if a is not None}
    both = actor is not None and target.actor is not None
    settles = target.status == "conflict" and kind in USER_KINDS
    may = settles or X.AUTHORITY[kind] >= X.AUTHORITY[target.kind]
    mine, foreign = both and len(people) == 1, both and len(people) == 2
    sure, stands = confidence >= SURE, ("new", True)
    if target.local:  # nobody has confirmed it: it is confirmed, or it goes
        steps = {"duplicate": [("duplicate", sure), stands], "refine": [("refine", True)]}
    else:
        clash = [("supersede", may and (settles or mine)), ("conflict", True)]
        steps = {
            "duplicate": [("duplicate", sure), stands],
            "refine": [("refine", merged and may), ("duplicate", may), stands],
            "supersede": [("supersede", may and confidence >= FIRM and (settles or not foreign)), *clash],
            "conflict": clash,
        }
    return next(step for step, able in steps.get(verdict, [stands]) if able)


class Pool:
    """The live rules of one pool.  Links of conflict are kept on both sides, and go over to what replaces a rule."""

    def __init__(self) -> None:
        self.live: dict[int, Rule] = {}

    def group(self, rule: int) -> set[int]:
        """A rule and those it is in conflict with."""
        return {rule} | self.live[rule].partners

    def active(self, ids: list[int]) -> list[int]:
        return [i for i in ids if i in self.live and self.live[i].status == "active"]

    def link(self, a: int, b: int) -> None:
        for x, y in ((a, b), (b, a)):
            self.live[x].partners.add(y)
            self.live[x].status = "conflict"

    def replace(self, gone: set[int], by: int, rule: Rule) -> None:
        """``by`` stands for the rules that go; what they were in conflict with is in conflict with it."""
        others = set().union(*(self.live[i].partners for i in gone)) - gone
        for i in gone:
            del self.live[i]
        self.live[by] = rule
        for i in others:
            self.live[i].partners -= gone
            self.link(i, by)


APPLIED = "pool long, id long, relation string, target long, status string, supersedes string, conflict_with string, review string, note string"


def apply_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """(pool, id, relation, target, status, supersedes, conflict_with, review, note): candidates applied one after another.

    ``candidates`` has pool, id, verdict, target, confidence, merged, kind, actor, durability, held, until
    (a new end date or null) and cascade (ids that a change should have looked at again).  Restating or
    replacing one side of a conflict settles all of it; refining one side settles it only if a person
    does, and otherwise carries it on.  A restated rule with a new end date gets a successor.  Lists are in
    the order of ids.  Each step reads what the one before left, so pools are streamed in order; only a
    pool's live rules are held.
    """
    names = ["pool", "id", "verdict", "target", "confidence", "merged", "kind", "actor", "durability", "held", "until", "cascade"]
    shown = lambda ids: ",".join(map(str, sorted(ids)))

    def one(pool: Pool, i: int, verdict: str, wanted: int | None, confidence: float, merged: bool, kind: str, actor: str | None, durability: str, held: bool, until: str | None, cascade: list[int]) -> tuple:
        if durability == "one_off":
            return "dropped", None, None, "", "", "", ""
        target = None if held else pool.live.get(wanted)
        relation = applied_relation(verdict, confidence, merged, kind, actor, target)
        firm = durability == "durable" and confidence >= FIRM and not held
        gone, note, review = set(), "", []
        if target is not None and target.local:
            gone = {wanted}
            note = "replaced an unconfirmed proposal" if relation == "new" else "confirmed a proposal"
            firm = firm or relation != "new" or verdict == "supersede"
            replaced: set[int] = set()  # a proposal was never stored: nothing is superseded
        elif relation == "duplicate":
            ends = until is not None and until != target.until
            if target.status != "conflict" and not ends:
                return relation, wanted, target.status, "", "", "", ""
            note = "settled a conflict" if target.status == "conflict" else f"end date {until}"
            gone = replaced = pool.group(wanted)
        elif relation in ("refine", "supersede"):
            settles = relation == "supersede" or kind in USER_KINDS
            review = pool.active(cascade)
            gone = replaced = pool.group(wanted) if settles else {wanted}
        else:
            replaced = set()
        ends_at = until if until is not None else target.until if target is not None and relation in ("duplicate", "refine") else None
        status = "active" if relation in ("duplicate", "refine", "supersede") or firm else "proposed"
        pool.replace(gone, i, Rule(kind, actor, status, ends_at, set()))
        if relation == "conflict":
            pool.link(i, wanted)
        made = pool.live[i]
        return relation, None if target is None else wanted, made.status, shown(replaced), shown(made.partners), shown(review), note

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pool = None, Pool()
        for batch in batches:
            out = []
            for p, i, verdict, wanted, *rest, cascade in batch[names].itertuples(index=False, name=None):
                if p != current:
                    current, pool = p, Pool()
                out.append((p, i, *one(pool, i, verdict, None if pd.isna(wanted) else int(wanted), *rest, [int(x) for x in cascade])))
            yield pd.DataFrame(out, columns=["pool", "id", "relation", "target", "status", "supersedes", "conflict_with", "review", "note"]).astype({"target": "Int64"})

    dealt = candidates.repartition("pool").sortWithinPartitions("pool", *order)
    return dealt.select(*names).mapInPandas(run, APPLIED)


def er02_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as candidates, each judged against one of the three before it."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = [F.lag("o_orderkey", k).over(w) for k in (1, 2, 3)]
    o = o.withColumns({f"before{k}": b for k, b in enumerate(before, 1)})
    verdict = F.element_at(F.array(*map(F.lit, ("supersede", "refine", "duplicate", "conflict", "conflict"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    target = F.when(key % 10 == 7, None).otherwise(F.element_at(F.array("before1", "before2", "before3"), (key % 3 + 1).cast("int")))
    kind = F.element_at(F.array(*map(F.lit, ("user-instruction", "agent-proposal", "pr-review"))), (key % 3 + 1).cast("int"))
    durability = F.when(key % 13 == 0, "one_off").when(key % 4 == 0, "unclear").otherwise("durable")
    until = F.when(key % 6 == 1, F.to_date("o_orderdate").cast("string"))
    cascade = F.array_compact(F.array("before2", "before3"))
    rows = o.select(F.col("o_custkey").alias("pool"), key.alias("id"), "o_orderdate", verdict.alias("verdict"), target.alias("target"), ((key * 7 % 100) / 100).alias("confidence"), (key % 5 != 0).alias("merged"), kind.alias("kind"), F.concat(F.lit("A"), key % 2).alias("actor"), durability.alias("durability"), (key % 11 == 0).alias("held"), until.alias("until"), cascade.alias("cascade"))
    return apply_candidates(rows, ["o_orderdate", "id"])


#: The fold as a recursion; a pool's live rules are a list of structs.
ER02 = """
    WITH RECURSIVE b AS (
        SELECT *, lag(o_orderkey) OVER w AS b1, lag(o_orderkey, 2) OVER w AS b2, lag(o_orderkey, 3) OVER w AS b3, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    r AS (
        SELECT o_custkey AS pool, n, o_orderkey AS id, ['supersede', 'refine', 'duplicate', 'conflict', 'conflict'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS verdict, CASE WHEN o_orderkey % 10 <> 7 THEN [b1, b2, b3][o_orderkey % 3 + 1] END AS wanted,
            (o_orderkey * 7 % 100) / 100 AS confidence, o_orderkey % 5 <> 0 AS merged, [4, 2, 3][o_orderkey % 3 + 1] AS power, o_orderkey % 3 = 0 AS person, o_orderkey % 2 AS actor, o_orderkey % 13 = 0 AS oneoff, o_orderkey % 4 <> 0 AS durable, o_orderkey % 11 = 0 AS held,
            CASE WHEN o_orderkey % 6 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS until, list_filter([b2, b3], lambda x: x IS NOT NULL) AS cascade FROM b),
    f AS (
        SELECT DISTINCT pool, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS relation, NULL::BIGINT AS target, NULL::VARCHAR AS status, []::BIGINT[] AS supersedes, []::BIGINT[] AS conflict_with, []::BIGINT[] AS review, '' AS note,
            []::STRUCT(id BIGINT, power INT, actor BIGINT, status VARCHAR, until VARCHAR, partners BIGINT[])[] AS live FROM r
        UNION ALL
        SELECT pool, n, id, relation, CASE WHEN oneoff OR t IS NULL THEN NULL ELSE wanted END, CASE WHEN oneoff THEN NULL WHEN stays THEN t.status WHEN len(links) > 0 THEN 'conflict' ELSE made END, supersedes, links, review, note,
            CASE WHEN oneoff OR stays THEN live ELSE list_transform(list_filter(live, lambda x: NOT list_contains(gone, x.id)),
                lambda x: {'id': x.id, 'power': x.power, 'actor': x.actor, 'status': CASE WHEN list_contains(links, x.id) THEN 'conflict' ELSE x.status END, 'until': x.until,
                    'partners': CASE WHEN list_contains(links, x.id) THEN list_distinct(list_filter(x.partners, lambda y: NOT list_contains(gone, y)) || [id]) ELSE x.partners END})
                || [{'id': id, 'power': power, 'actor': actor, 'status': CASE WHEN len(links) > 0 THEN 'conflict' ELSE made END, 'until': coalesce(until, CASE WHEN relation IN ('duplicate', 'refine') THEN t.until END), 'partners': links}] END
        FROM (
            SELECT *, CASE WHEN oneoff OR stays THEN []::BIGINT[] ELSE list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(live, lambda x: list_contains(gone, x.id)), lambda x: x.partners)) || CASE WHEN relation = 'conflict' THEN [wanted] ELSE [] END, lambda y: NOT list_contains(gone, y)))) END AS links
            FROM (
                SELECT *, CASE WHEN oneoff OR stays OR t IS NULL OR relation = 'conflict' OR (relation = 'new' AND t.status <> 'proposed') THEN []::BIGINT[] WHEN t.status = 'proposed' OR (relation = 'refine' AND NOT person) THEN [wanted] ELSE list_sort([wanted] || t.partners) END AS gone,
                    CASE WHEN oneoff OR stays OR t IS NULL OR t.status = 'proposed' OR relation IN ('conflict', 'new') THEN []::BIGINT[] WHEN relation = 'refine' AND NOT person THEN [wanted] ELSE list_sort([wanted] || t.partners) END AS supersedes,
                    CASE WHEN relation IN ('duplicate', 'refine', 'supersede') OR (durable AND confidence >= 0.6 AND NOT held) OR (t.status = 'proposed' AND verdict = 'supersede') THEN 'active' ELSE 'proposed' END AS made,
                    CASE WHEN oneoff OR t IS NULL OR t.status = 'proposed' OR relation NOT IN ('refine', 'supersede') THEN []::BIGINT[] ELSE list_sort(list_filter(cascade, lambda y: len(list_filter(live, lambda x: x.id = y AND x.status = 'active')) > 0)) END AS review,
                    CASE WHEN oneoff OR t IS NULL OR stays THEN '' WHEN t.status = 'proposed' THEN CASE WHEN relation = 'new' THEN 'replaced an unconfirmed proposal' ELSE 'confirmed a proposal' END WHEN relation <> 'duplicate' THEN '' WHEN t.status = 'conflict' THEN 'settled a conflict' ELSE 'end date ' || until END AS note
                FROM (
                    SELECT *, coalesce(NOT oneoff AND relation = 'duplicate' AND t.status = 'active' AND (until IS NULL OR until IS NOT DISTINCT FROM t.until), false) AS stays
                    FROM (
                        SELECT *, CASE WHEN oneoff THEN 'dropped' WHEN t IS NULL THEN 'new' WHEN verdict = 'duplicate' AND confidence < 0.5 THEN 'new' WHEN t.status = 'proposed' THEN CASE WHEN verdict IN ('duplicate', 'refine') THEN verdict ELSE 'new' END
                            WHEN verdict = 'duplicate' THEN 'duplicate' WHEN verdict = 'refine' THEN CASE WHEN may AND merged THEN 'refine' WHEN may THEN 'duplicate' ELSE 'new' END
                            WHEN may AND (settles OR actor = t.actor OR (verdict = 'supersede' AND confidence >= 0.6 AND actor = t.actor)) THEN 'supersede' ELSE 'conflict' END AS relation
                        FROM (
                            SELECT *, t.status = 'conflict' AND person AS settles, (t.status = 'conflict' AND person) OR power >= t.power AS may
                            FROM (SELECT f.live, r.*, CASE WHEN held THEN NULL ELSE list_filter(f.live, lambda x: x.id = r.wanted)[1] END AS t FROM f JOIN r ON r.pool = f.pool AND r.n = f.n + 1)))))))
    SELECT pool, id, relation, target, status, array_to_string(supersedes, ',') AS supersedes, array_to_string(conflict_with, ',') AS conflict_with, array_to_string(review, ',') AS review, note FROM f WHERE n > 0
"""


def rejudge(pending: DataFrame, items: DataFrame, most: int = 5) -> DataFrame:
    """(id, action, attempts): what a run does with the candidates that wait for a model, oldest first in each pool.

    ``pending`` has pool, id, at, attempts, answer (ok, deferred, failed); ``items`` id, local, archived.
    What is settled meanwhile is dropped; the run stops before the first that the hourly limit defers and
    after the first that fails; a candidate that failed too often is given up.
    """
    rows = pending.join(items, "id", "left")
    gone = ~F.coalesce("local", F.lit(False)) | F.coalesce("archived", F.lit(False))
    before = Window.partitionBy("pool").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    stops = F.when(~gone & F.col("answer").isin("deferred", "failed"), 1)
    marked = rows.withColumn("gone", gone).withColumn("over", F.count(stops).over(before) > 0)
    tried = F.col("attempts") + 1
    action = F.when(F.col("over"), "waits").when(F.col("gone"), "dropped").when(F.col("answer") == "deferred", "waits").when(F.col("answer") == "ok", "applied").when(tried >= most, "given up").otherwise("kept")
    return marked.select("pool", "id", action.alias("action"), F.when(F.col("over") | F.col("gone") | (F.col("answer") == "deferred"), F.col("attempts")).otherwise(tried).alias("attempts"))


def er03_rejudged(spark: SparkSession, sf: str) -> DataFrame:
    o, key = table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("o_orderkey")
    pending = o.select(F.col("o_custkey").alias("pool"), key.alias("id"), F.col("o_orderdate").alias("at"), (key % 6).alias("attempts"), F.when(key % 7 == 0, "deferred").when(key % 7 == 1, "failed").otherwise("ok").alias("answer"))
    return rejudge(pending, o.filter(key % 9 != 0).select(key.alias("id"), (key % 5 != 0).alias("local"), (key % 8 == 0).alias("archived")))


ER03 = """
    WITH p AS (SELECT o_custkey AS pool, o_orderkey AS id, o_orderdate AS at_, o_orderkey % 6 AS attempts, o_orderkey % 7 AS answer, NOT (o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 8 <> 0) AS gone FROM orders WHERE o_orderstatus = 'P'),
    s AS (SELECT pool, min((at_, id)) AS stop FROM p WHERE NOT gone AND answer < 2 GROUP BY pool)
    SELECT p.pool, p.id, CASE WHEN (at_, p.id) > stop THEN 'waits' WHEN gone THEN 'dropped' WHEN answer = 0 THEN 'waits' WHEN answer > 1 THEN 'applied' WHEN attempts >= 4 THEN 'given up' ELSE 'kept' END AS action,
        CASE WHEN coalesce((at_, p.id) > stop, false) OR gone OR answer = 0 THEN attempts ELSE attempts + 1 END AS attempts FROM p LEFT JOIN s ON s.pool = p.pool
"""


def er05_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of a session in batches of five for a model; one that has failed before goes alone."""
    e = table(spark, sf, "events").filter("event_type = 'view'").withColumn("failed", F.col("value") < 10)
    nth = F.row_number().over(Window.partitionBy("user_id", "failed").orderBy("ts", "event_id"))
    batch = F.when(F.col("failed"), F.concat(F.lit("alone "), "event_id")).otherwise(F.concat(F.lit("batch "), F.floor((nth - 1) / 5)))
    return e.select("user_id", "event_id", batch.alias("batch"))


ER05 = """
    WITH v AS (SELECT *, coalesce(count(*) FILTER (value >= 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM events WHERE event_type = 'view')
    SELECT user_id, event_id, CASE WHEN value < 10 THEN 'alone ' || event_id ELSE 'batch ' || earlier // 5 END AS batch FROM v
"""
#: message, quote, statement, reply before -> what becomes of an extracted candidate.
EXTRACTED = [
    (f"Always use tabs {KEY}", "use tabs", "Use tabs", None, "kept"), ("Always use tabs", "use spaces", "Use spaces", None, "dropped"), ("Always use a cache", "use a cache", "Use Redis7 as the cache", None, "proposed"), ("ok", "ok", "Use RFC7807", "Shall I use RFC7807?", "kept"), ("```\nuse x9\n```", "use x9", "Use x9", None, "dropped"),
]


def extracted(message: str, quote: str, statement: str, reply: str | None) -> str:
    """An extracted rule needs its quote; one that names what nobody said is only proposed."""
    if not S.quote_valid(message, quote):
        return "dropped"
    return "proposed" if S.unsupported_terms(statement, "\n".join(filter(None, (message, reply)))) else "kept"


#: A model's answer -> statement, enforcement, durability, confidence of its first usable item.
RECORDS = [
    (f'{{"items": [{{"message": 1, "statement": " Use tabs {KEY} ", "evidence_quote": "tabs", "enforcement": "must", "durability": "durable", "audience": "team", "confidence": 0.9}}]}}', f"Use tabs {KEY}", "must", "durable", "0.9"), ('{"items": [{"statement": "x", "evidence_quote": ""}, {"message": "2", "statement": "y", "evidence_quote": "y", "durability": "durable", "confidence": "7"}]}', "y", "should", "unclear", "1.0"),
    ('{"items": [{"message": 1, "statement": "z", "evidence_quote": "z", "durability": "one_off", "confidence": -3}]}', "z", "should", "one_off", "0.0"), ('{"items": "none"}', None, None, None, None), ("not json", None, None, None, None), ('{"items": [3]}', None, None, None, None), ('{"items": []}', None, None, None, None), ('{"items": [{"message": 1, "statement": "w", "evidence_quote": "w", "enforcement": "maybe"}]}', "w", "should", "unclear", "0.5"),
]


def first_record(text: str) -> dict[str, str | None]:
    """The first usable item of an answer; what is missing or odd takes its default, and an unclear class is never durable."""
    import json
    import math

    def number(value: object) -> float | None:
        try:
            found = float(value) if not isinstance(value, (bool, list, dict)) and value not in (None, "") else None
        except ValueError:
            return None
        return found if found is None or math.isfinite(found) else None

    none = dict.fromkeys(("statement", "enforcement", "durability", "confidence"))
    try:
        items = json.loads(text)["items"]
    except (ValueError, KeyError, TypeError):
        return none
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return none
    said = lambda x, k: x[k].strip() if isinstance(x.get(k), str) else ""
    for x in items:
        if said(x, "statement") and said(x, "evidence_quote") and number(x.get("message")) is not None:
            sure = number(x.get("confidence"))
            durability = x["durability"] if x.get("durability") in ("durable", "one_off", "unclear") else "unclear"
            whole = x.get("durability") == durability and x.get("audience") in ("team", "personal") and sure is not None
            return {
                "statement": said(x, "statement"), "enforcement": x["enforcement"] if x.get("enforcement") in ("must", "should", "info") else "should", "durability": durability if whole or durability == "one_off" else "unclear",
                "confidence": str(0.5 if sure is None else min(1.0, max(0.0, sure))),
            }
    return none


def record_case(text: Column) -> Column:
    from .wordings import pair

    return pair(first_record, statement="string", enforcement="string", durability="string", confidence="string")(text)


# ---- overlap, anchors ----------------------------------------------------------------------------


def overlapping(rules: DataFrame, top: int = X.OVERLAP_TOP, least: float = X.OVERLAP_MIN, strong: float = X.OVERLAP_STRONG) -> DataFrame:
    """(a, b, score): rules worded almost alike that name different things, each pair once, the ``top`` best.

    ``rules`` has id and text.  Each rule looks at its three nearest; pairs that nearly share all words are
    listed even where nothing differs.  Rules of equal tokens are looked up together: of those that stand
    for one wording only the first few can be among anyone's nearest.
    """
    few = X.OVERLAP_PER_RULE
    pairs, members = overlap.similar_pairs(rules, least)
    members = checkpointed(members)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("member"))
    first = members.withColumn("nth", nth).filter(F.col("nth") <= few + 1).select(F.col("id").alias("of"), F.col("member").alias("other"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("of"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("of"), "score"))
    own = members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.col("id").alias("of"), F.lit(1.0).alias("score"))
    near = members.join(both.unionByName(own), "id").join(first, "of").filter("member <> other")
    best = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "other"))
    kept = near.withColumn("best", best).filter(F.col("best") <= few)
    found = kept.groupBy(F.least("member", "other").alias("a"), F.greatest("member", "other").alias("b")).agg(F.max("score").alias("score"))
    said = rules.select("id", T.negated(F.col("text")).alias("neg"), T.key_terms(F.col("text")).alias("terms"))
    named = found.join(said.toDF("a", "na", "ta"), "a").join(said.toDF("b", "nb", "tb"), "b")
    return named.filter((F.col("score") >= strong) | (F.col("na") != F.col("nb")) | (F.col("ta") != F.col("tb"))).select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(top)


def so07_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The ten pairs of parts' names and types that overlap most."""
    return overlapping(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type"), "p_size").alias("text")))


SO07 = f"""
    WITH r AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) || ' ' || p_size AS text FROM part), d AS (SELECT DISTINCT id, tok FROM (SELECT id, unnest({T.DUCK_TOKENS.format(c='text')}) AS tok FROM r)), n AS (SELECT greatest(1, count(*)) AS n FROM r),
    w AS (SELECT tok, ln(1 + n.n / count(*)) AS w FROM d, n GROUP BY tok, n.n), s AS (SELECT id, sum(w) AS s FROM d JOIN w USING (tok) GROUP BY id),
    p AS (SELECT x.id AS pid, y.id AS id, round(sum(w.w) / sqrt(any_value(a.s) * any_value(b.s)), 5) AS score FROM d x JOIN d y ON x.tok = y.tok AND x.id <> y.id JOIN w ON w.tok = x.tok JOIN s a ON a.id = x.id JOIN s b ON b.id = y.id GROUP BY x.id, y.id),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) AS nth FROM p WHERE score >= 0.6) WHERE nth <= 3),
    u AS (SELECT least(pid, id) AS a, greatest(pid, id) AS b, max(score) AS score FROM t GROUP BY 1, 2)
    SELECT a, b, score FROM u JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE score >= 1 OR list_sort(list_distinct(string_split(x.text, ' '))) <> list_sort(list_distinct(string_split(y.text, ' '))) ORDER BY score DESC, a, b LIMIT 10
"""


def anchors(rules: DataFrame, vocabulary: DataFrame, files: DataFrame) -> DataFrame:
    """(id, terms, globs): what of a rule's names and globs the repository has; ``rules`` has id, names, globs.

    A name that ends in js is also looked for without that.
    """
    bare = F.regexp_replace(F.regexp_replace("name", r"\.js$", ""), "js$", "")
    named = rules.select("id", F.explode("names").alias("name"))
    known = vocabulary.select(F.col("name").alias("known")).distinct()
    direct = named.join(known, F.col("name") == F.col("known")).select("id", "known")
    short = named.join(known, F.col("name") == F.col("known"), "left_anti").withColumn("bare", bare).join(known, F.col("bare") == F.col("known")).select("id", "known")
    terms = direct.unionByName(short).distinct().groupBy("id").agg(F.array_sort(F.collect_list("known")).alias("terms"))
    globs = rules.select(F.explode("globs").alias("glob")).distinct().withColumn("pattern", column(path_regex, "string")(F.col("glob"))).withColumn("at", F.regexp_extract("glob", r"^([^*?{\[/]+)/", 1))
    heads = files.select("path", F.explode(F.array(F.lit(""), F.substring_index("path", "/", 1))).alias("at"))
    held = globs.join(heads, "at").filter("path RLIKE pattern").select("glob").distinct()
    kept = rules.select("id", F.explode("globs").alias("glob")).join(held, "glob").groupBy("id").agg(F.array_sort(F.collect_list("glob")).alias("held"))
    return rules.select("id").join(terms, "id", "left").join(kept, "id", "left").select("id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("held", F.array().cast("array<string>")).alias("globs"))


def stale_reasons(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(id, stale): which recorded anchors are gone, three of them at most; null where all are still there.

    Both sides have id, terms and globs; ``now`` is what ``anchors`` finds for the recorded ones.
    """
    both = recorded.join(now.select("id", F.col("terms").alias("t"), F.col("globs").alias("g")), "id", "left")
    gone = F.concat(F.array_except("terms", F.coalesce("t", F.array().cast("array<string>"))), F.array_except("globs", F.coalesce("g", F.array().cast("array<string>"))))
    shown = F.array_join(F.transform(F.slice(gone, 1, 3), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    return both.select("id", F.when(F.size(gone) > 0, F.concat(F.lit("check needed: "), shown, F.lit(" no longer in the repository"))).alias("stale"))


def tx16_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Rules made from parts that name two words and a glob each; a vocabulary and files made from the larger parts."""
    p = table(spark, sf, "part")
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    rules = p.select(F.col("p_partkey").alias("id"), F.array(word(1), F.concat(word(2), F.lit(".js"))).alias("names"), F.array(F.concat(F.lower("p_type"), F.lit("/*"), F.col("p_size") % 10, F.lit(".py"))).alias("globs"))
    vocabulary = p.filter("p_size > 40 AND p_name LIKE '%g%'").select(F.explode(F.split("p_name", " ")).alias("name"))
    files = p.filter("p_size > 46").select(F.concat(F.lower("p_type"), F.lit("/f"), "p_size", F.lit(".py")).alias("path"))
    now = anchors(rules, vocabulary, files)
    recorded = rules.select("id", F.slice("names", 1, 1).alias("terms"), "globs")
    return now.select("id", F.array_join("terms", ",").alias("terms"), F.array_join("globs", ",").alias("globs")).join(stale_reasons(recorded, now), "id")


TX16 = """
    WITH p AS (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, lower(p_type) || '/*' || p_size % 10 || '.py' AS pattern FROM part), v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 40 AND contains(p_name, 'g')), f AS (SELECT DISTINCT lower(p_type) AS d, p_size AS n FROM part WHERE p_size > 46),
    x AS (SELECT p.*, EXISTS (SELECT 1 FROM v WHERE w = a) AS has_a, EXISTS (SELECT 1 FROM v WHERE w = b) AS has_b, EXISTS (SELECT 1 FROM f WHERE d = lower(p_type) AND n % 10 = p_size % 10) AS has_g FROM p)
    SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN has_a THEN a END, CASE WHEN has_b THEN b END], lambda y: y IS NOT NULL))), ',') AS terms, CASE WHEN has_g THEN pattern ELSE '' END AS globs,
        CASE WHEN NOT (has_a AND has_g) THEN 'check needed: ' || array_to_string(list_filter([CASE WHEN NOT has_a THEN '`' || a || '`' END, CASE WHEN NOT has_g THEN '`' || pattern || '`' END], lambda y: y IS NOT NULL), ', ') || ' no longer in the repository' END AS stale FROM x
"""

# ---- models --------------------------------------------------------------------------------------


def model_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as models that tools offer: a name, an effort, a known price for a third of them, a pinned one."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit("acme/"), F.lower("p_type"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), k)
    effort = F.element_at(F.array(*map(F.lit, ("none", "low", "high", ""))), (k % 4 + 1).cast("int"))
    known = F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 10.0)
    return p.select(k.alias("id"), F.when(k % 2 == 0, "codex").otherwise("claude").alias("provider"), name.alias("model"), effort.alias("effort"), F.when(F.col("p_size") == 50, "pinned").when(F.col("p_size") == 49, "auto").otherwise("listed").alias("source"), known.alias("known_in"), (known * 5).alias("known_out"))


def ranked_models(offers: DataFrame) -> DataFrame:
    """Adds tier and cost, leaves out models for other uses; ``place`` is the order in which a provider's are tried."""
    tier = models.tier_hint(F.col("model"))
    priced = offers.filter(~models.excluded(F.col("model"))).withColumn("tier", tier)
    cost = models.estimated_cost(F.col("provider"), F.col("tier"), F.lit("usd"), F.col("effort"), F.col("known_in"), F.col("known_out"), F.col("source") == "auto")
    rank = F.when(F.col("tier") == "small", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    order = [F.when(F.col("source") == "pinned", 0).otherwise(1), F.col("cost"), F.col("known_in").isNull(), rank, F.col("id")]
    return priced.withColumn("cost", F.round(cost, 9)).withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(*order)))


def so06_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_models(model_offers(spark, sf)).filter("place <= 25").select("provider", "place", "id", "tier", "cost")


OFFERS = """
    m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'codex' ELSE 'claude' END AS provider, p_partkey % 4 AS form, p_size, CASE WHEN p_type IN ('SMALL', 'ECONOMY') OR starts_with(p_name, 'small') THEN 'small' ELSE 'medium' END AS tier FROM part),
    c AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 WHEN p_size = 49 THEN 0.45 WHEN tier = 'small' THEN 0.3 ELSE 2 END AS pi, CASE WHEN p_size % 3 = 0 THEN p_size / 2.0 WHEN p_size = 49 THEN 2.25 WHEN tier = 'small' THEN 1.5 ELSE 10 END AS po FROM m),
    k AS (SELECT *, round((pi * (CASE provider WHEN 'codex' THEN 7000 ELSE 6000 END + 3000) + po * (600 + [0, 800, 7000, 2500][form + 1])) / 1000000, 9) AS cost FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN p_size = 50 THEN 0 ELSE 1 END, cost, p_size % 3 <> 0, CASE tier WHEN 'small' THEN 0 ELSE 1 END, id) AS place FROM k)
"""
SO06 = f"WITH {OFFERS} SELECT provider, place, id, tier, cost FROM o WHERE place <= 25"


def route(offers: DataFrame, verdicts: DataFrame, blocks: DataFrame, now: Column, days: int = 30, error_hours: int = 6) -> DataFrame:
    """(provider, task, id): the cheapest candidate that passed a task's suite and still counts.

    ``verdicts`` has id, task, status, at, current, strikes; one counts while it is fresh, of the suite and
    tool in use, and not struck twice since.  ``blocks`` has provider and until: a provider is left out
    until then.  Pinned models need no verdict.
    """
    open_ = ranked_models(offers).join(blocks.filter(F.col("until") > now).select("provider"), "provider", "left_anti")
    fresh = F.col("at") >= now - F.when(F.col("status") == "error", F.expr(f"INTERVAL {error_hours} HOURS")).otherwise(F.expr(f"INTERVAL {days * 24} HOURS"))
    passed = verdicts.filter(fresh & F.col("current") & (F.col("status") == "pass") & (F.col("strikes") < X.QUALITY_STRIKES)).select("id", "task")
    tasks = verdicts.select("task").distinct()
    pinned = open_.filter("source = 'pinned'").select("id").withColumn("task", F.explode(F.array(*[F.lit(r["task"]) for r in tasks.collect()])))  # a handful of tasks
    able = open_.join(passed.unionByName(pinned).distinct(), "id")
    return able.groupBy("provider", "task").agg(F.min_by("id", "place").alias("id"))


def ct06_routes(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    at = now - F.make_interval(days=(k % 60).cast("int"))
    rows = p.select(k.alias("id"), F.element_at(F.array(F.lit("extract"), F.lit("judge")), (k % 2 + 1).cast("int")).alias("task"), F.when(k % 5 == 0, "fail").when(k % 5 == 1, "error").otherwise("pass").alias("status"), at.alias("at"), (k % 7 != 0).alias("current"), (k % 3).alias("strikes"))
    rows = rows.unionByName(rows.withColumn("task", F.when(F.col("task") == "judge", "extract").otherwise("judge")).filter("id % 4 = 0"))
    blocks = spark.sql("SELECT 'codex' AS provider, TIMESTAMP_NTZ '2024-01-31 23:00:00' AS until UNION ALL SELECT 'kiro', TIMESTAMP_NTZ '2024-02-02 00:00:00'")
    return route(model_offers(spark, sf).filter("source <> 'pinned' OR id % 2 = 1"), rows, blocks, now)


CT06 = f"""
    WITH {OFFERS}, v AS (SELECT p_partkey AS id, ['extract', 'judge'][p_partkey % 2 + 1] AS task FROM part UNION ALL SELECT p_partkey, ['judge', 'extract'][p_partkey % 2 + 1] FROM part WHERE p_partkey % 4 = 0),
    q AS (SELECT v.id, v.task FROM v WHERE id % 5 > 1 AND id % 60 <= 30 AND id % 7 <> 0 AND id % 3 < 2 UNION SELECT m.id, t.task FROM m, (VALUES ('extract'), ('judge')) t(task) WHERE p_size = 50 AND m.id % 2 = 1)
    SELECT provider, task, arg_min(o.id, place) AS id FROM o JOIN q ON q.id = o.id WHERE NOT (p_size = 50 AND o.id % 2 = 0) GROUP BY ALL
"""


def ad13_validity(spark: SparkSession, sf: str) -> DataFrame:
    """The last verdict of each model (session) and task: whether it still counts, and whether answers have struck it down since."""
    e = table(spark, sf, "events").withColumn("task", F.expr("cast(get_json_object(props, '$.k') AS int) % 3"))
    at = F.struct("ts", "event_id")
    last = e.filter("event_type IN ('purchase', 'error')").groupBy("user_id", "task").agg(F.max_by(F.struct("ts", "event_type", "value"), at).alias("v"), F.max(at).alias("since"))
    fresh = F.col("v.ts") >= F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.when(F.col("v.event_type") == "error", F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 480 HOURS"))
    good = e.filter("event_type = 'click'").groupBy("user_id", "task").agg(F.max(at).alias("good"))
    bad = e.filter("event_type = 'view' AND value < 50").select("user_id", "task", at.alias("bad"))
    struck = bad.join(last.select("user_id", "task", "since"), ["user_id", "task"]).join(good, ["user_id", "task"], "left").filter("bad > since AND (good IS NULL OR bad > good)").groupBy("user_id", "task").agg(F.count("*").alias("strikes"))
    every = last.join(struck, ["user_id", "task"], "left")
    demoted = F.coalesce(F.col("strikes") >= X.QUALITY_STRIKES, F.lit(False)) & (F.col("v.event_type") == "purchase")
    return every.select("user_id", "task", (fresh & (F.col("v.value") > 5)).alias("valid"), demoted.alias("demoted"))


AD13 = """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS task FROM events),
    l AS (SELECT user_id, task, max((ts, event_id)) AS since, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value, max(ts) AS last FROM e WHERE event_type IN ('purchase', 'error') GROUP BY ALL)
    SELECT user_id, task, last >= TIMESTAMP '2024-01-31' - CASE WHEN kind = 'error' THEN INTERVAL '24 hours' ELSE INTERVAL '480 hours' END AND value > 5 AS valid,
        kind = 'purchase' AND (SELECT count(*) FROM e WHERE e.user_id = l.user_id AND e.task = l.task AND e.event_type = 'view' AND e.value < 50 AND (e.ts, e.event_id) > l.since AND NOT EXISTS (SELECT 1 FROM e g WHERE g.user_id = l.user_id AND g.task = l.task AND g.event_type = 'click' AND (g.ts, g.event_id) > (e.ts, e.event_id))) >= 2 AS demoted FROM l
"""

# ---- decoded state, blocks, diagnostics ----------------------------------------------------------


def ad02_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that wait for a judge, kept as JSON beside other keys: what cannot be read is passed over, the oldest first in each session."""
    e, k = table(spark, sf, "events"), F.expr("cast(get_json_object(props, '$.k') AS int)")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"statement": "rule '), "event_id", F.lit('", "attempts": '), k % 3, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"statement": "rule '), "event_id", F.lit('"}'))).when(k % 4 == 2, "{broken").otherwise('{"attempts": 2}')
    kept = e.filter("event_type IN ('view', 'click')").select("user_id", "ts", F.concat(F.when(F.col("event_type") == "view", "judge:").otherwise("other:"), "event_id").alias("key"), text.alias("value"))
    read = kept.filter(F.startswith("key", F.lit("judge:"))).withColumn("c", F.from_json("value", "statement string, attempts int", {"mode": "PERMISSIVE"})).filter("c.statement IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "key"))
    return read.select("user_id", F.substring("key", 7, 20).cast("long").alias("event_id"), "c.statement", F.coalesce("c.attempts", F.lit(0)).alias("attempts"), place.alias("place"))


AD02 = """
    WITH v AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'view')
    SELECT user_id, event_id, 'rule ' || event_id AS statement, (CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END)::INT AS attempts, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'judge:' || event_id) AS place FROM v WHERE k % 4 < 2
"""


def ad16_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Personal rules, open conflicts and recent changes of each customer under one shrinking budget of tokens."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", (3 + F.col("o_orderkey") % 9).alias("cost"))
    personal = o.filter("o_orderpriority = '5-LOW' AND o_orderstatus = 'O'").withColumn("block", F.lit(1)).withColumn("rank", F.col("o_orderkey"))
    conflicts = o.filter("o_orderstatus = 'P'").withColumn("block", F.lit(2)).withColumn("rank", F.col("o_orderkey"))
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    recent = o.filter("o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").withColumn("block", F.lit(3)).withColumn("rank", newest.cast("long")).filter("rank <= 5")
    rows = union(*[f.select("o_custkey", "block", "rank", "o_orderkey", "cost") for f in (personal, conflicts, recent)])
    return pack_blocks(rows, "o_custkey", "block", ["rank", "o_orderkey"], "cost", 30, 4).select("o_orderkey", "block", "taken")


AD16 = """
    WITH RECURSIVE x AS (
        SELECT o_custkey, 1 AS block, o_orderkey AS rank, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2, o_orderkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT * FROM (SELECT o_custkey, 3, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01') WHERE rank <= 5),
    r AS (SELECT o_custkey AS k, block AS b, o_orderkey AS id, 3 + o_orderkey % 9 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY block, rank, o_orderkey) AS n FROM x),
    f AS (
        SELECT k, n, id, b, c <= 26 AS taken, CASE WHEN c <= 26 THEN 26 - c ELSE 30 END AS remaining, CASE WHEN c <= 26 THEN 26 - c ELSE 26 END AS room, c <= 26 AS opened FROM r WHERE n = 1
        UNION ALL
        SELECT k, n, id, b, c <= base, CASE WHEN c <= base THEN remaining - c - CASE WHEN was THEN 0 ELSE 4 END ELSE remaining END, CASE WHEN c <= base THEN base - c ELSE base END, was OR c <= base
        FROM (SELECT r.k, r.n, r.id, r.b, r.c, f.remaining, CASE WHEN r.b = f.b THEN f.room ELSE f.remaining - 4 END AS base, r.b = f.b AND f.opened AS was FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1))
    SELECT id AS o_orderkey, b AS block, taken FROM f
"""


def ad17_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics in groups, a row for each check: what was counted, how much of it is wrong, and how that is judged."""
    docs, events, labels, pages, orders = (table(spark, sf, t) for t in ("documents", "events", "labels", "pages", "orders"))
    one = lambda group, name, frame, wrong, most: frame.agg(F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("wrong")).select(F.lit(group).alias("area"), F.lit(name).alias("name"), "n", "wrong", F.when(F.col("wrong") == 0, "ok").when(F.col("wrong") * most <= F.col("n"), "note").otherwise("problem").alias("state"))
    orphans = labels.join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit(True).alias("orphan"))
    checks = (
        one("rules", "empty texts", docs, F.coalesce(F.length("text"), F.lit(0)) == 0, 10), one("rules", "repeated texts", docs.groupBy(F.sha2("text", 256).alias("h")).count(), F.col("count") > 1, 5), one("rules", "labels without a rule", orphans, F.col("orphan"), 10),
        one("events", "failed", events, F.col("event_type") == "error", 4), one("events", "without a session", events, F.col("user_id").isNull(), 10), one("index", "unread files", pages, F.coalesce(F.length("html"), F.lit(0)) == 0, 10), one("queue", "waiting over a year", orders.filter("o_orderstatus = 'P'"), F.col("o_orderdate") < F.lit("2000-08-01").cast("timestamp_ntz"), 2),
    )
    return union(*checks)


AD17 = """
    WITH c AS (
        SELECT 'rules' AS area, 'empty texts' AS name, count(*) AS n, count(*) FILTER (coalesce(length(text), 0) = 0) AS wrong, 10 AS most FROM documents UNION ALL SELECT 'rules', 'repeated texts', count(*), count(*) FILTER (k > 1), 5 FROM (SELECT count(*) AS k FROM documents GROUP BY text)
        UNION ALL SELECT 'rules', 'labels without a rule', count(*), count(*), 10 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'events', 'failed', count(*), sum((event_type = 'error')::INT)::BIGINT, 4 FROM events
        UNION ALL SELECT 'events', 'without a session', count(*), count(*) - count(user_id), 10 FROM events UNION ALL SELECT 'index', 'unread files', count(*), count(*) FILTER (coalesce(html, '') = ''), 10 FROM pages UNION ALL SELECT 'queue', 'waiting over a year', count(*), count(*) FILTER (o_orderdate < TIMESTAMP '2000-08-01'), 2 FROM orders WHERE o_orderstatus = 'P')
    SELECT area, name, n, wrong, CASE WHEN wrong = 0 THEN 'ok' WHEN wrong * most <= n THEN 'note' ELSE 'problem' END AS state FROM c
"""
NAMES = "inject.core_budget_tokens,llm.qualify_runs,language,git.commit_mode,llm.host_tool,llm.qualify,code_index.exclude"
SETTINGS = [
    ("{}", NAMES, '1500|2|"ko"|"ride-along"|"only"|true|[]'), ('{"inject": {"core_budget_tokens": 5}, "llm": {"qualify_runs": 9, "host_tool": "any", "qualify": false}, "language": "en"}', NAMES, '100|5|"en"|"ride-along"|"any"|false|[]'), ('{"git": {"commit_mode": "typo"}, "language": "fr", "llm": "x"}', NAMES, '1500|2|"ko"|"manual"|"only"|true|[]'),
    ('{"code_index": {"exclude": ["a/**", 3, " "]}, "inject": {"core_budget_tokens": "9"}}', NAMES, '1500|2|"ko"|"ride-along"|"only"|true|["a/**"]'), ("not json", NAMES, '1500|2|"ko"|"ride-along"|"only"|true|[]'),
]
CLAMPS = [("20", "1", "100", 20), ("0", "1", "100", 1), ("500", "1", "100", 100), ("-4", "1", "5", 1), ("3", "1", "5", 3)]

QUERIES = [
    Query("er01_neighbour_verdict", er01_verdicts, ER01),
    Query("er02_relation_application", er02_applied, ER02),
    Query("er03_rejudge_pending", er03_rejudged, ER03),
    Query("er05_extraction_batches", er05_batches, ER05),
    worked("er05_validation", "events", "event_id", ("message", "quote", "statement", "reply"), ("verdict",), EXTRACTED, column(extracted, "string")),
    worked("er06_lenient_records", "events", "event_id", ("text",), ("statement", "enforcement", "durability", "confidence"), RECORDS, record_case),
    Query("so06_model_ranking", so06_ranking, SO06),
    Query("so07_pair_overlap", so07_overlap, SO07),
    Query("tx16_known_anchors", tx16_stale, TX16),
    Query("ct06_cheapest_candidate", ct06_routes, CT06),
    Query("ad02_counter_snapshot", ad02_pending, AD02),
    Query("ad13_strike_demotion", ad13_validity, AD13),
    Query("ad16_three_blocks", ad16_blocks, AD16),
    Query("ad17_diagnostics", ad17_checks, AD17),
    worked("ct08_settings", "events", "event_id", ("text", "names"), ("settings",), SETTINGS, column(config.shown_settings, "string")),
    worked("so05_clamps", "events", "event_id", ("value", "least", "most"), ("clamped",), CLAMPS, lambda v, a, b: F.greatest(F.least(v.cast("int"), b.cast("int")), a.cast("int"))),
]
