"""Sessions and their history: transcripts, bounded reads, history files, earlier sessions, recall, hints.

``events`` stands for the hook log and, written as JSON lines, for transcripts: a view is a prompt, a click a
command, an error or a purchase its result, a sign-up a reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..plans.query import Query, table
from ..sources import transcripts
from . import asof, overlap
from .codegraph import union
from .graph import checkpointed
from .sinks import shared_folder

COMMANDS = ("npm test", "cd app && pytest -q", "npm run build | tail -5", "ls -la", "go vet ./... && go test ./...")
FAILURES = ("src/a.ts: error TS2345: bad", "1 failed", "Process exited with code 1")
K = "cast(get_json_object(props, '$.k') AS int)"


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as JSON lines; a result names the last command of its session before it."""
    e = table(spark, sf, "events").withColumn("k", F.expr(K))
    e = asof.nearest(e, "user_id", "ts", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")), "call")
    pick = lambda texts, by: F.element_at(F.array(*map(F.lit, texts)), (by % len(texts) + 1).cast("int"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    use = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), F.col("event_id")).alias("id"), F.struct(pick(COMMANDS, F.col("k")).alias("command")).alias("input"))
    call = F.to_json(F.struct(stamp, F.struct(F.lit("assistant").alias("role"), F.array(use).alias("content")).alias("message")))
    failed = F.col("event_type") == "error"
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), F.col("call")).alias("tool_use_id"), F.when(failed, pick(FAILURES, F.col("k"))).otherwise("fine").alias("content"), failed.alias("is_error"))
    answer = F.to_json(F.struct(stamp, F.struct(F.array(result).alias("content")).alias("message")))
    prompt = F.to_json(F.struct(stamp, F.lit("user").alias("role"), F.concat(F.lit("ask "), F.col("k")).alias("content")))
    reply = F.to_json(F.struct(stamp, F.lit("assistant").alias("role"), F.concat(F.lit("reply "), F.col("event_id")).alias("content")))
    line = F.when(F.col("event_type") == "view", prompt).when(F.col("event_type") == "click", call).when(F.col("event_type") == "signup", reply).when(F.col("call").isNotNull(), answer).otherwise("no json")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), line.alias("value"))


def sc20_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = transcripts.command_runs(transcripts.objects(transcript_lines(spark, sf)))
    return runs.select(F.col("session").cast("long").alias("session"), "line", "command", "ok", "seen", "signature")


SC20 = """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call FROM events),
    r AS (SELECT user_id, call, arg_max(event_type, event_id) AS kind, arg_max(k % 3, event_id) AS form FROM e WHERE event_type IN ('error', 'purchase') AND call IS NOT NULL GROUP BY ALL),
    c AS (SELECT e.user_id AS session, e.event_id AS line, e.k % 5 AS cmd, r.kind, r.form, CASE r.kind WHEN 'error' THEN false WHEN 'purchase' THEN true END AS went FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.call = e.event_id WHERE e.event_type = 'click'),
    x AS (SELECT *, unnest(CASE cmd WHEN 0 THEN ['npm test'] WHEN 1 THEN ['pytest -q'] WHEN 2 THEN ['npm run build'] WHEN 4 THEN ['go vet ./...', 'go test ./...'] ELSE [] END) AS command FROM c)
    SELECT session, line, command, CASE WHEN cmd = 2 OR (cmd = 4 AND NOT went) THEN NULL ELSE went END AS ok,
        CASE WHEN cmd = 2 THEN CASE WHEN kind = 'error' AND form < 2 THEN false END WHEN cmd = 4 AND NOT went THEN NULL ELSE went END AS seen,
        CASE WHEN cmd <> 4 AND kind = 'error' AND form = 0 THEN 'TS2345' END AS signature FROM x
"""


def sm11_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of the checks in the transcripts: failed, failed again, resolved by a later pass, inferred or not."""
    found = transcripts.cases(transcripts.command_runs(transcripts.objects(transcript_lines(spark, sf))))
    return found.select(F.col("session").cast("long").alias("session"), "command", "failed_at", "resolved_at", "signature", "inferred", "state")


SM11 = f"""
    WITH r AS (SELECT q.*, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', (epoch_us(e.ts) // 1000) % 1000) || 'Z' AS stamp, coalesce(ok, seen) AS p FROM ({SC20}) q JOIN events e ON e.event_id = q.line WHERE coalesce(ok, seen) IS NOT NULL),
    i AS (SELECT *, coalesce(count(*) FILTER (p) OVER (PARTITION BY session, command ORDER BY stamp, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM r)
    SELECT session, command, min(stamp) FILTER (NOT p) AS failed_at, min(stamp) FILTER (p) AS resolved_at, arg_max(CASE WHEN signature IS NULL THEN '-' ELSE signature END, (stamp, line)) FILTER (NOT p) AS signature0, max(ok IS NULL) AS inferred, min(stamp) FILTER (p) IS NOT NULL AS done FROM i GROUP BY session, command, island HAVING min(stamp) FILTER (NOT p) IS NOT NULL
"""
SM11 = f"SELECT session, command, failed_at, resolved_at, nullif(signature0, '-') AS signature, inferred, CASE WHEN done THEN 'resolved' ELSE 'failed' END AS state FROM ({SM11})"


def sc17_tail(lines: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """The last lines of each transcript that fit ``most`` bytes with their line breaks; a line that is cut is dropped."""
    later = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_size", F.sum(F.octet_length(text) + 1).over(later)).filter(F.col("_size") - 1 <= most).drop("_size")


def sc17_tails(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    return sc17_tail(lines, "doc_id", "line", "said", 600).select("doc_id", "line", F.sha2("said", 256).alias("said"))


SC17 = """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    s AS (SELECT *, sum(strlen(said) + 1) OVER (PARTITION BY doc_id ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM l)
    SELECT doc_id, line::INT AS line, sha256(said) AS said FROM s WHERE size - 1 <= 600
"""


def sc18_turns(spark: SparkSession, sf: str) -> DataFrame:
    """What was run and said last between each prompt and the next one: commands once each, twenty at most."""
    lines = transcript_lines(spark, sf)
    prompts = asof.running_count(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "view", "turn").select(F.col("event_id").alias("line"), "turn")
    found = transcripts.objects(lines).join(prompts, "line").filter("turn > 0")
    ran = found.filter("depth > 0 AND size(commands) > 0").select("session", "turn", "line", F.explode("commands").alias("command"))
    last = ran.groupBy("session", "turn", "command").agg(F.max("line").alias("line"))
    kept = last.groupBy("session", "turn").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("line", "command"))))["command"], 1, 20).alias("commands"))
    said = found.filter("prose <> ''").groupBy("session", "turn").agg(F.max_by("prose", "line").alias("reply"))
    every = found.select("session", "turn").distinct().join(kept, ["session", "turn"], "left").join(said, ["session", "turn"], "left")
    return every.select(F.col("session").cast("long").alias("session"), "turn", F.array_join(F.array_sort(F.coalesce("commands", F.array().cast("array<string>"))), "|").alias("commands"), "reply")


SC18 = f"""
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)
    SELECT user_id AS session, turn, coalesce(array_to_string(list_sort(list(DISTINCT [{', '.join("'" + c + "'" for c in COMMANDS)}][k % 5 + 1]) FILTER (event_type = 'click')), '|'), '') AS commands, 'reply ' || max(event_id) FILTER (event_type = 'signup') AS reply
    FROM e WHERE turn > 0 GROUP BY ALL
"""

# ---- history files -------------------------------------------------------------------------------


def fence(text: Column) -> Column:
    """Backticks that stand for a fence: three, or one more than the longest run inside."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def history_entry(number: Column, at: Column, prompt: Column, work: Column, result: Column) -> Column:
    """One entry of a history file."""
    when = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" (+00:00)"))
    told = F.when(result.isNotNull(), F.concat(F.lit("\n\nResult: "), result)).otherwise("")
    return F.concat(F.lit("## "), number.cast("string"), F.lit(". "), when, F.lit("\n\n**Prompt**\n\n"), fence(prompt), F.lit("text\n"), prompt, F.lit("\n"), fence(prompt), F.lit("\n\n**What was done** (change)\n\n"), work, told, F.lit("\n"))


def session_file(start: Column, tool: Column, key: Column) -> Column:
    """Path of a session's history file: a folder for the month, a stamp, the tool, a short digest."""
    safe = F.coalesce(F.nullif(F.lower(F.regexp_replace(tool, "(?i)[^a-z0-9-]", "")), F.lit("")), F.lit("tool"))
    return F.concat(F.lit("history/"), F.date_format(start, "yyyy-MM"), F.lit("/"), F.date_format(start, "yyyy-MM-dd'T'HHmmss'Z'"), F.lit("-"), safe, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", tool, key), 256), 1, 6), F.lit(".md"))


def parse_history(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, number, at, tool, author, prompt, work, result) of every entry in history files.

    Entries are parted by a rule before a numbered heading; the prompt is what stands in its fence, work the
    first line below its label.
    """
    text = F.col(text_col)
    parts = files.select(F.col(path_col).alias("path"), F.trim(F.regexp_extract(text, r"(?m)^# .+? · (.+?) · ", 1)).alias("tool"), F.nullif(F.trim(F.regexp_extract(text, r"(?m)^- Author: (.+)$", 1)), F.lit("")).alias("author"), F.explode(F.split(text, r"\n---\n\n(?=## \d+\. )")).alias("part"))
    parts = parts.filter(F.col("part").rlike(r"(?m)^## \d+\. .+$"))
    got = lambda pattern, k=1: F.regexp_extract("part", pattern, k)
    when = got(r"(?m)^## \d+\. .*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \(([+-]\d{2}:\d{2})\)")
    zone = got(r"(?m)^## \d+\. .*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \(([+-]\d{2}:\d{2})\)", 2)
    at = F.when(when != "", F.to_timestamp_ltz(F.concat(when, zone), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    return parts.select("path", got(r"(?m)^## (\d+)\. ").cast("int").alias("number"), at.alias("at"), "tool", "author", got(r"(?m)^(`{3,})text\n([\s\S]*?)\n\1", 2).alias("prompt"), F.trim(got(r"(?m)^\*\*What was done\*\*[^\n]*\n\n([^\n]*)")).alias("work"), F.nullif(F.trim(got(r"(?m)^Result: (.+)$")), F.lit("")).alias("result"))


def conversation_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of conversations with the reply after each, numbered."""
    said = table(spark, sf, "conversations")
    reply = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("work"))
    asked = said.filter("role = 'user'").join(reply, ["conv_id", "turn"])
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return asked.select("conv_id", "turn", number.alias("number"), at.alias("at"), F.concat(F.lit("``` "), "text").alias("prompt"), "work", F.when(F.col("turn") % 4 == 0, "done").alias("result"))


def sc23_parsed(spark: SparkSession, sf: str) -> DataFrame:
    entries = conversation_entries(spark, sf)
    body = F.array_join(F.array_sort(F.collect_list(F.struct("number", history_entry(*map(F.col, ("number", "at", "prompt", "work", "result"))).alias("entry"))))["entry"], "\n---\n\n")
    head = F.concat(F.lit("# History · Tool A · 2024-01-01 00:00\n\n- Author: someone "), F.col("conv_id").cast("string"), F.lit("\n"))
    files = entries.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").cast("string").alias("path"), F.concat(head, F.lit("\n---\n\n"), "body").alias("text"))
    return parse_history(files).select(F.col("path").cast("long").alias("conv_id"), "number", F.unix_seconds("at").alias("at"), "tool", "author", F.sha2("prompt", 256).alias("prompt"), F.sha2("work", 256).alias("work"), "result")


SC23 = """
    SELECT u.conv_id, (row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn))::INT AS number, 1704067200 + u.conv_id * 3600 + u.turn * 60 AS at, 'Tool A' AS tool, 'someone ' || u.conv_id AS author,
        sha256('``` ' || u.text) AS prompt, sha256(trim(string_split(a.text, chr(10))[1])) AS work, CASE WHEN u.turn % 4 = 0 THEN 'done' END AS result
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
"""


def append_entries(entries: DataFrame, folder: str) -> None:
    """Appends rendered entries below a folder for each month; what is there already stays."""
    entries.select("file", "number", "entry", F.date_format("at", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").parquet(folder)


def sc24_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as entries of their customers' files, appended in two steps and read by month."""
    orders = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    entries = orders.select(session_file(at, F.lit("Tool A!"), F.col("o_custkey").cast("string")).alias("file"), number.alias("number"), at.alias("at"), history_entry(number, at, F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("entry"))
    folder = shared_folder(spark, "history")
    append_entries(entries.filter("number % 2 = 1"), folder)
    append_entries(entries.filter("number % 2 = 0"), folder)
    back = spark.read.option("basePath", folder).parquet(folder)
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("entries"), F.min(F.sha2("entry", 256)).alias("least"), F.max("file").alias("last"))


SC24 = """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS entries,
        min(sha256('## ' || n || '. ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' (+00:00)' || chr(10) || chr(10) || '**Prompt**' || chr(10) || chr(10) || '```text' || chr(10) || o_orderpriority || chr(10) || '```' || chr(10) || chr(10) || '**What was done** (change)' || chr(10) || chr(10) || o_orderstatus || chr(10))) AS least,
        max('history/' || strftime(o_orderdate, '%Y-%m/%Y-%m-%dT%H%M%SZ') || '-toola-' || substr(sha256('Tool A!|' || o_custkey), 1, 6) || '.md') AS last
    FROM o GROUP BY 1
"""


def ad08_target(spark: SparkSession, sf: str) -> DataFrame:
    """The history file of each customer's next order: the current one while it is not committed, else a new one that continues it."""
    orders = table(spark, sf, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    files = orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderdate", F.col("o_orderstatus").alias("status")), at).alias("last"))
    current = session_file(F.col("last.o_orderdate").cast("timestamp"), F.lit("tool"), F.col("o_custkey").cast("string"))
    following = session_file(F.col("last.o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY"), F.lit("tool"), F.col("o_custkey").cast("string"))
    committed = F.col("last.status") == "F"
    return files.select("o_custkey", F.when(committed, following).otherwise(current).alias("file"), F.when(committed, current).alias("continues"))


AD08 = """
    WITH l AS (SELECT o_custkey, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1),
    n AS (SELECT *, '-tool-' || substr(sha256('tool|' || o_custkey), 1, 6) || '.md' AS tail FROM l)
    SELECT o_custkey, 'history/' || strftime(CASE WHEN s = 'F' THEN d + INTERVAL '1 day' ELSE d END, '%Y-%m/%Y-%m-%dT%H%M%SZ') || tail AS file, CASE WHEN s = 'F' THEN 'history/' || strftime(d, '%Y-%m/%Y-%m-%dT%H%M%SZ') || tail END AS continues FROM n
"""

# ---- earlier sessions ----------------------------------------------------------------------------


def previous_sessions(events: DataFrame, days: int = 7) -> DataFrame:
    """(session, begins, previous, ended): the session that was active last before each one began, within ``days``.

    ``events`` has user_id, ts and event_id.  Beginnings are asked in the order of all events, minute by
    minute, so the log is never one sorted task.
    """
    begun = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    place = lambda event, after: F.struct(event.alias("event_id"), F.lit(after).alias("after"))
    known = events.select("ts", place(F.col("event_id"), 1).alias("tie"), F.struct("user_id", "ts").alias("seen"), F.lit(None).cast("long").alias("session"))
    asks = begun.select(F.col("first.ts").alias("ts"), place(F.col("first.event_id"), 0).alias("tie"), F.lit(None).cast(known.schema["seen"].dataType).alias("seen"), F.col("user_id").alias("session"))
    every = known.unionByName(asks).withColumn("all", F.lit(0))
    found = asof.nearest(every, "all", "ts", "tie", F.col("seen"), "before", bucket="minute").filter("session IS NOT NULL")
    return found.filter(F.col("before.ts") >= F.col("ts") - F.expr(f"INTERVAL {days} DAYS")).select("session", F.col("ts").alias("begins"), F.col("before.user_id").alias("previous"), F.col("before.ts").alias("ended"))


def wn04_previous(spark: SparkSession, sf: str) -> DataFrame:
    """For every session the one that was active last before it began, within a week: its span, prompts, first and last three of them."""
    e = checkpointed(table(spark, sf, "events"))
    found = previous_sessions(e)
    rows = found.join(e.select(F.col("user_id").alias("previous"), "ts", "event_id", "event_type"), "previous").filter("ts <= ended")
    prompts = F.array_sort(F.collect_list(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))))["event_id"]
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    told = rows.groupBy("session", "previous", "ended").agg(F.min("ts").alias("started"), F.count(F.when(F.col("event_type") == "view", 1)).alias("prompts"), prompts.alias("ids"))
    return told.select("session", "previous", "ended", "started", "prompts", text(F.slice("ids", 1, 3)).alias("opening"), text(F.slice("ids", F.greatest(F.size("ids") - 2, F.lit(1)), 3)).alias("closing"))


WN04 = """
    WITH b AS (SELECT user_id AS session, min(ts) AS begins, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY 1),
    f AS (SELECT session, begins, arg_max(e.user_id, (e.ts, e.event_id)) AS previous, max(e.ts) AS ended FROM b JOIN events e ON (e.ts, e.event_id) < (b.begins, b.first) GROUP BY ALL HAVING max(e.ts) >= begins - INTERVAL '7 days'),
    r AS (SELECT f.*, e.ts, e.event_id, e.event_type FROM f JOIN events e ON e.user_id = f.previous AND e.ts <= f.ended)
    SELECT session, previous, ended, min(ts) AS started, count(*) FILTER (event_type = 'view') AS prompts, coalesce(array_to_string((list(event_id ORDER BY ts, event_id) FILTER (event_type = 'view'))[1:3], ','), '') AS opening,
        coalesce(array_to_string((list(event_id ORDER BY ts, event_id) FILTER (event_type = 'view'))[-3:], ','), '') AS closing FROM r GROUP BY session, previous, ended
"""


def wn05_nameless(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions without an id: of each tool and day what happened in the two hours before the last event."""
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    ends = e.groupBy("event_type", "day").agg(F.max("ts").alias("ended"))
    inside = e.join(ends, ["event_type", "day"]).filter(F.col("ts") >= F.col("ended") - F.expr("INTERVAL 2 HOURS"))
    return inside.select("event_id", "event_type", "ended")


WN05 = "SELECT event_id, event_type, ended FROM (SELECT *, max(ts) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS ended FROM events) WHERE ts >= ended - INTERVAL '2 hours'"

# ---- recall --------------------------------------------------------------------------------------


def snippet(said: Column, wanted: Column, most: int) -> Column:
    """The sentence with most wanted tokens, the first of them, and the two after it, cut to ``most`` signs."""

    def cut(parts: Column, best: Column) -> Column:
        picked = F.array_join(F.slice(parts, F.greatest(best, F.lit(1)), 3), " ")
        return F.when(F.size(parts) == 0, "").otherwise(T.truncate(F.concat(F.when(best > 1, "… ").otherwise(""), picked), most))

    def chosen(parts: Column) -> Column:
        scores = F.transform(parts, lambda s: F.size(F.array_intersect(T.tokens(s), wanted)))
        return T.bound(scores, lambda n: T.bound(F.array_position(n, F.array_max(n)).cast("int"), lambda best: cut(parts, best)))

    return T.bound(T.sentences(said), chosen)


def recall(sources: DataFrame, asked: DataFrame, limit: int = 5, least: float = 0.3) -> DataFrame:
    """(qid, kind, id, part, coverage, place, snippet): what covers each query best, younger work first among equals.

    ``sources`` has kind, id, part, age (days), key, text, body; ``asked`` qid and text.  A turn whose request
    is that of a history entry is left out.  Tokens are weighted over all documents; see ``overlap.covering``
    for how documents and queries meet.
    """
    told = sources.filter("kind = 'history'").select("key").distinct()
    kept = sources.filter("kind <> 'turn'").unionByName(sources.filter("kind = 'turn'").join(told, "key", "left_anti").select(*sources.columns))
    pool = checkpointed(kept.select("kind", "id", "part", "age", "text", "body", F.monotonically_increasing_id().alias("row")))
    found = overlap.covering(pool.select(F.col("row").alias("id"), "text"), asked.select(F.col("qid").alias("id"), "text"), least)
    wanted = asked.select("qid", T.tokens(F.col("text")).alias("wanted"))
    scored = found.select(F.col("query").alias("qid"), F.col("doc").alias("row"), F.round(F.col("inter") / F.col("total"), 5).alias("coverage")).join(wanted, "qid")
    ranked = scored.join(pool.drop("text", "body"), "row").withColumn("rank", F.round(F.col("coverage") + 0.1 * F.exp(-F.col("age") / 30), 5))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank"), "kind", "id", "part"))
    best = ranked.withColumn("place", place).filter(F.col("place") <= limit)
    return best.join(pool.select("row", "body"), "row").select("qid", "kind", "id", "part", "coverage", "place", snippet(F.col("body"), F.col("wanted"), 320).alias("snippet"))


def recall_sources(spark: SparkSession, sf: str) -> DataFrame:
    key = T.collapse(F.col("text"))
    docs = table(spark, sf, "documents").select(F.lit("history").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), (F.col("doc_id") % 90).alias("age"), key.alias("key"), "text", F.col("text").alias("body"))
    turns = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), (F.col("conv_id") % 50).alias("age"), key.alias("key"), "text", F.col("text").alias("body"))
    copies = table(spark, sf, "documents").filter("doc_id % 10 = 0").select(F.lit("turn").alias("kind"), (-F.col("doc_id") - 1).alias("id"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("age"), key.alias("key"), "text", F.col("text").alias("body"))
    cases = table(spark, sf, "events").filter("event_type = 'error'").select(F.lit("case").alias("kind"), F.col("event_id").alias("id"), F.lit(0).cast("long").alias("part"), (F.col("event_id") % 40).alias("age"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("error in the "), "props").alias("text"), F.lit("").alias("body"))
    rules = table(spark, sf, "part").select(F.lit("decision").alias("kind"), F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("part"), F.lit(10).cast("long").alias("age"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("use the "), "p_name").alias("text"), F.lit("").alias("body"))
    return union(docs, turns, copies, cases, rules)


def ad05_recall(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return recall(recall_sources(spark, sf), asked).withColumn("snippet", F.sha2("snippet", 256))


D = T.DUCK_TOKENS.format(c="text")
AD05 = f"""
    WITH pool AS (
        SELECT 'history' AS kind, doc_id AS id, 0::BIGINT AS part, doc_id % 90 AS age, text, text AS body FROM documents
        UNION ALL SELECT 'turn', conv_id, turn::BIGINT, conv_id % 50, text, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE trim(regexp_replace(d.text, '\\s+', ' ', 'g')) = trim(regexp_replace(c.text, '\\s+', ' ', 'g')))
        UNION ALL SELECT 'case', event_id, 0, event_id % 40, 'error in the ' || props, '' FROM events WHERE event_type = 'error' UNION ALL SELECT 'decision', p_partkey, 0, 10, 'use the ' || p_name, '' FROM part),
    d AS (SELECT kind, id, part, unnest({D}) AS tok FROM pool), q AS (SELECT DISTINCT item_id AS qid, tok FROM (SELECT item_id, unnest({D}) AS tok FROM benchmark)), f AS (SELECT tok, count(*) AS df FROM d GROUP BY tok),
    w AS (SELECT qid, q.tok, ln(1 + (SELECT count(*) FROM pool) / coalesce(f.df, 0.5)) AS w FROM q LEFT JOIN f ON q.tok = f.tok), t AS (SELECT qid, sum(w) AS total, list(tok) AS wanted FROM w GROUP BY qid),
    c AS (SELECT qid, kind, id, part, round(sum(w.w) / any_value(total), 5) AS coverage FROM w JOIN d USING (tok) JOIN t USING (qid) GROUP BY qid, kind, id, part),
    r AS (SELECT c.*, age, body, row_number() OVER (PARTITION BY qid ORDER BY round(coverage + 0.1 * exp(-age / 30), 5) DESC, c.kind, c.id, c.part) AS place FROM c JOIN pool USING (kind, id, part) WHERE coverage >= 0.3),
    s AS (SELECT r.*, wanted, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 0) AS parts FROM r JOIN t USING (qid) WHERE place <= 5),
    e AS (SELECT qid, kind, id, part, idx, len(list_intersect({T.DUCK_TOKENS.format(c='said')}, wanted)) AS score FROM (SELECT *, unnest(parts) AS said, generate_subscripts(parts, 1) AS idx FROM s)),
    b AS (SELECT qid, kind, id, part, arg_max(idx, (score, -idx)) AS best FROM e GROUP BY ALL),
    p AS (SELECT s.*, coalesce(best, 1) AS best, CASE WHEN coalesce(best, 1) > 1 THEN '… ' ELSE '' END || array_to_string(parts[coalesce(best, 1):coalesce(best, 1) + 2], ' ') AS said FROM s LEFT JOIN b USING (qid, kind, id, part))
    SELECT qid, kind, id, part, coverage, place, sha256(CASE WHEN length(said) > 320 THEN substr(said, 1, 319) || '…' ELSE said END) AS snippet FROM p
"""


def wn13_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The best sentence of every document for a fixed query and the two after it."""
    wanted = F.array(*map(F.lit, ("the", "that", "der", "que", "la")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(snippet(F.col("text"), wanted, 320), 256).alias("snippet"))


WN13 = f"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 0) AS parts FROM documents),
    e AS (SELECT doc_id, idx, len(list_intersect({T.DUCK_TOKENS.format(c='said')}, ['the', 'that', 'der', 'que', 'la'])) AS score FROM (SELECT doc_id, unnest(parts) AS said, generate_subscripts(parts, 1) AS idx FROM s)),
    b AS (SELECT doc_id, arg_max(idx, (score, -idx)) AS best FROM e GROUP BY ALL), p AS (SELECT doc_id, CASE WHEN best > 1 THEN '… ' ELSE '' END || array_to_string(parts[best:best + 2], ' ') AS said FROM s JOIN b USING (doc_id))
    SELECT doc_id, sha256(CASE WHEN length(said) > 320 THEN substr(said, 1, 319) || '…' ELSE said END) AS snippet FROM p
"""


def case_hints(prompts: DataFrame, cases: DataFrame) -> DataFrame:
    """(prompt, case_id): of the errors that a prompt names as a word and another session ran into, the first in order of the alphabet.

    ``prompts`` has prompt, session, at, words; ``cases`` case_id, session, signature, resolved, at.  Of a
    signature the resolved case comes first, then the newest.  A signature is pointed out once in a session.
    """
    order = F.struct("resolved", "at", "case_id")
    best = cases.groupBy("signature", "session").agg(F.max(order).alias("c"))
    place = F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("c")))
    two = best.withColumn("place", place).filter("place <= 2").select("signature", F.col("session").alias("other"), "c", "place")
    asked = prompts.select("prompt", "session", "at", F.explode("words").alias("signature"))
    named = asked.join(two, "signature").filter("session <> other").groupBy("prompt", "session", "at", "signature").agg(F.min_by("c", "place")["case_id"].alias("case_id"))
    once = F.row_number().over(Window.partitionBy("session", "signature").orderBy("at", "prompt"))
    fresh = named.withColumn("nth", once).filter("nth = 1")
    return fresh.groupBy("prompt").agg(F.min_by("case_id", "signature").alias("case_id"))


def ad01_hints(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("sign", F.concat(F.lit("E"), F.expr(K)))
    cases = e.filter("event_type = 'error'").select(F.col("event_id").alias("case_id"), F.col("user_id").alias("session"), F.col("sign").alias("signature"), (F.col("value") > 50).alias("resolved"), F.col("ts").alias("at"))
    said = F.concat(F.lit("saw "), "sign", F.lit(" and "), "sign", F.lit("x again"))
    prompts = e.filter("event_type = 'view'").select(F.col("event_id").alias("prompt"), F.col("user_id").alias("session"), F.col("ts").alias("at"), F.array_distinct(F.split(said, "[^A-Za-z0-9_]+")).alias("words"))
    return case_hints(prompts, cases)


AD01 = """
    WITH e AS (SELECT *, 'E' || json_extract_string(props, '$.k') AS sign FROM events),
    n AS (SELECT v.event_id AS prompt, v.user_id, v.ts, v.sign, arg_max(c.event_id, (c.value > 50, c.ts, c.event_id)) AS case_id FROM e v JOIN e c ON c.event_type = 'error' AND c.sign = v.sign AND c.user_id <> v.user_id WHERE v.event_type = 'view' GROUP BY ALL)
    SELECT prompt, case_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sign ORDER BY ts, prompt) AS nth FROM n) WHERE nth = 1
"""


def jn07_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Open cases of sessions that have been quiet since the last evening."""
    e = table(spark, sf, "events")
    since = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return e.filter("event_type = 'error'").select("event_id", "user_id").join(e.filter(F.col("ts") >= since).select("user_id").distinct(), "user_id", "left_anti")


JN07 = "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00')"


def ct07_notices(spark: SparkSession, sf: str) -> DataFrame:
    """What people should hear of each session: extraction that failed three times in a row, or two weeks of silence while five commits went by."""
    e = table(spark, sf, "events")
    tries = e.filter("event_type IN ('error', 'purchase')")
    last_pass = tries.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("passed"))
    streak = tries.filter("event_type = 'error'").join(last_pass, "user_id", "left").filter("passed IS NULL OR struct(ts, event_id) > passed").groupBy("user_id").agg(F.count("*").alias("streak"))
    heard = e.filter("event_type = 'view' AND ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'").groupBy("user_id").agg(F.max("ts").alias("heard"))
    commits = e.filter("event_type = 'click'").join(heard, "user_id").filter("ts > heard").groupBy("user_id").agg(F.count("*").alias("commits"))
    every = e.select("user_id").distinct().join(streak, "user_id", "left").join(heard, "user_id", "left").join(commits, "user_id", "left")
    silent = F.datediff(F.lit("2024-01-31").cast("date"), F.col("heard")) >= X.SILENCE_DAYS
    notices = F.array(F.when(F.col("streak") >= X.STREAK_NOTICE, "extraction"), F.when(silent & (F.col("commits") >= X.SILENCE_COMMITS), "capture"))
    return every.select("user_id", F.array_join(F.array_compact(notices), ",").alias("notices"))


CT07 = """
    WITH p AS (SELECT user_id, max((ts, event_id)) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1), s AS (SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN p USING (user_id) WHERE event_type = 'error' AND (p IS NULL OR (e.ts, e.event_id) > p) GROUP BY 1),
    h AS (SELECT user_id, max(ts) AS heard FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM events JOIN h USING (user_id) WHERE event_type = 'click' AND ts > heard GROUP BY 1)
    SELECT user_id, concat_ws(',', CASE WHEN s.n >= 3 THEN 'extraction' END, CASE WHEN date_diff('day', heard::DATE, DATE '2024-01-31') >= 14 AND c.n >= 5 THEN 'capture' END) AS notices FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN c USING (user_id)
"""

QUERIES = [
    Query("sc17_transcript_tail", sc17_tails, SC17),
    Query("sc18_turn_bounded_read", sc18_turns, SC18),
    Query("sc20_call_result_pairs", sc20_runs, SC20),
    Query("sc23_history_entries", sc23_parsed, SC23),
    Query("sc24_monthly_partitions", sc24_appended, SC24),
    Query("sm11_case_machine", sm11_cases, SM11),
    Query("wn04_previous_session", wn04_previous, WN04),
    Query("wn05_session_by_look_back", wn05_nameless, WN05),
    Query("wn13_best_sentence", wn13_snippets, WN13),
    Query("ad01_case_hint", ad01_hints, AD01),
    Query("ad05_recall", ad05_recall, AD05),
    Query("ad08_history_target", ad08_target, AD08),
    Query("jn07_stale_cases", jn07_stale, JN07),
    Query("ct07_health_notices", ct07_notices, CT07),
]
