"""Rule files, transcripts, code facts, diffs and the streaming forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import signals
from quarrylake.operators import codegraph
from quarrylake.sources import code, rules, transcripts
from quarrylake.streaming import queries as streams
from quarrylake.streaming import sessions, stateful

RULE = """---
id: R1
type: decision
enforcement: must
scope: {paths: ["src/**"], topics: [api]}
source: {captured_at: "2024-01-02T00:00:00.000Z"}
valid_until: 2024-12-31
reinforced: 2
---
# Title
## Rule
- Use zod
  for input
## Why
safety
## Other
kept
"""


def test_parse_rule():
    row = rules.parse_rule("x/decisions/a.md", RULE)
    assert (row["id"], row["type"], row["enforcement"], row["summary"], row["reason"]) == ("R1", "decision", "must", "Use zod for input", "safety")
    assert row["notes"] == "## Other\nkept" and row["paths"] == ["src/**"] and row["valid_until"] == dt.date(2024, 12, 31)
    plain = rules.parse_rule("facts/b.md", "The port is 80")
    assert (plain["type"], plain["status"], plain["title"]) == ("fact", "active", "The port is 80")
    assert rules.parse_rule("c.md", "---\n: [\n---\nx")["error"].startswith("invalid front matter")
    assert rules.parse_rule("d.md", "")["error"] == rules.parse_rule("d.md", None)["error"] == "empty rule"


def test_rules_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("b/1.md", RULE), ("a/2.md", RULE), ("c/3.md", "Use tabs"), ("e.md", None)], "path string, value string")
    rows = {r["path"]: r for r in rules.parse_rules(files).collect()}
    assert rows["b/1.md"]["error"] == "duplicate id of a/2.md" and rows["a/2.md"]["error"] is None and rows["e.md"]["error"] == "empty rule"
    again = rules.parse_rule("a/2.md", rules.serialize(rows["a/2.md"].asDict()))
    assert {k: again[k] for k in ("id", "type", "summary", "paths", "topics", "reason", "notes", "captured_at", "valid_until")} == {k: rows["a/2.md"][k] for k in ("id", "type", "summary", "paths", "topics", "reason", "notes", "captured_at", "valid_until")}
    good = rules.parse_rules(files).filter("error is null")
    rules.write_rules(good, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)already exists"):
        rules.write_rules(good, str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.md").write_text(RULE)
    assert rules.read_rules(spark, str(tmp_path / "in")).first()["summary"] == "Use zod for input"


@pytest.mark.parametrize("name", ["sc05_parse_rules", "sc12_incremental_parse", "sc07_serialize_rules"])
def test_documents_without_text_are_as_in_sql(spark, tmp_path, name):
    import duckdb

    from quarrylake.plans import registry

    texts = ["The port is 80", "", None, " \n\t ", "Use tabs"]
    docs = [(k, texts[k % 7 % 5], "en", "src3" if k % 2 else None if k % 3 else "src1") for k in range(70)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_files_are_parsed_once(spark):
    """Looking for equal ids reads no file again."""
    files = spark.createDataFrame([("b/1.md", RULE), ("a/2.md", RULE), ("c/3.md", "Use tabs"), ("e.md", "---\n: [\n---\nx"), ("f.md", "---\n: [\n---\nx")], "path string, value string")
    rows = rules.parse_rules(files)
    assert rows._jdf.queryExecution().sparkPlan().toString().count("MapInPandas") == 1
    assert {r["path"]: (r["error"] or "")[:9] for r in rows.collect()} == {"a/2.md": "", "b/1.md": "duplicate", "c/3.md": "", "e.md": "invalid f", "f.md": "invalid f"}


def call(n, command, at):
    return json.dumps({"timestamp": at, "message": {"content": [{"type": "tool_use", "id": f"c{n}", "name": "Bash", "input": {"command": command}}]}})


def result(n, text, at, error=None):
    return json.dumps({"timestamp": at, "message": {"content": [{"type": "tool_result", "tool_use_id": f"c{n}", "content": text, "is_error": error}]}})


def test_transcript_runs_and_cases(spark):
    lines = [
        call(1, "cd app && npm test", "t1"), result(1, "error TS2345: no\nExit code 1", "t2", True),
        call(2, "npm test | tail", "t3"), result(2, "3 failed", "t4", False),
        call(3, "npm test", "t5"), result(3, "12 tests passed", "t6", False),
        call(4, "ls", "t7"), "{broken", "", None,
    ]
    df = transcripts.objects(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, line long, value string"))
    runs = {r["at"]: r for r in transcripts.command_runs(df).collect()}
    assert {k: (r["command"], r["ok"], r["seen"], r["signature"]) for k, r in runs.items()} == {
        "t1": ("npm test", False, False, "TS2345"), "t3": ("npm test", None, False, None), "t5": ("npm test", True, True, None)}
    got = transcripts.cases(transcripts.command_runs(df)).collect()
    assert [(r["failed_at"], r["resolved_at"], r["state"]) for r in got] == [("t1", "t5", "resolved")]


@pytest.mark.parametrize("text, want", [
    ("x\nerror TS1005: y", "TS1005"), ('npm ERR! Missing script: "lint"', 'Missing script: "lint"'), ("ERR_ASSERTION", None),
    ("TypeError: x", None), ("MyCustomException at", "MyCustomException"), ("all fine", None),
])
def test_signature(text, want):
    assert signals.signature(text) == want


def test_commands_anywhere_in_json():
    value = {"a": [{"cmd": ["ls", "-l"]}], "arguments": '{"command": "pwd"}', "b": {"command": 3}}
    assert transcripts.commands_in(value) == ["ls -l", "pwd"]
    assert transcripts.commands_in({"cmd": ["bash", "-lc", "npm test"]}) == ["npm test"]


PY = {
    "/r/base.py": "class Base:\n    def run(self):\n        return helper()\n\ndef helper():\n    pass\n",
    "/r/app.py": "from base import Base as B\n\nclass App(B):\n    def go(self):\n        self.run()\n        unknown()\n",
    "/r/bad.py": "def (",
}


def test_code_facts_and_edges(spark):
    facts = code.extract_facts(spark.createDataFrame(list(PY.items()), "path string, value string"))
    assert {r["path"]: r["error"] for r in facts.collect()} == {"/r/base.py": None, "/r/app.py": None, "/r/bad.py": "SyntaxError"}
    assert {r["qname"] for r in code.symbols(facts).collect()} == {"Base", "Base.run", "helper", "App", "App.go"}
    edges = {(r["sid"], r["kind"], r["target"], r["weak"]) for r in codegraph.Project(facts).edges.collect()}
    assert edges == {("/r/base.py#1", "call", "/r/base.py#2", False), ("/r/app.py#0", "inherit", "/r/base.py#0", False), ("/r/app.py#1", "call", "/r/base.py#1", False)}


def test_diff_hunks_and_innermost_symbols(spark):
    text = ["+++ b//r/base.py", "@@ -1,2 +2,1 @@", "+x", "@@ -9 +30 @@", "+++ b/other.py", "@@ -1 +1,0 @@"]
    hunks = code.diff_hunks(spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "diff int, pos int, line string"))
    assert {tuple(r)[1:] for r in hunks.collect()} == {("/r/base.py", 2, 1), ("/r/base.py", 30, 1), ("other.py", 1, 0)}
    syms = code.symbols(code.extract_facts(spark.createDataFrame(list(PY.items()), "path string, value string")))
    assert {(r["path"], r["sym"]) for r in code.changed_symbols(hunks, syms).collect()} == {("/r/base.py", 1)}


def test_file_listing(spark, tmp_path):
    for name in ("a.py", "node_modules/x.js", "src/b.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r["path"] for r in code.list_files(spark, str(tmp_path)).collect()) == ["a.py", "src/b.ts"]
    assert [r["path"] for r in code.list_files(spark, str(tmp_path), limit=1).collect()] == ["a.py"]


def stream(spark, tmp_path, batches, schema):
    src = tmp_path / "src"
    src.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        part = next((tmp_path / f"b{k}").glob("*.parquet"))
        part.rename(src / f"{k}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(df, tmp_path, mode="append", sink=None):
    out = str(tmp_path / "out")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)).start()
    query.awaitTermination(180)
    return df.sparkSession.read.parquet(out).collect()


def at(*values):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=v) for v in values]


def test_throttle_stream(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate(at(0, 20, 31, 35, 70))]
    df = stream(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], "user long, event_id long, ts timestamp")
    assert sorted(r["event_id"] for r in drain(sessions.throttle_stream(df, "user", 30), tmp_path)) == [0, 2, 4]


def folded(spark, tmp_path, batches, processor, lateness="0 seconds"):
    """What a processor gives for rows of (user, event_id, seconds, kind, item), batch by batch."""
    rows = [[(u, i, at(t)[0], k, x) for u, i, t, k, x in batch] for batch in batches]
    df = stream(spark, tmp_path, rows, "user long, event_id long, ts timestamp, kind string, item long")
    out = stateful.folded(df, "user", processor, lateness)
    got = drain(out, tmp_path)
    base = int(at(0)[0].replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    return sorted(tuple((v - base) // 1_000_000 if isinstance(v, int) and v > 1 << 40 else v for v in r) for r in got)


HOUR = 3600


def test_turns_close_by_timer(spark, tmp_path):
    rows = [(1, 0, 0, "prompt", None), (1, 1, 5, "reply", None), (1, 2, 10, "prompt", None), (1, 3, 5000, "prompt", None), (2, 4, 60 * HOUR, "other", None)]
    want = [(1, 0, 5, "ready"), (1, 10, None, "ready"), (1, 5000, None, "expired")]
    key = lambda r: (r[0], r[1])
    for k, batches in enumerate(([rows[:2], rows[2:4], rows[4:]], [rows])):
        path = tmp_path / str(k)
        path.mkdir()
        assert sorted(folded(spark, path, batches, stateful.Turns(12 * HOUR)), key=key) == want


def test_silent_key_is_sent_by_its_timer(spark, tmp_path):
    rows = [(1, 0, 0, "implicit", None), (1, 1, 60, "implicit", None), (2, 2, 100, "explicit", None), (3, 3, 30 * HOUR, "other", None)]
    got = folded(spark, tmp_path, [rows[:3], rows[3:]], stateful.SendBatches(5, 24 * HOUR))
    assert got == [(1, 24 * HOUR, "time", 2), (2, 100, "explicit", 1)]


def test_cases_reopen_and_late_rows_count(spark, tmp_path):
    rows = [(1, 0, 0, "failed", 7), (9, 1, 8 * HOUR, "other", 0), (1, 2, 9 * HOUR, "failed", 7), (1, 3, 9 * HOUR - 60, "other", 7), (1, 4, 10 * HOUR, "passed", 7), (9, 5, 40 * HOUR, "other", 0)]
    got = folded(spark, tmp_path, [rows[:2], rows[2:3], rows[3:5], rows[5:]], stateful.Cases(6 * HOUR), "2 hours")
    assert sorted(got, key=lambda r: r[3]) == [(1, 7, 0, 0, "opened"), (1, 7, 0, 6 * HOUR, "unresolved"), (1, 7, 0, 9 * HOUR, "reopened"), (1, 7, 0, 10 * HOUR, "resolved")]


def test_session_state_is_forgotten(spark, tmp_path):
    rows = [(1, 0, 0, "given", 4), (1, 1, 10, "prompt", 4), (1, 2, 5 * HOUR, "prompt", 4), (2, 3, 90 * HOUR, "other", 0)]
    assert folded(spark, tmp_path, [rows[:2], rows[2:3], rows[3:]], stateful.SessionState(2 * HOUR)) == [(1, 1, 1, 1, True), (1, 2, 1, 0, False)]


def test_rounds_are_bounded_and_go_on(spark, tmp_path):
    df = stream(spark, tmp_path, [[(1, k)] for k in range(5)], "user long, event_id long")
    sink = sessions.write_once(str(tmp_path / "out"), lambda b: b)
    runs = []
    while not runs or runs[-1][1]:
        runs.append(sessions.run_rounds(df, sink, str(tmp_path / "state"), 2))
    assert runs == [(2, True), (2, True), (1, False)]
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))


def test_ledger_reads_only_its_own_buckets(spark, tmp_path, monkeypatch):
    out, read = str(tmp_path / "ledger"), []
    plain = sessions.exists
    monkeypatch.setattr(sessions, "exists", lambda s, path: (read.append(path), plain(s, path))[1])
    sink = sessions.write_new(out, ["id"], "a", F.col("day").cast("string"))
    for number in range(6):
        rows = spark.createDataFrame([(number * 10 + k, number) for k in range(5)], "id long, day int")
        sink(rows, number)
        sink(rows, number)
    sessions.write_new(out, ["id"], "b", F.col("day").cast("string"))(spark.createDataFrame([(3, 0), (99, 0), (99, 0)], "id long, day int"), 0)
    assert max(len([p for p in read if p.endswith(f"bucket={d}")]) for d in range(1, 6)) == 2  # never looked up again by later days
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == sorted([n * 10 + k for n in range(6) for k in range(5)] + [99])


def test_session_windows_and_idempotent_sink(spark, tmp_path):
    rows = [(1, t) for t in at(0, 3600, 9 * 3600, 40 * 3600)]
    df = stream(spark, tmp_path, [rows[:2], rows[2:3], rows[3:]], "user long, ts timestamp")
    sink = sessions.write_once(str(tmp_path / "out"), lambda b: b)
    got = drain(sessions.session_windows(df, "user"), tmp_path, sink=sink)
    assert sorted(r["n"] for r in got) == [1, 2]
    first = spark.createDataFrame([(1, 2)], "a int, b int")
    for _ in range(2):
        sessions.write_once(str(tmp_path / "again"), lambda b: b)(first, 7)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 1


def test_retained_to_a_part_of_a_second(spark):
    rows = spark.createDataFrame([(1, "2024-01-21 00:00:00"), (2, "2024-01-20 23:59:59.5"), (3, "2024-01-21 00:00:00.5")], "id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("kind", F.lit("x"))
    assert {r["id"] for r in streams.retained(rows, "at", "kind", {"x": 10}, "2024-01-31 00:00:00").collect()} == {1, 3}


def test_stretches_are_of_whole_seconds(spark, tmp_path):
    """An event less than half a second before a stretch ends is of the next one."""
    rows = [(1, "2024-01-01 00:00:00.2", 9.0), (2, "2024-01-02 23:59:59.6", 9.0), (3, "2024-01-02 23:59:59.8", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_id"], r["state"], r["round"], r["run"]) for r in streams.sm02_micro_batches(spark, str(tmp_path)).collect()}
    assert got == {(1, "done", 0, 1), (2, "done", 0, 1), (3, "dead", 1, 1)}


def test_one_call_folds_all_keys_of_a_bucket():
    """Keys of a bucket share a call and a stored value; a key without rows lapses with the others, and late rows wait."""
    import json
    from types import SimpleNamespace

    import pandas as pd

    from quarrylake.streaming import stateful

    stored, timers = [], []
    turns = stateful.Turns(10)
    kept = SimpleNamespace(get=lambda: stored[-1], exists=lambda: bool(stored), update=stored.append, clear=stored.clear)
    turns.init(SimpleNamespace(getValueState=lambda *a: kept, registerTimer=timers.append))
    at = lambda s: s * stateful.SECOND

    def call(rows, seconds):
        frame = pd.DataFrame(rows, columns=["key", "at", "id", "kind", "item"])
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: seconds * 1000)
        return [r for f in turns.handleInputRows((5,), [frame], clock) for r in f.itertuples(index=False, name=None)]

    rows = [(1, at(3), 11, "reply", None), (None, at(2), 12, "prompt", None), (1, at(1), 10, "prompt", None), (2, at(30), 13, "prompt", None)]
    assert call(rows, 5) == [(1, at(1), at(3), "ready")]
    assert len(stored) == 1 and [r[1] for r in json.loads(stored[0][0])["waiting"]] == [13] and timers == [12_000]
    assert call([(1, at(21), 14, "other", None)], 20) == [(None, at(2), None, "expired")]
    assert call([(1, at(41), 15, "other", None)], 45) == [(2, at(30), None, "expired")] and not stored


def test_rules_are_made_in_pieces():
    import pandas as pd

    from quarrylake.sources import rules

    batch = pd.DataFrame({"text": ["", "a" * rules.PIECE, None, "b" * 10, "c" * (rules.PIECE - 5), ""]})
    found = [list(p["text"]) for p in rules.pieces(batch, batch["text"].map(lambda t: len(t or "")))]
    assert sum(found, []) == list(batch["text"]) and all(len(f) == 1 or sum(len(t or "") for t in f) <= rules.PIECE for f in found) and len(found) == 4
    assert list(rules.pieces(batch[:0], batch[:0]["text"])) == []
