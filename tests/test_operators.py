"""Operators on literal rows: folds, as-of joins, text functions, graph walks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import globs, prompts
from quarrylake.functions import text as T
from quarrylake.operators import asof, codegraph, contexts, graph, rulebook
from quarrylake.sources import code


def seconds(*values):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=v) for v in values]


def test_throttle_counts_from_the_last_accepted_row(spark):
    rows = [(k, t, i) for k in (1, 2) for i, t in enumerate(seconds(0, 20, 31, 35, 70))]
    got = asof.throttle(spark.createDataFrame(rows, "k long, ts timestamp, id long"), ["k"], "ts", "id", 30).collect()
    assert sorted((r["k"], r["id"]) for r in got) == [(k, i) for k in (1, 2) for i in (0, 2, 4)]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 4, 3, 1, 1])], "k string, i int, cost long")
    got = asof.pack_budget(df, "k", ["i"], "cost", 9).orderBy("i").collect()
    assert [r["taken"] for r in got] == [True, True, False, False, False]
    got = asof.pack_budget(df, "k", ["i"], "cost", 8).orderBy("i").collect()
    assert [r["taken"] for r in got] == [True, False, True, False, False]


@pytest.mark.parametrize("bucket", ["minute", "day"])
def test_nearest_over_buckets(spark, bucket):
    rows = [(1, t, i, v) for i, (t, v) in enumerate(zip(seconds(0, 50, 70, 130, 500), ["a", None, None, "b", None], strict=True))] + [(2, seconds(9)[0], 9, None)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, id long, v string")
    back = asof.nearest(df, "k", "ts", "id", F.col("v"), "last", bucket=bucket)
    ahead = asof.nearest(df, "k", "ts", "id", F.col("v"), "next", forward=True, bucket=bucket)
    assert [r["last"] for r in back.orderBy("id").collect()] == ["a", "a", "a", "b", "b", None]
    assert [r["next"] for r in ahead.orderBy("id").collect()] == ["a", "b", "b", "b", None, None]


def test_turn_pairing_takes_the_first_reply(spark):
    kinds = ["reply", "prompt", "reply", "reply", "prompt", "prompt", "reply"]
    df = spark.createDataFrame([(1, t, i, k) for i, (t, k) in enumerate(zip(seconds(*range(7)), kinds, strict=True))], "k long, ts timestamp, id long, kind string")
    got = asof.pair_turns(df, "k", "ts", "id", F.col("kind") == "prompt", F.col("kind") == "reply").orderBy("turn").collect()
    assert [(r["prompt_tie"], r["reply_tie"]) for r in got] == [(1, 2), (4, None), (5, 6)]


def test_streak(spark):
    df = spark.createDataFrame([(1, t, i, k) for i, (t, k) in enumerate(zip(seconds(*range(6)), "bbgbgb", strict=True))], "k long, ts timestamp, id long, kind string")
    got = asof.streak(df, "k", "ts", "id", F.col("kind") == "b", F.col("kind") == "g", "n").orderBy("id").collect()
    assert [r["n"] for r in got] == [1, 2, 0, 1, 0, 1]


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, T.tokens, "parseHTTPResponse user_id a", "금액은 원 für", "", None, "ＡＢ x1")
    assert sorted(got[0]) == ["http", "id", "parse", "parsehttpresponse", "response", "user", "user_id"]
    assert sorted(got[1]) == ["금액", "액은"]
    assert got[2] == got[3] == [] and sorted(got[4]) == ["ab", "x1"]


def test_sizes_and_wording(spark):
    assert one(spark, T.approx_tokens, "abcd", "금액은", "") == [1, 3, 0]
    assert one(spark, T.canonical, "Use “Node 18”, please.", " A\nb ") == ["use node 18 please", "a b"]
    assert one(spark, T.key_terms, "Use Node.js 18.2 and C++") == [["18.2", "and", "c++", "node.js", "use"]]
    assert one(spark, T.negated, "Do not push", "notable", "don't") == [True, False, True]
    assert one(spark, T.sentences, "One. Two!\nthree") == [["One.", "Two!", "three"]]
    assert one(spark, T.slug, "Hello, Wörld!", "…") == ["hello-w-rld", "item"]
    assert one(spark, lambda c: T.truncate(c, 4), "abcd", "abcde") == ["abcd", "abc…"]


@pytest.mark.parametrize("a, b, same", [
    ("Use tabs for indentation in all files", "use tabs, for indentation in all files.", True),
    ("Use Node 18 for all of the services", "Use Node 20 for all of the services", False),
    ("Always push to main when done here", "Never push to main when done here", False),
    ("x", "", False),
])
def test_same_rule(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.same_rule(F.col("a"), F.col("b")).alias("y")).first()["y"] is same


def test_prompts_and_paths(spark):
    assert one(spark, prompts.kind, "/help", " ok! ", "", "fix it") == ["command", "ack", "ack", "normal"]
    assert one(spark, prompts.asks, "Really?", "why not", "whyever", "do it") == [True, True, False, False]
    assert one(spark, T.path_hints, "see src/a/B.kt and x.py, not 1.2.3") == [["src/a/B.kt", "x.py"]]
    assert one(spark, lambda c: T.names_topic(c, F.lit("PR")), "the pr is in", "prompt") == [True, False]


def test_reach_and_heads(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    got = graph.reach(edges, spark.createDataFrame([(1,)], "node long"), 3).collect()
    assert {r["node"]: r["level"] for r in got} == {1: 0, 2: 1, 3: 2, 4: 3}
    replaced = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "src long, dst long")
    heads = graph.live_heads(replaced, spark.createDataFrame([(5,), (9,)], "node long")).collect()
    assert {r["node"]: r["head"] for r in heads} == {k: 5 for k in range(5)} | {k: 9 for k in range(5, 9)}


def test_rolling_count_over_bucket_edges(spark):
    at = seconds(0, 1800, 3599, 3600, 3601, 7199, 7200, 20_000)
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(at)] + [(2, at[0], 99)], "k long, ts timestamp, id long")
    got = {r["id"]: r["n"] for r in asof.rolling_count(df, "k", "ts", "id", 1, "n").collect()}
    want = {i: sum(0 <= (t - u).total_seconds() <= 3600 for u in at) for i, t in enumerate(at)}
    assert got == want | {99: 1}


def test_resolution_takes_the_first_rule_with_a_target(spark):
    found = spark.createDataFrame([(1, 9, 2), (1, 8, 1), (1, 7, 1), (2, 5, 3), *[(2, k, 3) for k in range(10, 20)]], "ref long, target long, rule int")
    got = codegraph.first_rule(found, "ref").collect()
    assert sorted((r["ref"], r["rule"], r["target"]) for r in got) == [(1, 1, 7), (1, 1, 8), (2, 3, 5), (2, 3, 10), (2, 3, 11), (2, 3, 12)]


def test_heads_of_circles_and_forks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (4, 6), (7, 8), (8, 7), (9, 10)], "src long, dst long")
    heads = graph.live_heads(edges, spark.createDataFrame([(5,), (6,)], "node long")).collect()
    assert {(r["node"], r["head"]) for r in heads} == {(n, h) for n in (1, 2, 3, 4) for h in (5, 6)}


def test_closest_files_and_members(spark):
    wanted = spark.createDataFrame([(1, "src/a/x.py", "k"), (2, "lib/z.py", "k"), (3, "q.py", "none")], "ref long, path string, name string")
    offered = spark.createDataFrame([(10, "src/a/y.py", "k"), (11, "src/b/y.py", "k"), (12, "src/a/w.py", "k")], "target long, path string, name string")
    assert {tuple(r) for r in codegraph.closest(wanted, offered, "name").collect()} == {(1, 10), (1, 12), (2, 10), (2, 11), (2, 12)}
    bases = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src long, dst long")  # a circle must not loop
    members = spark.createDataFrame([(3, "m", 30), (4, "m", 40), (9, "m", 90)], "cls long, name string, target long")
    asked = spark.createDataFrame([(1, 1, "m"), (2, 2, "m"), (3, 1, "n")], "ref long, cls long, name string")
    assert {tuple(r) for r in codegraph.nearest_member(asked, members, bases).collect()} == {(1, 40, 1), (2, 30, 1)}


def test_trace_spends_its_budget_level_by_level(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 6)] + [(k, k + 10) for k in range(1, 6)] + [(11, 0)], "src long, dst long")
    seeds = spark.createDataFrame([(7, 0)], "root long, node long")
    got = [tuple(r)[1:] for r in codegraph.trace(edges, seeds, 5, 7).orderBy("level", "parent", "node").collect()]
    assert got == [(1, 0, k) for k in range(1, 6)] + [(2, 1, 11), (2, 2, 12)]


def test_status_of_linked_rules(spark):
    from datetime import date, datetime

    at = lambda d: datetime(2024, 1, d)
    none = []
    rows = [  # id, captured, status, text, until, reinforced, supersedes, conflict_with, review
        (1, at(1), "active", "a", None, 0, none, none, none), (2, at(2), "active", "b", None, 0, [1], none, none), (3, at(3), "active", "c", None, 0, [1, 4], none, [6]),  # 4 is newer: no link
        (4, at(4), "active", "d", None, 0, none, none, none), (5, at(5), "active", "d", None, 0, none, none, none), (6, at(2), "active", "e", None, 0, none, none, none),
        (7, at(7), "active", "f", date(2024, 1, 9), 0, none, none, none), (8, at(8), "proposed", "g", None, 0, none, none, none), (9, at(9), "active", "h", None, 0, none, [1], none), (10, at(10), "conflict", "i", None, 0, none, none, none),
    ]
    schema = "id long, captured timestamp_ntz, status string, text_key string, valid_until date, reinforced int, supersedes array<long>, conflict_with array<long>, review array<long>"
    got = {r["id"]: r for r in rulebook.derive_status(spark.createDataFrame(rows, schema), "2024-03-01", 30).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "superseded", 2: "conflict", 3: "conflict", 4: "active", 5: "superseded", 6: "active", 7: "retired", 8: "retired", 9: "conflict", 10: "active"}
    assert (got[1]["superseded_by"], got[5]["superseded_by"], got[8]["archived"]) == (2, 4, True)
    assert (got[2]["conflict_with"], got[9]["conflict_with"]) == ("3,9", "2,3") and got[6]["needs_review"] and not got[4]["needs_review"]


@pytest.mark.parametrize("glob, path, ok", [("src/**/*.ts", "src/a/b.ts", True), ("*.md", "a/b.md", True), ("a**b", "x/a/y/b", False), ("a/[!b].c", "a/c.c", True), ("{a,b}/c", "b/c", True), ("", "x", False)])
def test_globs(glob, path, ok):
    import re

    assert (re.search(globs.path_regex(glob), path) is not None) is ok


def test_blocks_share_a_shrinking_budget(spark):
    rows = [("a", 1, 1, 4), ("a", 1, 2, 9), ("a", 1, 3, 2), ("a", 2, 4, 3), ("a", 2, 5, 1), ("b", 1, 6, 8), ("b", 1, 7, 9)]
    df = spark.createDataFrame(rows, "k string, block int, id int, cost long")
    got = contexts.pack_blocks(df, "k", "block", ["id"], "cost", 10, 2).orderBy("id").collect()
    assert [r["taken"] for r in got] == [True, False, True, False, False, True, False]


def test_work_state(spark):
    text = "# branch.oid abcdef1234\0# branch.head main\x001 .M N... 1 1 1 a b src/x y.py\x002 R. N... 1 1 1 a b R100 new.py\0old.py\0? extra.txt\0"
    got = spark.createDataFrame([(text,), (None,)], "status string").select(code.work_state(F.col("status")).alias("w")).select("w.*").collect()
    assert tuple(got[0]) == ("main", "abcdef1", ["src/x y.py", "new.py", "extra.txt"], 3)
    assert (got[1]["branch"], got[1]["dirty"], got[1]["changed"]) == ("?", [], 0)
