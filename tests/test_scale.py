"""Joins by overlap, lineage, generations, stores and search against brute force on small fixtures."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarrylake.lineage import claim
from quarrylake.operators import asof, codegraph, generations, imports, joins, overlap, rulebook, text_search


def families(n=120, seed=3):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], [f"word{k}" for k in range(400)]
    rows = []
    for i in range(n):
        base = rng.sample(rare, 8) if i % 4 == 0 or not rows else rows[-1][1].split()[:8]
        words = [*base, *rng.sample(common, 3)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(8)] = rng.choice(rare)
        rows.append((i, " ".join(words)))
    return [*rows, (n, rows[0][1]), (n + 1, ""), (n + 2, "of the of"), (None, rows[0][1])]


def weights(rows):
    sets = {i: frozenset(w for w in (t or "").split() if len(w) > 1) for i, t in rows if i is not None}
    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    return sets, {w: math.log(1 + len(sets) / d) for w, d in df.items()}, len(sets)


@pytest.mark.parametrize("crowd", [2, 2048])
@pytest.mark.parametrize("least", [0.3, 0.6])
def test_similar_pairs(spark, monkeypatch, crowd, least):
    monkeypatch.setattr(overlap.meeting, "__defaults__", (crowd, overlap.LONGEST))
    rows = families()
    sets, w, _ = weights(rows)
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    total = {i: sum(w[t] for t in s) for s, i in reps.items() if s}
    want = {}
    for a in total:
        for b in total:
            score = round(sum(w[t] for t in sets[a] & sets[b]) / math.sqrt(total[a] * total[b]), 5)
            if a < b and score >= least:
                want[a, b] = score
    pairs, members = overlap.similar_pairs(spark.createDataFrame(rows, "id long, text string"), least)
    got = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    assert {(r["id"], r["member"]) for r in members.collect()} == {(reps[s], i) for i, s in sets.items() if s}


def test_candidates_are_few(spark):
    """Of 7000 pairs that share a common word, few are looked at."""
    rows = families()[:120]
    docs = spark.createDataFrame(rows, "id long, text string")
    a = overlap.asked_sets(docs, docs.filter("id < 30"))
    sets, w, n = weights(rows)
    scored = [sum(w[t] for t in sets[q] & sets[d]) / math.sqrt(sum(map(w.get, sets[q])) * sum(map(w.get, sets[d]))) for q in range(30) for d in sets]
    assert overlap.alike(a, 0.5).count() <= 6 * sum(s >= 0.5 for s in scored) < 30 * 120 / 4


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_matching_and_covering(spark, least):
    rows = families()
    asked = [(0, rows[0][1] + " unknownword"), (1, "the of word1 word2"), (2, None), (3, "nobody says this")]
    docs, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "id long, text string")
    sets, w, n = weights(rows)
    cosine, cover = {}, {}
    for q, text in asked:
        mine = {t for t in (text or "").split() if len(t) > 1}
        for d, s in sets.items():
            inter = sum(w[t] for t in mine & s)
            whole = lambda unknown: sum(w.get(t, math.log(1 + n / unknown)) for t in mine)
            if inter and round(inter / math.sqrt(whole(1) * sum(w[t] for t in s)), 5) >= least:
                cosine[q, d] = round(inter / math.sqrt(whole(1) * sum(w[t] for t in s)), 5)
            if inter and round(inter / whole(0.5), 5) >= least:
                cover[q, d] = round(inter, 4)
    got = {(r["query"], r["doc"]): r["score"] for r in overlap.matching(docs, queries, least).collect()}
    assert got.keys() == cosine.keys() and all(abs(got[k] - v) < 2e-5 for k, v in cosine.items())
    assert {(r["query"], r["doc"]): round(r["inter"], 4) for r in overlap.covering(docs, queries, least).collect()} == cover


# --- lineage


def test_chain_of_five_thousand(spark):
    """All of a long chain, and of it only what seeds ask for."""
    n = 5000
    edges = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"), (F.col("id") - 1).alias("dst_at"))
    all_ = codegraph.ancestors(edges).groupBy("node").count()
    assert all_.agg(F.count("*"), F.sum("count"), F.max("count")).first()[:] == (n - 1, n * (n - 1) // 2, n - 1)
    seeds = spark.createDataFrame([(4999, 4990), (10, 0)], "node long, floor long")
    got = sorted((r["node"], r["ancestor"]) for r in codegraph.ancestors(edges, seeds).collect())
    assert got == [(10, k) for k in range(10)] + [(4999, k) for k in range(4990, 4999)]


def test_circles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    got = {(r["node"], r["ancestor"]) for r in codegraph.ancestors(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}


def test_same_text_far_up(spark):
    n = 40
    rows = [(k, k, "same" if k in (0, 20, 39) else f"own{k}", [k - 1] if k else []) for k in range(n)]
    rules = spark.createDataFrame(rows, "id long, captured long, text_key string, supersedes array<long>")
    got = {(r["id"], r["ancestor"]) for r in rulebook.same_key_ancestors(rules, rulebook.supersede_edges(rules)).collect()}
    assert got == {(20, 0), (39, 0), (39, 20)}


def test_bases_ten_levels_up(spark):
    bases = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 3)], "src long, dst long")
    members = spark.createDataFrame([(11, "run", 911), (0, "run", 900), (5, "stop", 905)], "cls long, name string, target long")
    asked = spark.createDataFrame([(1, 1, "run"), (2, 6, "stop"), (3, 6, "none")], "ref long, cls long, name string")
    assert {tuple(r) for r in codegraph.nearest_member(asked, members, bases).collect()} == {(1, 911, 10), (2, 905, 9)}
    assert (900, 911, 11) in {tuple(r) for r in codegraph.overridden(members, bases).collect()}


# --- generations and stores


def test_of_two_writers_one_wins(spark, tmp_path):
    folder, told = f"file://{tmp_path}/snap", []
    gate = threading.Barrier(4)

    def write(k):
        gate.wait()
        told.append((generations.save_if_current({"t": spark.createDataFrame([(k,)], "k int")}, folder, 0), k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for ok, k in told if ok]
    assert len(won) == 1 and generations.newest_generation(spark, folder) == 1
    assert [r["k"] for r in generations.load_generation(spark, folder, "t").collect()] == won
    assert not generations.save_if_current({"t": spark.createDataFrame([(9,)], "k int")}, folder, 0)
    assert not claim(spark, f"{folder}/commits/1", "x") and claim(spark, f"{folder}/commits/2", "x")


def test_only_changed_files_are_parsed_and_their_buckets_written(spark, tmp_path):
    folder, parsed = f"file://{tmp_path}/store", []

    def parse(texts):
        parsed.append(sorted(r["path"] for r in texts.collect()))
        return texts.select("path", F.length("text").alias("n"))

    def files(rows):
        return spark.createDataFrame([(p, len(t), m, t) for p, m, t in rows], "path string, size long, mtime long, text string")

    first = [(f"d{k % 5}/f{k}", 1, "x" * k) for k in range(20)]
    generations.bring_up_to_date(files(first), folder, parse, 1)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    second = [(p, 2 if p == "d0/f5" else m, "changed" if p == "d0/f10" else t) for p, m, t in first if p != "d0/f15"] + [("d0/new", 1, "nn")]
    told = {r["path"]: (r["action"], r["bucket"]) for r in generations.bring_up_to_date(files(second), folder, parse, 2).collect()}
    assert parsed[1] == ["d0/f10", "d0/new"]
    assert {p: a for p, (a, _) in told.items() if a != "same"} == {"d0/f5": "touched", "d0/f10": "parse", "d0/f15": "removed", "d0/new": "new"}
    dirty = {b for a, b in told.values() if a != "same"}
    kept = {p for p in before if p.parent.name.removeprefix("bucket=") not in dirty}
    assert kept and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in kept)
    stored = {r["path"]: (r["n"], r["run"], r["mtime"]) for r in spark.read.parquet(folder).collect()}
    assert stored["d0/f5"] == (5, 1, 2) and stored["d0/f10"] == (7, 2, 1) and "d0/f15" not in stored and len(stored) == 20
    assert {r["action"] for r in generations.bring_up_to_date(files(second), folder, parse, 3).collect()} == {"same"} and len(parsed) == 2


# --- search, admission, rules of languages


def test_search_by_lines(spark):
    rows = [("a/x", "one fish\r\ntwo FISH\n\nred fish"), ("a/y", None), ("b/z", "\n".join(["none"] * 70 + ["a fi" + "sh"])), ("ab", "fish")]
    index = text_search.index_lines(spark.createDataFrame(rows, "path string, text string"))
    asked = [("fish", False, False, None), ("fish", False, True, "a"), ("f.sh$", True, False, "a/x"), ("zz", False, False, None), ("", False, False, None), ("red|two", True, False, None), ("(", False, False, None)]
    found = text_search.search_lines(index, spark.createDataFrame(asked, "pattern string, regex boolean, ignore_case boolean, under string"), 3)
    got = sorted((r["q"], r["path"], r["line"], r["total"]) for r in found.collect())
    by_question = {}
    for q, *rest in got:
        by_question.setdefault(q, []).append(tuple(rest))
    assert sorted(by_question.values()) == sorted(
        [[("a/x", 1, 4), ("a/x", 4, 4), ("ab", 1, 4)], [("a/x", 1, 3), ("a/x", 2, 3), ("a/x", 4, 3)], [("a/x", 1, 2), ("a/x", 4, 2)], [("a/x", 2, 2), ("a/x", 4, 2)]]
    )
    assert text_search.needed("ab?cde", True) == [] and text_search.needed("abcd+", True) == ["abc", "bcd"] and text_search.needed("Abcd", False) == ["abc", "bcd"]


def test_maps_of_blocks_hold_the_runs_of_each_line_alone():
    import numpy as np

    blocks = [["one Fish", "", "ab", "Ｒed"], [], ["x"], ["Σas", "\U0001f600ab"]]
    for lines, made in zip(blocks, text_search.block_maps(blocks), strict=True):
        want = np.zeros(text_search.MARKS, np.uint8)
        want[text_search.marks(set().union(*map(text_search.runs_of, lines)))] = 1
        assert made == np.packbits(want).tobytes()


def test_refused_calls_do_not_count(spark):
    minute = 60_000_000
    rows = [("p/a", "a", t * minute, k) for k, t in enumerate((0, 1, 2, 3, 70))] + [("p/b", "b", 0, 9)]
    got = {r["i"]: r["admitted"] for r in asof.admit(spark.createDataFrame(rows, "key string, kind string, at long, i long"), "key", "kind", "at", "i", {"a": 2, "b": 0}, 3600).collect()}
    assert got == {0: 0, 1: minute, 2: 60 * minute + 1, 3: 61 * minute + 1, 4: 120 * minute + 2, 9: None}


def test_schema_of_the_user_comes_first(spark):
    files = spark.createDataFrame([("a.sql", "sql", None), ("b.sql", "sql", None)], "path string, lang string, pkg string")
    tops = spark.createDataFrame([("a.sql", "sales.items", 1, "table"), ("b.sql", "stock.items", 2, "table"), ("b.sql", "plain", 3, "table")], "path string, name string, target long, kind string")
    asked = spark.createDataFrame([(10, "a.sql", "items", "sales.view"), (11, "a.sql", "items", "stock.view"), (12, "a.sql", "plain", "stock.view"), (13, "a.sql", "items", "loose")], "ref long, path string, name string, user string")
    none = spark.createDataFrame([], "path string, imp string, module string, name string, alias string")
    assert {tuple(r) for r in imports.generic_names(asked, files, tops, none).select("ref", "target").collect()} == {(10, 1), (11, 2), (12, 3)}


@pytest.mark.parametrize("block", [((3, 2), (20, 5)), overlap.BLOCK])
def test_weighed_in_blocks(spark, monkeypatch, block):
    """Blocks and cells of any size give each pair once, with all it shares; with a need only the pairs that reach it."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "CELLS", 40 if block[0][0] == 3 else overlap.CELLS)
    rows = families(60)
    docs = spark.createDataFrame(rows, "id long, text string")
    a = overlap.asked_sets(docs, docs.filter("id < 15"))
    sets, w, _ = weights(rows)
    want = {(q, d): sum(w[t] for t in sets[q] & sets[d]) for q in range(15) for d in sets}
    for need in (0.0, 5.0):
        got = overlap.weighed(a.wanted.withColumn("total", F.lit(1.0)).withColumn("need", F.lit(need)), a.held.withColumn("need", F.lit(1.0)), a.n).collect()
        met = {k for k, v in want.items() if v and v >= need}
        assert len(got) == len(met) and {(r["l"], r["r"]) for r in got} == met and all(abs(r["inter"] - want[r["l"], r["r"]]) < 1e-9 for r in got)


def test_shared_tokens_of_little_weight(spark):
    """A document that shares one common word with a long query is listed with it."""
    docs = spark.createDataFrame([(0, "the end"), (1, "the other"), (2, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "the end of many other words and more of them")], "id long, text string")
    assert {(r["query"], r["doc"]) for r in overlap.covering(docs, asked, 0.0, None).collect()} == {(7, 0), (7, 1)}
    query = next(q for q in joins.QUERIES if q.name == "jn17_token_overlap")
    assert "0.25" not in query.oracle


def test_selection_has_every_rule_and_prompt(spark):
    """Each rule has an outcome for each prompt, and of the scores below the threshold none is lost."""
    told = {(r["pid"], r["id"]): r for r in rulebook.ct02_outcomes(spark, "/root/testdata/sf0.001").collect()}
    assert len(told) == 200 * 40 and len({r["outcome"] for r in told.values()}) >= 5
    assert any(0 < r["score"] < 0.12 and r["outcome"] == "below threshold" for r in told.values())
    sql = {q.name: q.oracle for q in rulebook.QUERIES}
    assert "WHERE outcome IN" not in sql["ct02_selection_outcomes"] and "% 13" in sql["so08_prompt_selection"] and "score > 0" in sql["ct04_explain"] and "% 97" in sql["ct02_outcome_counts"]


def test_wild_imports_of_a_large_namespace(spark, monkeypatch):
    """Of 60 files that import a namespace of 60 files, no step has a row for each two of them."""
    sizes, cut = [], imports.checkpointed

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(imports, "checkpointed", counted)
    n = spark.range(60).select(F.col("id").alias("n"))
    path = F.concat(F.lit("gen/f"), "n", F.lit(".cs"))
    files = n.select(path.alias("path"), F.lit("csharp").alias("lang"), F.lit("Ns").alias("pkg"))
    tops = n.select(path.alias("path"), F.concat(F.lit("N"), "n").alias("name"), F.col("n").alias("target"), F.lit("class").alias("kind"))
    users = n.select((F.col("n") + 100).alias("n"))
    files = files.unionByName(users.select(path.alias("path"), F.lit("csharp").alias("lang"), F.lit("App").alias("pkg")))
    asked = users.select("n", path.alias("path"), F.concat(F.lit("N"), F.col("n") - 100).alias("name")).withColumnRenamed("n", "ref")
    specs = users.select(path.alias("path"), F.lit("wild").alias("imp"), F.lit("Ns").alias("module"), F.lit("").alias("name"), F.lit("").alias("alias"))
    got = {(r["ref"], r["rule"], r["target"]) for r in imports.generic_names(asked, files, tops, specs).collect()}
    assert got == {(k + 100, 3, k) for k in range(60)} and max(sizes) < 60 * 20


def test_pairs_of_one_long_front(spark, monkeypatch):
    """Long texts that share many words grow no keys, and meet in blocks of few sets."""
    monkeypatch.setattr(overlap, "FRONT", (64, 64, 4))
    monkeypatch.setattr(overlap, "_grown", None)
    common = [f"common{k}" for k in range(300)]
    rows = [(i, " ".join(common[i % 7 :: 7] + [f"own{i}x{k}" for k in range(60)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " further") for i in range(5)]
    pairs, _ = overlap.similar_pairs(spark.createDataFrame(rows, "id long, text string"), 0.6)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, 100 + i) for i in range(5)}


@pytest.mark.parametrize("name", ["pf23_injection_guard", "tx02_tokens", "tx13_error_excerpt"])
def test_one_row_group_is_worked_on_by_many_tasks(spark, name):
    """A table of one file with one row group is one task if its rows are not dealt out first."""
    from quarrylake.plans import registry

    made = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() > 1


def test_texts_are_worked_out_once_for_both_neighbours(spark, monkeypatch):
    """What two neighbours are compared by is made once for each text, not once for each side of a pair."""
    from quarrylake.functions import text as T
    from quarrylake.operators import wording

    made, real = [], T.canonical
    monkeypatch.setattr(T, "canonical", lambda c: made.append(c) or real(c))
    got = wording.tx10_same_rule(spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and got.count() == got.select("doc_id").distinct().count()


def test_guard_looks_at_the_first_sign_of_a_match_before_what_stands_behind_it():
    from quarrylake.functions import screening

    for g in screening.GUARDS:
        pattern = screening._guard_pattern(g)
        assert "(?<!" not in pattern.replace(screening.EDGE, "") or pattern.startswith(f"(?i)(?=[{g.first}])")


def test_affix_of_many_commands_makes_no_pairs(spark):
    """Items are counted by their ends first: what meets the commands has one row for each end, not one for each item."""
    from quarrylake.operators import proposals

    items = spark.range(2000).select(F.format_string("R%06d", "id").alias("id"), F.lit("k").alias("kind"))
    commands = spark.range(300).select(F.col("id").alias("n"), F.lit("k").alias("kind"), F.when(F.col("id") == 0, "r000007").otherwise("07").alias("affix"))
    got = {r["n"]: (r["hits"], r["id"]) for r in proposals.by_affix(commands, items).collect()}
    assert got == {0: (1, "R000007")} | {n: (20, "R000007") for n in range(1, 300)}


def test_levels_of_bases_are_not_broadcast(spark, monkeypatch):
    plans, real = [], codegraph.checkpointed
    monkeypatch.setattr(codegraph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    asked = spark.createDataFrame([(1, 9, "run")], "ref long, cls long, name string")
    members = spark.createDataFrame([(0, "run", 5)], "cls long, name string, target long")
    bases = spark.createDataFrame([(k, k // 3) for k in range(1, 10)], "src long, dst long")
    assert [tuple(r) for r in codegraph.nearest_member(asked, members, bases).collect()] == [(1, 5, 3)]
    assert not any("Broadcast" in p for p in plans)


def test_tasks_name_their_files_themselves(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from quarrylake.operators import sinks

    asked, real = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: asked.update({k: v}) or real(self, k, v))
    sinks.write_each(spark.createDataFrame([("a", "x"), ("b", "y")], "name string, value string"), str(tmp_path / "out"), "name")
    assert asked["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    assert sorted(p.parent.name for p in (tmp_path / "out").rglob("*.txt")) == ["name=a", "name=b"]


def test_modules_of_a_project_are_parsed_by_all_cores(spark):
    """The suppliers are one file with one row group, which alone would be one task."""
    from quarrylake.operators.code_queries import project_files

    files = project_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.select("path").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def test_rules_of_the_generic_resolver_are_jobs_of_their_own(spark, monkeypatch):
    """The driver takes memory for a plan as a whole, so no plan has the joins of all rules."""
    from quarrylake.operators import imports

    joins, real = [], imports.checkpointed
    count = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Join")
    monkeypatch.setattr(imports, "checkpointed", lambda df: joins.append(count(df)) or real(df))
    result = imports.gr09_generic(spark, "/root/testdata/sf0.001")
    assert max([*joins, count(result)]) <= 8


def test_pairs_that_do_not_stay_are_no_rows(spark, monkeypatch):
    """Pairs are weighed where they are found, and blocks meet in rounds that shuffle a bounded number of tokens."""
    monkeypatch.setattr(overlap, "FRONT", (64, 64, 8))
    monkeypatch.setattr(overlap, "ROUND", 1)
    made, real = [], overlap._met
    monkeypatch.setattr(overlap, "_met", lambda *a: made.append(real(*a)) or made[-1])
    rows = families()
    pairs, _ = overlap.similar_pairs(spark.createDataFrame(rows, "id long, text string"), 0.6)
    assert len(made) > 1
    assert sum(m.count() for m in made) == sum(m.filter("inter >= 0.5999 * sqrt(lt * rt)").count() for m in made) == pairs.count() > 0


def test_tokens_of_documents_are_checkpointed_by_document(spark, monkeypatch):
    """A checkpoint has no row for each token of a document, which would be many times its text."""
    kept, real = [], overlap.checkpointed
    monkeypatch.setattr(overlap, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(50))) for i in range(20)], "id long, text string")
    a = overlap.asked_sets(docs, docs.filter("id < 2"))
    assert a.n == 20 and a.held.count() == 2
    assert not any({"id", "tok"} <= set(k.columns) and k.count() > 200 for k in kept)


def test_facts_of_a_project_are_not_broadcast(spark, monkeypatch):
    """What facts were made from says nothing of their size, so links are merged; and no plan has all ways of linking."""
    from quarrylake.operators import code_queries

    plans, real = [], codegraph.checkpointed
    monkeypatch.setattr(codegraph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    row = code_queries.gr14_statistics(spark, "/root/testdata/sf0.001").first()
    assert row["refs"] > row["resolved"] > 0
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 5
