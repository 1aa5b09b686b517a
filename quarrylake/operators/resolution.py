"""Resolution walks, recall over several sources, pair overlap, and the Python-backed readers as queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed, ensure_checkpoint_dir
from ..plans.query import Query, table
from ..sources import rules, transcripts
from . import overlap
from .generations import load_generation, save_if_current
from .graph import DUCK_CHAIN, chain
from .wording import D


def gr29_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of orders as saved in its second generation, read back."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/snapshot-{uuid.uuid4().hex}"
    edges = chain(spark, sf)
    save_if_current({"edges": edges.filter("src < 0")}, folder, 0)
    save_if_current({"edges": edges}, folder, 1)
    return load_generation(spark, folder, "edges")


def jn18_pair_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents whose weighted overlap is 0.6 or more, each pair once; one document of each wording, and how many it stands for."""
    pairs, members = overlap.similar_pairs(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 0.6)
    members = checkpointed(members.groupBy("id").agg(F.count("*").alias("n")))
    return pairs.join(members.toDF("a", "a_stands_for"), "a").join(members.toDF("b", "b_stands_for"), "b").select("a", "b", "score", "a_stands_for", "b_stands_for")


JN18 = f"""
    WITH t AS (SELECT doc_id, list_sort({D}) AS toks FROM documents), x AS (SELECT toks, min(doc_id) AS id, count(*) AS copies FROM t WHERE len(toks) > 0 GROUP BY toks),
    p AS (SELECT id, copies, unnest(toks) AS tok FROM x),
    w AS (SELECT tok, ln(1 + (SELECT count(*) FROM documents) / sum(copies)) AS w FROM p GROUP BY tok),
    n AS (SELECT id, sum(w) AS n FROM p JOIN w USING (tok) GROUP BY id)
    SELECT s.a, s.b, score, x.copies AS a_stands_for, y.copies AS b_stands_for FROM (SELECT a.id AS a, b.id AS b, round(sum(w) / sqrt(any_value(x.n) * any_value(y.n)), 5) AS score
        FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id JOIN w ON w.tok = a.tok JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY a.id, b.id) s JOIN x ON x.id = s.a JOIN x y ON y.id = s.b WHERE score >= 0.6
"""


def sc06_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies with three headings, split into their sections."""
    body = F.concat(F.lit("# Title\n## Rule\n"), "text", F.lit("\n## Why\nsafety\n## Odd heading\n"), F.col("item_id").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [rules.sections(b) for b in batch["body"]]
            yield batch[["item_id"]].assign(**{k: [p[k] for p in parts] for k in ("rule", "reason", "notes")})

    found = table(spark, sf, "benchmark").select("item_id", body.alias("body")).mapInPandas(run, "item_id long, rule string, reason string, notes string")
    return found.withColumn("rule", F.sha2("rule", 256))


def sc22_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands anywhere in a JSON record, also inside an argument string."""
    shown = F.concat(F.lit('{"a": [{"input": {"command": " run '), F.get_json_object("props", "$.k"), F.lit('"}}], "arguments": "{\\"cmd\\": [\\"ls\\", \\"-'), F.col("event_type"), F.lit('\\"]}"}'))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = [(i, n, c) for i, line in zip(batch["event_id"].tolist(), batch["line"], strict=True) for n, c in enumerate(transcripts.commands_in(json.loads(line)))]
            if rows:
                yield pd.DataFrame(rows, columns=["event_id", "n", "command"])

    return table(spark, sf, "events").select("event_id", shown.alias("line")).mapInPandas(run, "event_id long, n int, command string")


def tx14_check_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Shell lines split into checks, and whether the exit status is theirs."""
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.when(k < 30, F.lit("cd app && pytest -q")).when(k < 60, F.lit("npm test 2>&1 | tail -5")).when(k < 80, F.lit("set -o pipefail; npm run build | tee log && pytest")).otherwise(F.lit("ls -l"))
    return table(spark, sf, "events").select("event_id", transcripts.check_parts(line).alias("x")).select("event_id", F.size("x.checks").alias("checks"), "x.own")


TX14 = """
    SELECT event_id, CASE WHEN k < 30 THEN 1 WHEN k < 60 THEN 1 WHEN k < 80 THEN 2 ELSE 0 END AS checks, k < 30 OR k >= 60 AS own
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""

QUERIES = [
    Query("gr29_snapshot", gr29_snapshot, f"SELECT * FROM ({DUCK_CHAIN}) WHERE dst IS NOT NULL"),
    Query("jn18_pair_overlap", jn18_pair_overlap, JN18),
    Query("sc06_sections", sc06_sections, "SELECT item_id, sha256(trim(text)) AS rule, 'safety' AS reason, '## Odd heading' || chr(10) || item_id AS notes FROM benchmark"),
    Query("sc22_collect_commands", sc22_commands, "SELECT event_id, 0 AS n, 'run ' || json_extract_string(props, '$.k') AS command FROM events UNION ALL SELECT event_id, 1, 'ls -' || event_type FROM events"),
    Query("tx14_check_parts", tx14_check_parts, TX14),
]
