"""A registered query: how Spark computes it and the SQL that it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly over the tasks before heavy work on each: a file is only cut at its row groups, which may be few."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(most, *keys)


def sql_query(name: str, text: str, oracle: str | None = None) -> Query:
    """A query in SQL over ``{table}`` placeholders; its oracle is given here or among the second forms, never its own text."""
    oracle = oracle or ORACLES.get(name)
    if oracle is None:
        raise ValueError(f"{name} has nothing to be held against")
    used = [t for t in TABLES if "{" + t + "}" in text]
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], s)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    return Query(name, run, plain(oracle))


def literal(value: object) -> str:
    """A value as SQL text."""
    if isinstance(value, bool) or value is None:
        return "NULL" if value is None else str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


#: Stands for the row's key in a worked case.
KEY = "«key»"


def worked(name: str, source: str, key: str, inputs: tuple[str, ...], outputs: tuple[str, ...], cases: list[tuple], make: Callable[..., Column], text: str | None = None, last: bool = False) -> Query:
    """A text operator over every row of a table, each row with one of some worked cases around its key.

    A case has the inputs and then the outputs that were worked out by hand; row n takes case n modulo
    their number, and ``KEY`` in a text stands for n.  ``make`` takes the inputs as columns and gives one
    column, or a struct where there are several outputs.  The SQL looks the outputs up.  With ``text`` the
    case is planted in the row's own text of that column, which stands below it (above it, if ``last``).
    """
    width = len(cases)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, *([F.coalesce(text, F.lit("")).alias("_text")] if text else []))
        rows = spread(rows, key, "_text") if text else rows
        at = F.pmod(F.col(key), F.lit(width)).cast("int") + 1
        for k, column in enumerate(inputs):
            value = F.element_at(F.array(*[F.lit(c[k]).cast("string") for c in cases]), at)
            value = F.replace(value, F.lit(KEY), F.col(key).cast("string"))
            parts = (F.col("_text"), value) if last else (value, F.col("_text"))
            rows = rows.withColumn(column, F.concat(parts[0], F.lit("\n\n"), parts[1]) if text and k == 0 else value)
        made = rows.withColumn("_made", make(*map(F.col, inputs)))
        if len(outputs) == 1:
            return made.select(key, F.col("_made").alias(outputs[0]))
        return made.select(key, *[F.col(f"_made.{o}").alias(o) for o in outputs])

    def shown(column: str, values: list) -> str:
        text = any(isinstance(v, str) for v in values)
        return f"replace(c.{column}, '{KEY}', {key}::VARCHAR) AS {column}" if text else f"c.{column}"

    values = ", ".join(f"({k}, {', '.join(literal(v) for v in c[len(inputs):])})" for k, c in enumerate(cases))
    picked = ", ".join(shown(o, [c[len(inputs) + k] for c in cases]) for k, o in enumerate(outputs))
    return Query(name, run, f"SELECT {key}, {picked} FROM {source} JOIN (VALUES {values}) c(case_no, {', '.join(outputs)}) ON {key} % {width} = c.case_no")
