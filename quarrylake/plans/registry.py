"""All queries of the library and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import code_queries, consolidation, contexts, events, graph, histories, imports, joins, projects, proposals, records, resolution, rulebook, sinks, windows, wording, wordings
from ..streaming import queries as streams

#: Where a name stands in two modules, the later one is meant.
MODULES = (events, joins, windows, wording, records, resolution, contexts, graph, streams, code_queries, imports, projects, rulebook, wordings, histories, sinks, consolidation, proposals)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.oracle for m in MODULES for q in m.QUERIES if q.oracle}
