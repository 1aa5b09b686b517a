"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from quarrylake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, (bool, int, str)) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_optional_subpackage():
    """Nothing outside the subpackage imports it, and the entry module works without it."""
    import os
    import subprocess
    import sys

    block = (
        "import sys\nclass B:\n    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('quarrylake.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name='quarrylake.llm')\n"
        "sys.meta_path.insert(0, B())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') for n in q) and e.oracle_sql()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", block], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
