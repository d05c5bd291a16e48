"""The driver's contract: every query against its DuckDB SQL, and an entry that works without the llm folders."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from newsloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


@needs_data
def test_entry_without_llm(tmp_path):
    for item in ("newsloom", "__spark_entry__.py"):
        path = os.path.join(ROOT, item)
        copy = shutil.copytree if os.path.isdir(path) else shutil.copy
        copy(path, tmp_path / item)
    shutil.rmtree(tmp_path / "newsloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'article_totals' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
