"""Every query with SQL against DuckDB, the others for rows; and the whole library's import without its optional part."""

import subprocess
import sys

import duckdb
import pytest

from lumenstack.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    mine = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})")
    assert sorted(map(tuple, mine)) == sorted(cur.fetchall())


def test_import_without_optional_part():
    code = "import sys; sys.modules['lumenstack.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'mean_frame' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
