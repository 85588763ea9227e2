import duckdb
import pytest

from weftgraph.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(df, cols):
    values = df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: repr(float(v)) if isinstance(v, float) else str(v))
    return values.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = con.sql(SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert norm(got, cols).equals(norm(want, cols))


def test_the_rest_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['weftgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    from conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
