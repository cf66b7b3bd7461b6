"""Every query with SQL against DuckDB on the smallest tables, and that nothing outside the llm package needs it."""

import glob
import os
import subprocess
import sys

import pytest

from vistaforge.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.sql(registry.oracle_sql()[name]).df())
    assert len(set(got.columns)) == len(got.columns)


def test_names_and_sql_belong_together():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 70


def test_rest_works_without_the_llm_package():
    code = "import sys; sys.modules['vistaforge.llm'] = None; import vistaforge.plans.registry as r; r.queries(); print(any(m.startswith('vistaforge.llm.') for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.strip() == "False", out.stderr
    for path in glob.glob(f"{ROOT}/vistaforge/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "vistaforge.llm" not in open(path).read(), path
