"""Every query of the subpackage on the smallest tables, against SQL where there is some."""

import glob
import os

import pytest

from vistaforge.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


COLUMNS = {"p1_found": "image_id_a image_id_b", "p2_found": "query_id image_id", "p3_found": "image_id_a image_id_b", "p5_found": "image_id_a image_id_b", "p6_found": "doc_id", "p7_found": "doc_id item_id", "p8_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name].split() and all(t == "bigint" for _, t in got.dtypes)
    got = got.toPandas()
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in q.oracle_sql():
        want = duck.sql(q.oracle_sql()[name]).df()[list(got.columns)]
        assert sorted(map(tuple, got.round(5).to_numpy().tolist())) == sorted(map(tuple, want.round(5).to_numpy().tolist()))
