"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import pytest

from quillon.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    want = duck.sql(ORACLES[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols
    duck.register("got", got.select(cols))
    duck.register("want", want.select(cols))
    assert got.num_rows == want.num_rows
    assert duck.sql("SELECT * FROM got EXCEPT ALL SELECT * FROM want LIMIT 3").fetchall() == []
    assert [str(got.schema.field(c).type).replace("large_", "") for c in cols if "timestamp" not in str(got.schema.field(c).type)] == [str(want.schema.field(c).type).replace("large_", "") for c in cols if "timestamp" not in str(got.schema.field(c).type)]
