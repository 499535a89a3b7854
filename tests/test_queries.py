"""Every graph query equals its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillgraph import queries

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_integer_ratio") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(queries.SQL[name]).df())
