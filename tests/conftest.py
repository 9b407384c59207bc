import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tamiz.session import local_session

    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def compare(spark, data):
    """Rows of a query against those of its SQL in DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")

    def rows(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        even = lambda v: round(v, 6) if isinstance(v, float) else v
        return sorted((tuple(even(r[i]) for i in order) for r in values), key=repr)

    def check(query, sql):
        df = query(spark, data)
        other = con.sql(sql)
        assert sorted(df.columns) == sorted(other.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(other.columns, other.fetchall())

    return check
