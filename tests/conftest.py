import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodevec.session import local_session

    s = local_session(8, shuffle=4, memory="6g", name="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    return con
