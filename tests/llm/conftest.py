import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def queries():
    from lumenframe.llm.registry import QUERIES

    return QUERIES


@pytest.fixture(scope="session")
def duck(small):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c
