import os

import pytest

from strataweave.llm import queries as Q
from tests.oracle import agree, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, con, name):
    sql = Q.oracle_sql().get(name)
    if sql:
        agree(spark, con, FOLDER, Q.queries()[name], sql)
    else:
        df = Q.queries()[name](spark, FOLDER)
        rows = df.collect()
        assert len(set(df.columns)) == len(df.columns) and rows and not any(all(v is None for v in r) for r in rows)
