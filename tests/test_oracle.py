import os

import pytest

from strataweave.queries import general, graph, history, knowledge, more, resolving, stores
from tests.oracle import agree, connect

FOLDER = "/root/testdata/sf0.001"
MODULES = [general, graph, history, knowledge, more, resolving, stores]
PAIRS = [(n, f, m.oracle_sql().get(n)) for m in MODULES for n, f in m.queries().items()]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", [n for n, _, _ in PAIRS])
def test_query(spark, con, name):
    _, query, sql = next(p for p in PAIRS if p[0] == name)
    if sql:
        agree(spark, con, FOLDER, query, sql)
    else:
        df = query(spark, FOLDER)
        rows = df.collect()
        assert len(set(df.columns)) == len(df.columns) and rows and not any(all(v is None for v in r) for r in rows)
