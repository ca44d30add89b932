"""Plans that must hold at any size: pruned scans, pushed filters, no nested loops over data."""

import os

import pytest
from pyspark.sql import functions as F

from strataweave.operators import references as R
from strataweave.operators import store as S
from strataweave.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    p = plan(R.orphan_references(*(table(spark, FOLDER, t) for t in ("pending_edges", "cross_repo_impacts", "nodes", "repositories"))))
    scans = [x for x in p.split("ReadSchema: ")[1:]]
    assert scans and all("properties" not in x.split("\n")[0] for x in scans)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_filters_reach_the_scan(spark):
    p = plan(S.by_label(table(spark, FOLDER, "nodes"), "Class", 10).select("id"))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,Class)]" in p and "TakeOrdered" in p


def test_either_end_is_no_nested_loop(spark):
    edges = table(spark, FOLDER, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("type"))
    p = plan(S.edges_touching(edges, spark.range(50).select("id")))
    assert "NestedLoop" not in p and "Cartesian" not in p
