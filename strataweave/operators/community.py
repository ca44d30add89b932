"""Communities of repositories: weighted adjacency, modularity, Louvain, betweenness, clusters.

The adjacency is one row per pair of projects, a distributed aggregate.  Louvain (one level, sequential by definition) and betweenness run on that projected
graph, whose size is the number of repositories and not of edges; `LIMIT_NODES` refuses anything larger.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of edge types, and the bonus of a pair with edges both ways.
WEIGHTS = {"PUBLISHES": 3.0, "CONSUMES": 3.0, "HTTP_CALLS": 2.0, "REFERENCES_PACKAGE": 1.0}
BOTH_WAYS = 1.5
LIMIT_NODES = 20_000


def adjacency(cross: DataFrame) -> DataFrame:
    """(a, b, weight), a < b, by lower-case project."""
    w = F.lit(1.0)
    for t, v in WEIGHTS.items():
        w = F.when(F.col("type") == t, v).otherwise(w)
    e = cross.select(F.lower("source_project").alias("s"), F.lower("target_project").alias("t"), w.alias("w")).where("s <> t")
    one = e.groupBy("s", "t").agg(F.sum("w").alias("w"))
    pair = one.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("ways"))
    return pair.select("a", "b", (F.col("w") * F.when(F.col("ways") == 2, BOTH_WAYS).otherwise(1.0)).alias("weight"))


def modularity(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over communities of inside/m - (total/2m)^2, with m the sum of weights."""
    ends = adj.select(F.col("a").alias("project"), "weight").union(adj.select("b", "weight"))
    strength = ends.groupBy("project").agg(F.sum("weight").alias("k"))
    total = strength.join(labels, "project").groupBy("community").agg(F.sum("k").alias("tot"))
    la, lb = labels.select(F.col("project").alias("a"), F.col("community").alias("ca")), labels.select(F.col("project").alias("b"), F.col("community").alias("cb"))
    inside = adj.join(la, "a").join(lb, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("win"))
    m = F.lit(adj.agg(F.sum("weight")).first()[0] or 1.0)  # one number
    parts = total.join(inside, "community", "left")
    return parts.agg(F.round(F.sum(F.coalesce("win", F.lit(0.0)) / m - F.pow(F.col("tot") / (2 * m), 2)), 6).alias("modularity"))


def _graph(adj: DataFrame) -> dict[str, dict[str, float]]:
    rows = adj.limit(LIMIT_NODES * 50 + 1).collect()  # pairs of repositories
    if len(rows) > LIMIT_NODES * 50:
        raise ValueError(f"more than {LIMIT_NODES * 50} pairs of repositories")
    rows.sort()
    graph: dict[str, dict[str, float]] = {}
    for a, b, w in rows:
        graph.setdefault(a, {})[b] = w
        graph.setdefault(b, {})[a] = w
    if len(graph) > LIMIT_NODES:
        raise ValueError(f"more than {LIMIT_NODES} repositories")
    return graph


def louvain_labels(graph: dict[str, dict[str, float]], sweeps: int = 100) -> dict[str, int]:
    """First phase of Louvain: nodes in name order move to the neighbouring community with the greatest positive gain."""
    names = sorted(graph)
    m = sum(w for u in graph for w in graph[u].values()) / 2
    home = {u: i for i, u in enumerate(names)}
    strength = {u: sum(graph[u].values()) for u in names}
    total = {home[u]: strength[u] for u in names}
    for _ in range(sweeps if m else 0):
        moved = False
        for u in names:
            near: dict[int, float] = {}
            for v, w in graph[u].items():
                near[home[v]] = near.get(home[v], 0.0) + w
            total[home[u]] -= strength[u]
            gains = {c: w / m - total[c] * strength[u] / (2 * m * m) for c, w in near.items()}
            best, gain = home[u], 0.0
            for c, g in gains.items():
                if g > gain:
                    best, gain = c, g
            moved |= best != home[u]
            home[u] = best
            total[best] += strength[u]
        if not moved:
            break
    number: dict[int, int] = {}
    return {u: number.setdefault(home[u], len(number)) for u in names}


def louvain(adj: DataFrame) -> DataFrame:
    labels = louvain_labels(_graph(adj))
    return adj.sparkSession.createDataFrame([(u, c) for u, c in labels.items()] or [], "project string, community int")


def betweenness_from(graph: dict[str, dict[str, float]], source: str) -> dict[str, float]:
    """Shares of unweighted shortest paths from one source that pass each node."""
    dist, paths, order, before = {source: 0}, {source: 1.0}, [], {source: []}
    todo = deque([source])
    while todo:
        u = todo.popleft()
        order.append(u)
        for v in graph[u]:
            if v not in dist:
                dist[v], paths[v], before[v] = dist[u] + 1, 0.0, []
                todo.append(v)
            if dist[v] == dist[u] + 1:
                paths[v] += paths[u]
                before[v].append(u)
    share = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for u in before[v]:
            share[u] += paths[u] / paths[v] * (1 + share[v])
    share.pop(source)
    return share


def betweenness(adj: DataFrame) -> DataFrame:
    """(project, centrality), divided by (n-1)(n-2): sources are spread over the cluster, shares are summed."""
    spark, graph = adj.sparkSession, _graph(adj)
    n = len(graph)
    handle = spark.sparkContext.broadcast(graph)  # pairs of repositories
    sources = spark.createDataFrame([(u,) for u in sorted(graph)], "project string").repartition(8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(u, 0.0) for u in f.project] + [x for u in f.project for x in betweenness_from(handle.value, u).items()]
            yield pd.DataFrame(rows, columns=["project", "share"])

    scale = (n - 1) * (n - 2) if n > 2 else 1
    return sources.mapInPandas(run, "project string, share double").groupBy("project").agg(F.round((F.sum("share") if n > 2 else F.lit(0.0)) / scale, 6).alias("centrality"))


def cluster_summary(cross: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, members, internal, external, density): edges inside, edges with one end inside."""
    a = labels.select(F.col("project").alias("s"), F.col("community").alias("cs"))
    b = labels.select(F.col("project").alias("t"), F.col("community").alias("ct"))
    e = cross.select(F.lower("source_project").alias("s"), F.lower("target_project").alias("t")).join(a, "s", "left").join(b, "t", "left")
    touched = e.select(F.explode(F.array_distinct(F.array_compact(F.array("cs", "ct")))).alias("community"), (F.col("cs") == F.col("ct")).alias("inside"))
    sums = touched.groupBy("community").agg(F.count_if(F.coalesce("inside", F.lit(False))).alias("internal"), F.count_if(~F.coalesce("inside", F.lit(False))).alias("external"))
    size = labels.groupBy("community").agg(F.count("*").alias("members"))
    possible = F.floor(F.col("members") * (F.col("members") - 1) / 2)
    return size.join(sums, "community", "left").fillna(0, ["internal", "external"]).withColumn("density", F.round(F.when(possible > 0, F.col("internal") / possible).otherwise(0.0), 6))


def cluster_graph(cross: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge counts between clusters; a project without cluster belongs to cluster 0."""
    a = labels.select(F.col("project").alias("s"), F.col("community").alias("cs"))
    b = labels.select(F.col("project").alias("t"), F.col("community").alias("ct"))
    e = cross.select(F.lower("source_project").alias("s"), F.lower("target_project").alias("t")).join(a, "s", "left").join(b, "t", "left").fillna(0, ["cs", "ct"])
    return e.groupBy(F.col("cs").alias("source_cluster"), F.col("ct").alias("target_cluster")).agg(F.count("*").alias("edges")).withColumn("is_cross", F.col("source_cluster") != F.col("target_cluster"))
