"""Bounded graph walks as frontier joins.

The rows of a hop depend only on the set of nodes of the hop before, and the result is distinct; so each hop joins the
distinct frontier with the edges, never the multiset of paths.  `both` is a union of two equi-joins.  Frontiers are
cut from the plan with written tables; only the test for an empty one is an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.plans.cut import cut


def steps(edges: DataFrame, direction: str, types: list[str] | None = None, confidence: float | None = None) -> DataFrame:
    """(src, dst, edge_type) in walking direction; an edge without confidence passes any floor."""
    some = edges.where(F.col("type").isin(types)) if types else edges
    if confidence is not None:
        some = some.where(F.coalesce(F.col("confidence").cast("decimal(10,4)") >= F.lit(confidence).cast("decimal(10,4)"), F.lit(True)))
    out = some.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("type").alias("edge_type"))
    back = some.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), F.col("type").alias("edge_type"))
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def walk(start: DataFrame, edges: DataFrame, direction: str, depth: int, types: list[str] | None = None, confidence: float | None = None, visited: bool = False) -> DataFrame:
    """(node_id, depth, edge_type, parent_id) from the ids of `start` (column id).

    A walk may come back to nodes; with `visited` each node counts at its first depth only, with all parents there."""
    # Edges may come from a view that aggregates its tables: each hop would do that again.
    moves = cut(steps(edges, direction, types, confidence), "moves")
    frontier, seen, found = start.select("id").distinct(), start.select("id").distinct(), None
    for hop in range(1, depth + 1):
        rows = frontier.join(moves, F.col("id") == F.col("src")).select(F.col("dst").alias("node_id"), F.lit(hop).alias("depth"), "edge_type", F.col("src").alias("parent_id")).distinct()
        if visited:
            rows = rows.join(seen.withColumnRenamed("id", "node_id"), "node_id", "left_anti")
        rows = cut(rows, f"hop{hop}")
        found = rows if found is None else found.unionByName(rows)
        frontier = rows.select(F.col("node_id").alias("id")).distinct()
        if hop == depth or rows.isEmpty():
            break
        if visited:
            seen = seen.union(frontier)
    return found.select("node_id", "depth", "edge_type", "parent_id")


def first_of(nodes: DataFrame, name: str, prefer: list[str], project: str | None = None) -> DataFrame:
    """The node a query means: of those with the name, one with a preferred label, else the first by id."""
    hit = nodes.where(F.lower("name") == name.lower())
    hit = hit.where(F.col("project") == project) if project else hit
    return hit.orderBy((~F.col("label").isin(prefer)).cast("int"), "id").limit(1).select("id")


def one_hop(nodes: DataFrame, edges: DataFrame, targets: DataFrame, types: list[str]) -> DataFrame:
    """Sources of edges of these types into the targets, once by qualified name (the smallest id)."""
    hit = edges.where(F.col("type").isin(types)).join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    sources = nodes.join(hit.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    return sources.groupBy("qualified_name").agg(F.min(F.struct("id", "name", "project", "label")).alias("m")).select("m.id", "m.name", "qualified_name", "m.project", "m.label")
