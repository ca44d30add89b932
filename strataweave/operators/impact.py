"""What a change reaches: inbound waves, a step across repositories, and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.traverse import steps
from strataweave.plans.cut import cut

# Edge types that say who depends on whom, and those that weigh more.
DEPENDENCY = ["CALLS", "HTTP_CALLS", "CONSUMES", "USES_TYPE", "INJECTS", "IMPLEMENTS", "INHERITS", "HANDLES", "REFERENCES_PACKAGE", "RENDERS", "SUBSCRIBES"]
CROSSING = ["HTTP_CALLS", "CONSUMES", "PUBLISHES", "REFERENCES_PACKAGE"]
ASYNC = ["CONSUMES", "PUBLISHES"]


def reach(start: DataFrame, edges: DataFrame, cross: DataFrame, depth: int) -> DataFrame:
    """start: (id, project). (id, depth, edge_type, source_project) of every reached node at its least depth.

    Inbound waves from all starts together, one step over the cross-repository edges of the start projects, then
    inbound waves on. Ties: the least (edge_type, source_project)."""
    moves = cut(steps(edges, "inbound", DEPENDENCY), "moves")  # read by every hop
    pick = F.min(F.struct("depth", "edge_type", "source_project")).alias("m")

    def settle(df: DataFrame, label: str) -> DataFrame:
        return cut(df.groupBy("id").agg(pick).select("id", "m.*"), label)

    def waves(seeds: DataFrame, known: DataFrame, label: str) -> DataFrame:
        frontier = seeds
        for hop in range(1, depth + 1):
            at = frontier.where(F.col("depth") == hop - 1)
            new = at.drop("edge_type").join(moves, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(hop).alias("depth"), "edge_type", "source_project")
            new = settle(new.join(known.select("id"), "id", "left_anti"), f"{label}{hop}")
            frontier = frontier.unionByName(new)
            known = known.select("id").union(new.select("id"))  # each wave is written once and disjoint from the others
        return frontier

    begin = start.select("id", F.lit(0).alias("depth"), F.lit("CHANGED").alias("edge_type"), F.col("project").alias("source_project"))
    first = cut(waves(begin, begin, "wave"), "first")
    projects = start.select(F.col("project").alias("p")).distinct()
    near = cross.join(projects, F.col("source_project") == F.col("p"), "left_semi").unionByName(cross.join(projects, F.col("target_project") == F.col("p"), "left_semi")).distinct()
    base = first.select(F.col("id").alias("v"), (F.col("depth") + 1).alias("depth"))
    over = near.join(base, F.col("target_node_id") == F.col("v")).select(F.col("source_node_id").alias("id"), "depth", F.col("type").alias("edge_type"), F.col("target_project").alias("source_project"))
    over = over.unionByName(near.join(base, F.col("source_node_id") == F.col("v")).select(F.col("target_node_id").alias("id"), "depth", F.col("type").alias("edge_type"), "source_project"))
    seeds = settle(over.where(F.col("depth") <= depth).join(first.select("id"), "id", "left_anti"), "over")
    later = waves(seeds, first.select("id").union(seeds.select("id")), "beyond")
    return settle(first.unionByName(later), "reached")


def risk(depth: Column, edge_type: Column, crossed: Column, path: Column, dotnet: Column) -> Column:
    score = F.when(depth == 1, 1).when(depth == 2, 2).otherwise(3) - crossed.cast("int") - edge_type.isin(ASYNC).cast("int")
    score = F.when((depth == 1) & edge_type.isin(CROSSING) & crossed, 0).otherwise(score)
    low = F.lower(F.coalesce(path, F.lit("")))
    test = (low != "") & (low.contains("test") | low.contains("spec") | F.lower(F.coalesce(dotnet, F.lit(""))).contains("test"))
    score = score + test.cast("int")
    return F.when(score <= 0, "Critical").when(score == 1, "High").when(score == 2, "Medium").otherwise("Low")


def affected(start: DataFrame, nodes: DataFrame, edges: DataFrame, cross: DataFrame, depth: int) -> DataFrame:
    """(id, project, depth, edge_type, risk) of every node but the changed ones."""
    r = reach(start, edges, cross, depth).where(F.col("depth") > 0)
    j = r.join(nodes.select("id", "project", "file_path", "dotnet_project"), "id")
    return j.select("id", "project", "depth", "edge_type", risk(F.col("depth"), F.col("edge_type"), F.col("project") != F.col("source_project"), F.col("file_path"), F.col("dotnet_project")).alias("risk"))


def overlapping(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes whose lines meet a changed span (file_path, from_line, to_line); unknown lines count as meeting."""
    s = spans.withColumnRenamed("file_path", "f")
    hit = (F.lower("file_path") == F.lower("f")) & F.coalesce((F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line")), F.lit(True))
    return nodes.join(s, hit, "left_semi")


def of_file(nodes: DataFrame, project: str, path: str) -> DataFrame:
    """(id, project): what a changed file holds, but files, folders and namespaces; these only where there is nothing else."""
    here = nodes.where((F.col("project") == project) & (F.col("file_path") == path)).select("id", "project", F.col("label").isin("File", "Folder", "Namespace").alias("frame"))
    only = here.groupBy("project").agg(F.min("frame").alias("only"))
    return here.join(only, "project").where(~F.col("frame") | F.col("only")).select("id", "project")
