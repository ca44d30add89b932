"""Reads, filters and counts over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge types that only say what contains what.
STRUCTURAL = ["DEFINES", "DEFINES_METHOD", "CONTAINS_FILE", "CONTAINS_FOLDER", "CONTAINS_NAMESPACE", "CONTAINS_PROJECT"]
# Order of severities.
SEVERITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def by_label(nodes: DataFrame, label: str, limit: int) -> DataFrame:
    return nodes.where(F.col("label") == label).orderBy("id").limit(limit)


def search_nodes(nodes: DataFrame, pattern: str, project: str | None = None, label: str | None = None, file: str | None = None) -> DataFrame:
    """Names containing the pattern whatever its case; % and _ in it stay wildcards, * does not become one."""
    conditions: list[Column] = [F.lower("name").like(f"%{pattern.lower()}%")]
    conditions += [F.col("project") == project] if project else []
    conditions += [F.col("label") == label] if label else []
    conditions += [F.lower("file_path").like(f"%{file.lower()}%")] if file else []
    return nodes.where(reduce(Column.__and__, conditions))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page from 1 of at least 1 and at most 100 rows."""
    size, number = min(max(size, 1), 100), max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_repositories(repos: DataFrame, pattern: str, group: str | None = None) -> DataFrame:
    """* is a wildcard; a pattern without any matches anywhere in the name."""
    like = pattern.lower().replace("*", "%")
    like = like if "%" in like else f"%{like}%"
    found = repos.where(F.lower("name").like(like))
    return found.where(F.col("source_group") == group) if group else found


def edges_of(edges: DataFrame, ids: DataFrame, side: str, types: list[str] | None = None) -> DataFrame:
    """Edges whose source or target is among the ids (column id)."""
    some = edges.where(F.col("type").isin(types)) if types else edges
    return some.join(ids.select(F.col("id").alias(side)).distinct(), side, "left_semi")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once: a union of two semi joins, never a join with OR."""
    return edges_of(edges, ids, "source_id").unionByName(edges_of(edges, ids, "target_id")).distinct()


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def fan_in(edges: DataFrame, least: int, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).groupBy("target_id").agg(F.count("*").alias("callers")).where(F.col("callers") >= least)


def endpoints(cross: DataFrame) -> DataFrame:
    return cross.select(F.lower("source_project").alias("p")).union(cross.select(F.lower("target_project"))).distinct()


def without_cross_edges(repos: DataFrame, cross: DataFrame) -> DataFrame:
    return repos.join(endpoints(cross), F.lower("name") == F.col("p"), "left_anti")


def with_any_edge(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return nodes.where(F.col("label").isin(labels)).join(ends, "id", "left_semi")


def children(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("DEFINES", "DEFINES_METHOD")) -> DataFrame:
    kids = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("child_name"))
    return edges.where(F.col("type").isin(*types)).join(kids, "target_id").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("child_id"), "child_name")


def overview_edges(cross: DataFrame) -> DataFrame:
    """(source, target, type, of_type, total): the type counts of every pair of projects in long form."""
    typed = cross.groupBy("source_project", "target_project", "type").agg(F.count("*").alias("of_type"))
    total = typed.groupBy("source_project", "target_project").agg(F.sum("of_type").alias("total"))
    return typed.join(total, ["source_project", "target_project"])


def dependencies(cross: DataFrame) -> DataFrame:
    """Outbound and inbound edge counts and distinct projects on the other side, by project."""
    out = cross.groupBy(F.col("source_project").alias("project")).agg(F.count("*").alias("outbound"), F.countDistinct("target_project").alias("depends_on"), F.array_join(F.array_sort(F.collect_set("target_project")), ",").alias("targets"))
    inn = cross.groupBy(F.col("target_project").alias("project")).agg(F.count("*").alias("inbound"), F.countDistinct("source_project").alias("used_by"))
    return out.join(inn, "project", "full").fillna(0, ["outbound", "depends_on", "inbound", "used_by"])


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """(direction, type, other_id, other_name, other_project, is_cross) of every edge of one node."""
    out = edges.where(F.col("source_id") == node_id).select(F.lit("out").alias("direction"), "type", F.col("target_id").alias("other_id"))
    inn = edges.where(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), "type", F.col("source_id").alias("other_id"))
    own = nodes.select(F.col("id").alias("own_id"), F.col("project").alias("own_project"))
    other = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("project").alias("other_project"))
    hit = out.unionByName(inn).join(other, "other_id").withColumn("own_id", F.lit(node_id).cast("long"))
    return hit.join(own, "own_id").select("direction", "type", "other_id", "other_name", "other_project", (F.col("other_project") != F.col("own_project")).alias("is_cross"))


def unified_search(repos: DataFrame, nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """Exact names first, repositories before nodes, then by name; with rank."""
    r = search_repositories(repos, text).select(F.lit("repository").alias("kind"), "name", F.lit(0).cast("long").alias("id"))
    n = search_nodes(nodes, text).select(F.lit("node").alias("kind"), "name", "id")
    order = [(F.lower("name") != text.lower()).cast("int"), (F.col("kind") != "repository").cast("int"), F.col("name"), F.col("id")]
    return r.unionByName(n).orderBy(*order).limit(limit)


def trust_ranked(nodes: DataFrame, trust: DataFrame, text: str, limit: int) -> DataFrame:
    """Exact first, then trusted first (file trust, 0.5 where unknown), then by name."""
    scored = search_nodes(nodes, text).join(trust, ["project", "file_path"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    first = scored.orderBy("name", "id").limit(min(2 * limit, 100))
    return first.orderBy((F.lower("name") != text.lower()).cast("int"), F.desc("trust"), "name", "id").limit(limit)


def severity_rank(c: Column) -> Column:
    out = F.lit(4)
    for name, k in SEVERITIES.items():
        out = F.when(F.lower(c) == name, F.lit(k)).otherwise(out)
    return out


def excluded(repos: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, rule): the rule for the repository itself first, else for any segment of its group's path."""
    keys = repos.select("name", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.lower("name").alias("k"))), F.transform(F.split(F.lower("source_group"), "/"), lambda s: F.struct(F.lit(1).alias("o"), s.alias("k"))))).alias("x"))
    r = rules.select(F.lower("value").alias("k"), F.when(F.col("kind") == "repository", 0).otherwise(1).alias("o"), F.col("rule"))
    return keys.select("name", "x.o", "x.k").join(r, ["o", "k"]).groupBy("name").agg(F.min(F.struct("o", "rule")).alias("m")).select("name", "m.rule")


# Labels worth finding in a search.
SEARCHABLE = ["Class", "Interface", "Enum", "Struct", "Record", "Method", "Route", "Service", "Event", "Queue", "Exchange", "Job", "Table", "View", "StoredProcedure", "Component", "DotnetProject"]


def searchable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin(SEARCHABLE))


def page_total(found: int, number: int, size: int) -> int:
    """How many there are in all, known only where the page is not full: -1 else."""
    return (number - 1) * size + found if found < size else -1


def set_trust(nodes: DataFrame, node_id: int, flag: bool) -> DataFrame:
    return nodes.withColumn("do_not_trust", F.when(F.col("id") == node_id, F.lit(flag)).otherwise(F.col("do_not_trust")))


def search_pages(pages: DataFrame, text: str) -> DataFrame:
    """Wiki pages whose slug or title contains the text, whatever the case."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return pages.where(has("slug") | has("title"))


def secret_paths(findings: DataFrame) -> DataFrame:
    return findings.where("category = 'secret' and path is not null").select("path").distinct()


def unresolved(observations: DataFrame, ids: list[str]) -> DataFrame:
    """observations: (resolved, about, text): open ones that are about one of a stated few ids, or whose text holds one, whatever the case."""
    low = [i.lower() for i in ids if i.strip()]
    if not low:
        return observations.limit(0)
    about = F.arrays_overlap(F.transform("about", lambda x: F.lower(x)), F.array(*map(F.lit, low)))
    inside = reduce(Column.__or__, [F.contains(F.lower("text"), F.lit(i)) for i in low])
    return observations.where(~F.col("resolved") & F.coalesce(about | inside, inside, F.lit(False)))


def max_sort_order(sections: DataFrame, *keys: str) -> DataFrame:
    """The greatest sort_order, -1 where there is none."""
    return sections.groupBy(*keys).agg(F.coalesce(F.max("sort_order"), F.lit(-1)).alias("sort_order"))
