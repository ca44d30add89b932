"""Resolution of calls, imports and types to nodes and projects, as group joins that drop what is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.operators.linking import PACKAGE_SUFFIX


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """imports: (project, file_qn, namespace) -> (project, source_qn, target_qn, type) where the namespace names a node."""
    known = nodes.select("project", F.col("qualified_name").alias("namespace")).distinct()
    return imports.join(known, ["project", "namespace"]).select("project", F.col("file_qn").alias("source_qn"), F.col("namespace").alias("target_qn"), F.lit("IMPORTS").alias("type")).distinct()


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls: (project, caller_qn, callee, kind, receiver); a call whose name has one candidate becomes an edge.

    kind `none` takes any node of that name in the project; `resolved` only those whose qualified name is the receiver's with
    one more part, so the owner is a join key and not a prefix test; other kinds give nothing."""
    named = nodes.select("project", F.col("name").alias("callee"), F.col("qualified_name").alias("target_qn")).distinct()
    named = named.withColumn("owner", F.expr("substring(target_qn, 1, greatest(length(target_qn) - length(substring_index(target_qn, '.', -1)) - 1, 0))"))
    plain = calls.where("kind = 'none'").join(named, ["project", "callee"])
    owned = calls.where("kind = 'resolved' and receiver is not null").join(named, (calls["project"] == named["project"]) & (calls["callee"] == named["callee"]) & (calls["receiver"] == named["owner"])).select(calls["project"], calls["callee"], "caller_qn", "kind", "receiver", "target_qn", "owner")
    both = plain.select("project", "caller_qn", "callee", "kind", "receiver", "target_qn").unionByName(owned.select("project", "caller_qn", "callee", "kind", "receiver", "target_qn")).distinct()
    n = F.count("*").over(W.partitionBy("project", "caller_qn", "callee", "kind", "receiver"))
    return both.withColumn("n", n).where("n = 1").select("project", F.col("caller_qn").alias("source_qn"), "target_qn", F.lit("CALLS").alias("type")).distinct()


def dto_projects(types: DataFrame, projects: DataFrame) -> DataFrame:
    """types: (type_qn). (type_qn, project) by the longest namespace of two or more parts that names a project, itself or without a package suffix."""
    parts = F.split("type_qn", r"\.")
    each = types.select("type_qn", F.explode(F.when(F.size(parts) >= 3, F.sequence(F.lit(2), F.size(parts) - 1))).alias("n")).withColumn("candidate", F.array_join(F.slice(F.split("type_qn", r"\."), F.lit(1), F.col("n")), "."))
    names = projects.select(F.lower("name").alias("k"), F.col("name").alias("project"))
    exact = each.select("type_qn", (F.col("n") * 2 + 1).alias("rank"), F.lower("candidate").alias("k"))
    short = each.where(F.col("candidate").rlike(PACKAGE_SUFFIX)).select("type_qn", (F.col("n") * 2).alias("rank"), F.lower(F.regexp_replace("candidate", PACKAGE_SUFFIX, "")).alias("k"))
    return exact.unionByName(short).join(names, "k").groupBy("type_qn").agg(F.max_by("project", "rank").alias("project"))


def vulnerable_packages(refs: DataFrame, advisories: DataFrame) -> DataFrame:
    """refs: (project, package, version); advisories: (package, first_bad, first_good, severity). Versions compare part by part as numbers."""
    key = lambda c: F.transform(F.slice(F.concat(F.split(c, r"[.\-+]"), F.array(*map(F.lit, "0000"))), 1, 4), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    a = advisories.select(F.lower("package").alias("k"), "first_bad", "first_good", "severity")
    j = refs.withColumn("k", F.lower("package")).join(a, "k")
    bad = (key(F.col("version")) >= key(F.coalesce("first_bad", F.lit("0")))) & (F.col("first_good").isNull() | (key(F.col("version")) < key(F.col("first_good"))))
    return j.where(bad).select("project", "package", "version", "severity").distinct()


def diagnostic_key(project: Column, diagnostic: Column, path: Column, first: Column, last: Column, message: Column) -> Column:
    """The diagnostic's id (or `diagnostic`), and a hash of all parts."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (project, diagnostic, path, first, last, message)])
    name = F.trim(F.coalesce(diagnostic, F.lit("")))
    return F.concat(F.substring(F.when(name == "", "diagnostic").otherwise(name), 1, 64), F.lit("|"), F.sha2(text, 256))


def slice_closure(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of the files and of the folders above them, edges that touch those of the files)."""
    p = paths.select("file_path").distinct()
    inside = nodes.join(p, "file_path", "left_semi")
    parts = F.split("file_path", "/")
    up = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("file_path")).distinct()
    folders = nodes.where("label in ('Folder', 'Project')").join(up, "file_path", "left_semi")
    ids = inside.select("id")
    touching = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")).distinct()
    return inside.unionByName(folders).distinct(), touching


def cluster_members(cross: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, project, internal, external): edges of every member inside its cluster and across."""
    a = labels.select(F.col("project").alias("s"), F.col("community").alias("cs"))
    b = labels.select(F.col("project").alias("t"), F.col("community").alias("ct"))
    e = cross.select(F.lower("source_project").alias("s"), F.lower("target_project").alias("t")).join(a, "s", "left").join(b, "t", "left").withColumn("inside", F.coalesce(F.col("cs") == F.col("ct"), F.lit(False)))
    ends = e.where("cs is not null").select(F.col("s").alias("project"), "inside").unionByName(e.where("ct is not null").select(F.col("t").alias("project"), "inside"))
    sums = ends.groupBy("project").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    return labels.join(sums, "project", "left").fillna(0, ["internal", "external"]).select("community", "project", "internal", "external")


def cluster_connections(cross: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, other, edges, types) between clusters, from either side."""
    a = labels.select(F.col("project").alias("s"), F.col("community").alias("cs"))
    b = labels.select(F.col("project").alias("t"), F.col("community").alias("ct"))
    e = cross.select(F.lower("source_project").alias("s"), F.lower("target_project").alias("t"), "type").join(a, "s").join(b, "t").where("cs <> ct")
    both = e.select(F.col("cs").alias("community"), F.col("ct").alias("other"), "type").unionByName(e.select("ct", "cs", "type").toDF("community", "other", "type"))
    return both.groupBy("community", "other").agg(F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def fleet(summaries: DataFrame) -> DataFrame:
    """One row over the repositories' health summaries."""
    return summaries.agg(F.count("*").alias("repositories"), F.bround(F.avg("health"), 1).alias("average"), F.sum("hotspots").alias("hotspots"), F.sum("alerts").alias("alerts"), F.count_if(F.col("health") < 4.0).alias("below_4"), F.count_if(F.col("health") < 2.5).alias("below_2_5"))


def impact_rollup(affected: DataFrame, start: DataFrame, cross: DataFrame) -> DataFrame:
    """(source_project, target_project, edge_type, nodes): direct edges of the changed nodes by type, and reached nodes of other projects, merged by pair.

    Of a pair the first type by name stays and the counts are added; the pair of a reached project starts at the least start project."""
    ids = start.select("id").distinct()
    near = cross.join(ids.select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi").unionByName(cross.join(ids.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")).distinct()
    direct = near.groupBy("source_project", "target_project", F.col("type").alias("edge_type")).agg(F.count("*").alias("nodes"))
    first = start.agg(F.min("project")).first()[0]  # one name
    far = affected.join(start.select("project").distinct(), "project", "left_anti").groupBy(F.lit(first).alias("source_project"), F.col("project").alias("target_project"), F.lit("TRANSITIVE").alias("edge_type")).agg(F.count("*").alias("nodes"))
    return direct.unionByName(far).groupBy("source_project", "target_project").agg(F.min("edge_type").alias("edge_type"), F.sum("nodes").alias("nodes"))


def legacy_claims(relations: DataFrame, stored: DataFrame) -> DataFrame:
    """relations: (from_id, type, to_id, context, at) -> claims with stable ids, without those stored already."""
    text = F.concat_ws("|", "from_id", "type", "to_id", F.coalesce("context", F.lit("")))
    c = relations.withColumn("claim_id", F.concat(F.lit("legacy_claim_"), F.substring(F.sha2(text, 256), 1, 24)))
    return c.join(stored.select("claim_id"), "claim_id", "left_anti").groupBy("claim_id").agg(F.min(F.struct("at", "from_id", "type", "to_id", "context")).alias("m")).select("claim_id", F.col("m.from_id").alias("subject_id"), F.lower("m.type").alias("predicate"), F.col("m.to_id").alias("object_id"), "m.context", F.col("m.at").alias("recorded_at"))
