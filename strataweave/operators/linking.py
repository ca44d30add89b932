"""Links across repositories and the resolution of names to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Suffixes of packages that a project publishes, edge types that make stubs, and their labels.
PACKAGE_SUFFIX = r"(?i)\.(Models|Contracts|Client|Shared)$"
ALWAYS_STUB = ["PUBLISHES", "CONSUMES", "HTTP_CALLS", "ROUTED_TO", "BOUND_TO", "REGISTERS"]
MAYBE_STUB = ["CALLS", "INJECTS", "INHERITS", "IMPLEMENTS", "CARRIES_FIELD"]
STUB_LABELS = {"HTTP_CALLS": "Route", "PUBLISHES": "Event", "CONSUMES": "Event", "ROUTED_TO": "Queue", "BOUND_TO": "Exchange", "REGISTERS": "Class", "INJECTS": "Interface", "INHERITS": "Class", "IMPLEMENTS": "Interface", "CALLS": "Method", "CARRIES_FIELD": "Class"}
WHOLE_NAME = ["HTTP_CALLS", "ROUTED_TO", "BOUND_TO"]
EXTERNAL = ("System.", "Microsoft.", "Newtonsoft.", "MassTransit.", "Autofac.", "Serilog.", "Npgsql.", "RabbitMQ.", "Neo4j.", "Anthropic.")


def route_key(method: Column, template: Column) -> Column:
    """METHOD:path with every {parameter} as {*}."""
    return F.concat(F.upper(method), F.lit(":"), F.regexp_replace(F.ltrim(F.lower(template), F.lit("/")), r"\{[^}]+\}", "{*}"))


def url_key(method: Column, url: Column) -> Column:
    """METHOD:path with segments that look like ids as {*}."""
    like_id = lambda s: s.rlike(r"^\s*[+-]?\d{1,18}\s*$|^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$|^\{.*\}$")
    segments = F.transform(F.split(F.ltrim(F.lower(url), F.lit("/")), "/"), lambda s: F.when(like_id(s), "{*}").otherwise(s))
    return F.concat(F.upper(method), F.lit(":"), F.array_join(segments, "/"))


def link_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls: (call_id, project, method, url[, hint]); routes: (route_id, route_project, method, template).

    Exact key first, then the URL read as a template; a call that matches routes of several other projects and none of the
    hinted one is ambiguous and dropped."""
    r = routes.select(F.col("route_id"), F.col("route_project"), route_key(F.col("method"), F.col("template")).alias("k"))
    c = calls.withColumns({"k1": url_key(F.col("method"), F.col("url")), "k2": route_key(F.col("method"), F.col("url"))})
    exact = c.join(r, c["k1"] == r["k"]).withColumn("o", F.lit(0))
    second = c.join(r, c["k2"] == r["k"]).withColumn("o", F.lit(1))
    both = exact.unionByName(second)
    best = both.withColumn("m", F.min("o").over(W.partitionBy("call_id"))).where("o = m and route_project <> project")
    n = F.size(F.collect_set("route_project").over(W.partitionBy("call_id")))
    hinted = F.coalesce(F.lower("route_project") == F.lower("hint"), F.lit(False))
    return best.withColumn("n", n).where((F.col("n") == 1) | hinted).select("call_id", "project", "route_id", "route_project").distinct()


def link_messages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_project, target_project, source_id, target_id, event): publishers to consumers of the same event name elsewhere."""
    ends = nodes.select("id", "project", "qualified_name")
    side = lambda t, p: edges.where(F.col("type") == t).join(ends.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("event")), "target_id").join(ends.select(F.col("id").alias("source_id"), F.col("project").alias(f"{p}_project")), "source_id").select(F.col("source_id").alias(f"{p}_id"), f"{p}_project", "event")
    return side("PUBLISHES", "source").join(side("CONSUMES", "target"), "event").where("source_project <> target_project").distinct()


def link_packages(refs: DataFrame, repos: DataFrame) -> DataFrame:
    """refs: (source_id, project, package); the repository that the package's stripped name names, if it is another."""
    r = refs.withColumn("k", F.lower(F.regexp_replace("package", PACKAGE_SUFFIX, "")))
    named = repos.select(F.lower("name").alias("k"), F.col("name").alias("target_project"))
    return r.join(named, "k").where(F.lower("target_project") != F.lower("project")).select("source_id", "project", "target_project", "package")


def link_versions(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """refs: (ref_id, project, package, version); packages: (package_id, owner, package, version): one owner, exact version before a sole candidate."""
    p = packages.withColumnRenamed("version", "have").withColumn("owners", F.size(F.collect_set("owner").over(W.partitionBy("package")))).where("owners = 1")
    j = refs.join(p, "package").where("owner <> project")
    j = j.withColumns({"exact": F.coalesce(F.col("version") == F.col("have"), F.lit(False)), "n": F.count("*").over(W.partitionBy("ref_id"))})
    j = j.withColumn("exacts", F.count_if("exact").over(W.partitionBy("ref_id")))
    return j.where((F.col("exact") & (F.col("exacts") == 1)) | ((F.col("exacts") == 0) & (F.col("n") == 1))).select("ref_id", "project", "owner", "package_id")


def link_symbols(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """uses: (use_id, project, symbol); definitions: (def_id, owner, symbol): the only definition in the only other project."""
    d = definitions.withColumn("n", F.count("*").over(W.partitionBy("symbol"))).where("n = 1")
    return uses.join(d, "symbol").where("owner <> project").select("use_id", "project", "def_id", "owner")


def resolve_edges(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """pending: (project, source_qn, target_qn, type); nodes: (id, project, qualified_name) -> edges with ids, once each."""
    n = nodes.select("project", "qualified_name", "id")
    s = n.select("project", F.col("qualified_name").alias("source_qn"), F.col("id").alias("source_id"))
    t = n.select("project", F.col("qualified_name").alias("target_qn"), F.col("id").alias("target_id"))
    return pending.join(s, ["project", "source_qn"]).join(t, ["project", "target_qn"]).select("project", "source_id", "target_id", "type").distinct()


def dropped_edges(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, dropped): pending edges of which an end is no node."""
    n = nodes.select("project", "qualified_name").distinct()
    s, t = n.withColumnsRenamed({"qualified_name": "source_qn"}).withColumn("s", F.lit(1)), n.withColumnsRenamed({"qualified_name": "target_qn"}).withColumn("t", F.lit(1))
    return pending.join(s, ["project", "source_qn"], "left").join(t, ["project", "target_qn"], "left").where("s is null or t is null").groupBy("type").agg(F.count("*").alias("dropped"))


def stub_nodes(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, qualified_name, label, name) of missing targets that deserve a node: the first type by name decides."""
    known = nodes.select("project", F.col("qualified_name").alias("target_qn")).distinct()
    qn = F.col("target_qn")
    external = qn.contains(".") & ~F.lower(qn).rlike("^(" + "|".join(p.lower().replace(".", r"\.") for p in EXTERNAL) + ")")
    want = F.col("type").isin(ALWAYS_STUB) | (F.col("type").isin(MAYBE_STUB) & external)
    missing = pending.where(want & qn.isNotNull()).join(known, ["project", "target_qn"], "left_anti")
    first = missing.groupBy("project", F.col("target_qn").alias("qualified_name")).agg(F.min("type").alias("type"))
    label = F.create_map(*[F.lit(x) for kv in STUB_LABELS.items() for x in kv])[F.col("type")]
    return first.select("project", "qualified_name", label.alias("label"), F.when(F.col("type").isin(WHOLE_NAME), F.col("qualified_name")).otherwise(F.substring_index("qualified_name", ".", -1)).alias("name"))


def prefixes(path: Column) -> Column:
    """All folder prefixes of a path, the empty one included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def longest_owner(files: DataFrame, owners: DataFrame) -> DataFrame:
    """files: (path); owners: (folder, owner). The owner of the longest folder that holds the file: an equi-join on prefixes."""
    each = files.select("path", F.explode(prefixes(F.col("path"))).alias("folder"))
    return each.join(owners, "folder").groupBy("path").agg(F.max_by("owner", F.length("folder")).alias("owner"))


def line_owner(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """lines: (file_path, line). The node with the smallest span around each line; on ties `other` before class before method, then id."""
    order = F.when(F.lower("label").isin("method", "function"), 2).when(F.lower("label").isin("class", "interface", "record"), 1).otherwise(0)
    spans = nodes.where("start_line is not null and end_line is not null").select("file_path", "id", "label", "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("span"), order.alias("o"))
    hit = lines.join(spans, "file_path").where("line between start_line and end_line")
    return hit.groupBy("file_path", "line").agg(F.min(F.struct("span", "o", "id")).alias("m")).select("file_path", "line", F.col("m.id").alias("node_id"), F.col("m.span").alias("span"))


def structure(files: DataFrame) -> DataFrame:
    """(project, parent, child, type) of the tree of folders and files."""
    f = files.select("project", "path", F.explode(F.filter(prefixes(F.col("path")), lambda p: p != "")).alias("folder")).select("project", "folder").distinct()
    up = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    folders = f.select("project", up(F.col("folder")).alias("parent"), F.col("folder").alias("child"), F.lit("CONTAINS_FOLDER").alias("type"))
    return folders.unionByName(files.select("project", up(F.col("path")).alias("parent"), F.col("path").alias("child"), F.lit("CONTAINS_FILE").alias("type")).distinct())
