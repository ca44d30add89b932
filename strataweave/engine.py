"""One object over the tables of a deployment, with the questions that callers ask by name.

    engine = Engine({"nodes": nodes, "edges": edges, "cross": cross, "repositories": repos})
    engine.ask("trace_call_path", name="ReadLedger", direction="inbound", depth=3)

Tables (DataFrames) are looked up when a question needs them.  Every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import community, history, impact, memory, memory_graph, resolution, retrieval, store, traverse
from strataweave.sources import catalog, files


class Engine:
    def __init__(self, tables: dict[str, DataFrame], username: str | None = None):
        self.tables, self.username = tables, username

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"this question needs the table {name}")
        df = self.tables[name]
        return memory.scoped(df, self.username) if self.username and "username" in df.columns else df

    def questions(self) -> list[str]:
        return sorted(m[4:] for m in dir(self) if m.startswith("ask_"))

    def ask(self, question: str, **arguments) -> DataFrame:
        handler = getattr(self, f"ask_{question}", None)
        if handler is None:
            raise ValueError(f"unknown question {question}; known are {', '.join(self.questions())}")
        return handler(**arguments)

    # -- graph
    def ask_get_graph_schema(self) -> DataFrame:
        labels = self.table("nodes").groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
        return labels.unionByName(self.table("edges").groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))

    def ask_list_projects(self, group: str | None = None) -> DataFrame:
        r = self.table("repositories")
        return (r.where(F.lower("source_group") == group.lower()) if group else r).orderBy("name")

    def ask_search_projects(self, pattern: str, group: str | None = None) -> DataFrame:
        return store.search_repositories(self.table("repositories"), pattern, group)

    def ask_search_graph(self, pattern: str, limit: int = 20, **filters: str) -> DataFrame:
        return store.page(store.search_nodes(self.table("nodes"), pattern, **filters), ["name", "id"], 1, limit)

    def ask_search(self, text: str, limit: int = 20) -> DataFrame:
        return store.unified_search(self.table("repositories"), self.table("nodes"), text, limit)

    def ask_node_detail(self, node_id: int) -> DataFrame:
        return store.node_detail(self.table("nodes"), self.table("edges"), node_id)

    def _start(self, name: str, prefer: list[str], project: str | None) -> DataFrame:
        return traverse.first_of(self.table("nodes"), name, prefer, project)

    def ask_trace_call_path(self, name: str, direction: str = "outbound", depth: int = 3, project: str | None = None, confidence: float | None = None) -> DataFrame:
        return traverse.walk(self._start(name, ["Method", "Function"], project), self.table("edges"), direction, depth, ["CALLS", "HTTP_CALLS"], confidence)

    def ask_trace_data_lineage(self, name: str, depth: int = 4, project: str | None = None) -> DataFrame:
        start, types = self._start(name, ["Class", "Record", "Interface"], project), ["USES_TYPE", "PUBLISHES", "CONSUMES", "HTTP_CALLS"]
        down = traverse.walk(start, self.table("edges"), "outbound", depth, types).withColumn("way", F.lit("downstream"))
        return down.unionByName(traverse.walk(start, self.table("edges"), "inbound", depth, types).withColumn("way", F.lit("upstream")))

    def ask_find_consumers(self, name: str) -> DataFrame:
        n = self.table("nodes")
        return traverse.one_hop(n, self.table("edges"), n.where(F.lower("name") == name.lower()), ["CONSUMES", "CALLS", "HTTP_CALLS", "USES_TYPE", "HANDLES"])

    def ask_find_publishers(self, name: str) -> DataFrame:
        n = self.table("nodes")
        return traverse.one_hop(n, self.table("edges"), n.where(F.lower("name") == name.lower()), ["PUBLISHES", "CALLS"])

    def ask_get_architecture(self, project: str) -> DataFrame:
        n = self.table("nodes").where(F.lower("project") == project.lower())
        hot = store.fan_in(self.table("edges"), 3).join(n.where("label in ('Method', 'Function')").select(F.col("id").alias("target_id"), "name"), "target_id")
        return hot.orderBy(F.desc("callers"), "target_id").limit(10)

    def ask_get_service_summary(self, project: str) -> DataFrame:
        return store.counts(self.table("nodes").where(F.lower("project") == project.lower()), "project", "label")

    def ask_find_archival_candidates(self) -> DataFrame:
        return store.without_cross_edges(self.table("repositories"), self.table("cross"))

    def ask_analyze_impact(self, name: str, project: str | None = None, depth: int = 3) -> DataFrame:
        n = self.table("nodes")
        start = n.where(F.lower("name") == name.lower())
        start = start.where(F.col("project") == project) if project else start
        return impact.affected(start.select("id", "project"), n, self.table("edges"), self.table("cross"), depth)

    # -- clusters and health
    def ask_get_service_clusters(self) -> DataFrame:
        return community.cluster_summary(self.table("cross"), community.louvain(community.adjacency(self.table("cross"))))

    def ask_get_cluster_detail(self, cluster: int) -> DataFrame:
        labels = community.louvain(community.adjacency(self.table("cross")))
        return resolution.cluster_members(self.table("cross"), labels).where(F.col("community") == cluster)

    def ask_get_project_health(self, as_of) -> DataFrame:
        return history.file_metrics(self.table("commits"), self.table("touches"), as_of).orderBy(F.desc("concern"), F.desc("risk"), "path")

    def ask_get_fleet_health(self) -> DataFrame:
        return resolution.fleet(self.table("health"))

    # -- sources and catalogue
    def ask_get_code_snippet(self, path: str, first: int, last: int) -> DataFrame:
        return files.window(self.table("files"), path, first, last)

    def ask_read_node_source(self, path: str, first: int, last: int) -> DataFrame:
        return files.window(self.table("files"), path, first, last, around=5)

    def ask_list_schemas(self) -> DataFrame:
        return catalog.user_schemas(self.table("schemas"))

    def ask_get_schema_catalog(self) -> DataFrame:
        return catalog.listing(self.table("catalog_nodes"), self.table("catalog_edges"))

    # -- conventions
    def ask_list_conventions(self) -> DataFrame:
        return self.table("pages").select("id", "slug", "title").orderBy("slug")

    def ask_get_convention(self, slug: str) -> DataFrame:
        return self.table("pages").where(F.col("slug") == slug)

    def ask_search_conventions(self, query: str, k: int = 5, vector: list[float] | None = None) -> DataFrame:
        chunks = self.table("chunks")
        lexical = retrieval.bm25(chunks, query)
        dense = retrieval.similar(chunks.select("key", "embedding"), vector, 4 * k, 0.0) if vector else lexical.select("key", F.lit(0.0).alias("score")).limit(0)
        return retrieval.hybrid(dense, lexical, chunks.select("key", "title"), k)

    # -- memory
    def ask_search_memory(self, query: str, limit: int = 5, vector: list[float] | None = None) -> DataFrame:
        return memory.search_claims(self.table("claims"), query, limit, vector)

    def ask_query_memory(self, query: str, limit: int = 8) -> DataFrame:
        return memory.entity_seeds(self.table("entities"), query, limit)

    def ask_get_memory_subgraph(self, ids: DataFrame, entities: int = 40, claims: int = 80) -> DataFrame:
        return memory_graph.subgraph(ids, self.table("claims"), entities, claims)[0]

    def ask_get_entity_bundle(self, entity: int) -> DataFrame:
        return memory_graph.bundle(self.table("claims"), entity)

    def ask_get_claim_bundle(self, claim: int) -> DataFrame:
        own = self.table("claims").where(F.col("claim_id") == claim).select("fact_group")
        return memory.rebuild_groups(self.table("claims").join(own, "fact_group", "left_semi"))

    def ask_expand_memory_frontier(self, ids: DataFrame, depth: int = 2) -> DataFrame:
        return traverse.walk(ids, self.table("memory_edges"), "both", depth, visited=True)

    def ask_memory_diagnostics(self, cutoff) -> DataFrame:
        return memory.receipt_diagnostics(self.table("receipts"), F.lit(cutoff).cast("timestamp"))
