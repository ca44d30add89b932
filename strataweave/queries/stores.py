"""Queries over schemas, the vector store, manifests, resolved entities and impact of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import impact as I
from strataweave.operators import manifests as PM
from strataweave.operators import memory as M
from strataweave.operators import schemas as SC
from strataweave.operators import store as S
from strataweave.operators import vectors as VS
from strataweave.plans.bind import cte
from strataweave.plans.bind import view as V
from strataweave.plans.cut import cut
from strataweave.sources.tables import table


def _schemas(s: SparkSession, d: str) -> DataFrame:
    r = V(s, d, "g_repos")
    server = F.when(F.col("age_days") % 5 == 0, "  ").otherwise(F.col("source_group"))
    repos = r.select(F.concat(F.lit("db:"), "name").alias("name"), F.to_json(F.struct(server.alias("serverName"), F.lower("name").alias("databaseName"))).alias("properties"))
    label = F.when(F.col("label") == "Method", "Table").when(F.col("label") == "Route", "View").when(F.col("label") == "Event", "StoredProcedure").otherwise(F.col("label"))
    return SC.with_counts(SC.schema_repositories(repos, search="a"), V(s, d, "g_nodes").select(F.concat(F.lit("db:"), "project").alias("project"), label.alias("label")))


def schema_list(s: SparkSession, d: str) -> DataFrame:
    return SC.ordered(_schemas(s, d))


def schema_totals(s: SparkSession, d: str) -> DataFrame:
    return SC.totals(_schemas(s, d))


def _store(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    key = F.col("vec_id").cast("string")
    rows = e.select(F.concat(F.lit("label_"), "label").alias("entity_type"), key.alias("entity_key"), "embedding", F.lit("m1").alias("model"), F.size("embedding").alias("dimensions"))
    again = e.where("vec_id % 10 = 0").select(F.concat(F.lit("label_"), "label").alias("entity_type"), key.alias("entity_key"), F.reverse("embedding").alias("embedding"), F.lit("m2").alias("model"), F.lit(64).alias("dimensions"))
    return VS.delete(VS.upsert(rows, again), "label_1", prefix="1")


def vector_store(s: SparkSession, d: str) -> DataFrame:
    return _store(s, d).groupBy("entity_type", "model").agg(F.count("*").alias("n"), F.sum(F.col("entity_key").cast("long")).alias("keys"))


def semantic_nodes(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of one type and model, as nodes of customers."""
    query = table(s, d, "embeddings").where("vec_id = 3").first()["embedding"]  # one query vector
    hits = VS.search(_store(s, d), query, 40, -1.0, model="m1", dimensions=64)
    nodes = V(s, d, "g_nodes").where("label = 'Class'").select((F.col("id") - 10000000).alias("id"), "project", "name")
    return VS.hydrate(hits, nodes).select("id", "name", F.round("score", 6).alias("score"))


def node_texts(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    return n.select("id", F.md5(VS.node_text(F.col("label"), F.col("name"), F.col("qualified_name"), F.col("dotnet_project"), F.col("project"))).alias("digest"))


def chunk_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "convention_chunks").select(VS.chunk_key(F.col("page_id"), F.col("revision"), F.col("chunk_index")).alias("chunk_key"), F.col("text").isNull().alias("empty")).distinct()


def searchable_labels(s: SparkSession, d: str) -> DataFrame:
    return S.counts(S.searchable(V(s, d, "g_nodes")), "label")


def trust_flag(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nodes").select("id", "do_not_trust").distinct()
    return S.set_trust(n, 5, True).groupBy("do_not_trust").agg(F.count("*").alias("n"))


def page_search(s: SparkSession, d: str) -> DataFrame:
    return S.search_pages(table(s, d, "convention_chunks").select("page_id", "slug", "title").distinct(), "Ro")


def section_order(s: SparkSession, d: str) -> DataFrame:
    return S.max_sort_order(table(s, d, "convention_chunks").select("page_id", F.when(F.col("page_id") % 3 != 0, F.col("chunk_index")).alias("sort_order")), "page_id")


def file_impact(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    start = cut(I.of_file(n, "NATION_3", "src/crm/BUILDING.cs"), "start")
    return I.affected(start, n, V(s, d, "g_edges"), V(s, d, "g_cross"), 2)


def entity_resolve(s: SparkSession, d: str) -> DataFrame:
    c, none = table(s, d, "customer"), F.lit(None).cast("string")
    old = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("cust_"), "c_custkey").alias("external_id"), F.col("c_name").alias("label"), F.lit("person").alias("type"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("c_custkey") % 6 == 0, "known").otherwise(" ").alias("summary"), F.lit("old").alias("source"))
    new = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("Cust "), "c_custkey").alias("external_id"), F.lower("c_name").alias("label"), F.lit("buyer").alias("type"), F.concat(F.lit(" "), "c_mktsegment").alias("canonical_name"), F.array(F.lit(" A "), F.lit("a"), F.lit(" "), F.lit("b")).alias("aliases"), F.lit("new").alias("summary"), none.alias("source"), F.col("c_custkey").alias("n"))
    return M.resolve_entities(old, new, "batch").withColumn("aliases", F.array_join("aliases", ","))


def entity_references(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return M.referred_entities(c.select(F.concat(F.lit("Seg "), "c_custkey", F.lit(" "), F.lower("c_mktsegment")).alias("reference")), c.where("c_custkey % 2 = 0").select(F.concat(F.lit("seg_"), "c_custkey", F.lit("_"), F.lower("c_mktsegment")).alias("external_id")), "batch")


def nuget_packages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    body = F.concat(F.lit('<Project><ItemGroup><PackageReference Include="Pkg.'), "p_size", F.lit('" Version="'), F.col("p_partkey") % 7, F.lit('.1" />\n<PackageReference Include="Lib.'), F.col("p_partkey") % 5, F.lit('">\n<Version>2.'), F.col("p_partkey") % 3, F.lit('</Version></PackageReference></ItemGroup></Project>'))
    return PM.nuget_references(p.select(F.col("p_brand").alias("project"), F.concat(F.lit("src/App"), F.col("p_partkey") % 9, F.lit(".csproj")).alias("path"), body.alias("content")))


def cargo_packages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    body = F.concat(F.lit('[package]\nname = "c'), F.col("p_partkey") % 9, F.lit('"\n\n[dependencies]\nserde = "1.'), F.col("p_partkey") % 4, F.lit('"\nlib'), "p_size", F.lit(' = { path = "../x", version = "0.'), F.col("p_partkey") % 3, F.lit('" }\nlocal = { path = "../y" }\n\n[dev-dependencies]\ntest = "2"\n[features]\nx = "y"\n'))
    return PM.cargo_references(p.select(F.col("p_brand").alias("project"), F.when(F.col("p_partkey") % 4 == 0, "target/Cargo.toml").otherwise("crates/a/Cargo.toml").alias("path"), body.alias("content")))


QUERIES = [schema_list, schema_totals, vector_store, semantic_nodes, node_texts, chunk_keys, searchable_labels, trust_flag, page_search, section_order, file_impact, entity_resolve, entity_references, nuget_packages, cargo_packages]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from strataweave.queries import graph

    rn = f"WITH {cte('g_repos', 'g_nodes')}"
    schemas = rn + """, r AS (SELECT 'db:' || name AS name, source_group AS server_name, lower(name) AS database_name, name AS p FROM g_repos WHERE age_days % 5 <> 0), z AS (SELECT r.name, server_name, database_name, count(*) FILTER (WHERE label = 'Method') AS tables, count(*) FILTER (WHERE label = 'Route') AS views, count(*) FILTER (WHERE label = 'Event') AS procedures
FROM r LEFT JOIN g_nodes n ON n.project = r.p WHERE contains(lower(r.name || '|' || server_name || '|' || database_name), 'a') GROUP BY 1, 2, 3)"""
    store = "WITH st AS (SELECT 'label_' || label AS entity_type, vec_id, embedding, CASE WHEN vec_id % 10 = 0 THEN 'm2' ELSE 'm1' END AS model FROM embeddings WHERE NOT (label = 1 AND CAST(vec_id AS VARCHAR) LIKE '1%'))"
    cos = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
    return {
        "schema_list": schemas + " SELECT * FROM z",
        "schema_totals": schemas + " SELECT count(*) AS schemas, CAST(coalesce(sum(tables), 0) AS BIGINT) AS tables, CAST(coalesce(sum(views), 0) AS BIGINT) AS views, CAST(coalesce(sum(procedures), 0) AS BIGINT) AS procedures FROM z",
        "vector_store": store + " SELECT entity_type, model, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS keys FROM st GROUP BY 1, 2",
        "semantic_nodes": store + f", h AS (SELECT vec_id AS id, {cos} AS score FROM st e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE model = 'm1' ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 40) SELECT id, c_name AS name, round(score, 6) AS score FROM h JOIN customer ON c_custkey = id",
        "node_texts": rn + " SELECT id, md5(label || ' ' || name || ' ' || qualified_name || coalesce(' ' || nullif(dotnet_project, ''), '') || ' ' || project) AS digest FROM g_nodes",
        "chunk_keys": "SELECT DISTINCT page_id || ':' || revision || ':' || chunk_index AS chunk_key, text IS NULL AS empty FROM convention_chunks",
        "searchable_labels": rn + " SELECT label, count(*) AS n FROM g_nodes WHERE label <> 'Function' GROUP BY 1",
        "trust_flag": "SELECT do_not_trust, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN id = 5 THEN true ELSE do_not_trust END AS do_not_trust FROM nodes) GROUP BY 1",
        "page_search": "SELECT DISTINCT page_id, slug, title FROM convention_chunks WHERE contains(lower(slug), 'ro') OR contains(lower(title), 'ro')",
        "section_order": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN -1 ELSE coalesce(max(chunk_index), -1) END AS sort_order FROM convention_chunks GROUP BY page_id",
        "file_impact": graph.oracle_sql()["impact_nodes"].replace("id IN (20000001, 20000004, 30000007)", "project = 'NATION_3' AND file_path = 'src/crm/BUILDING.cs'"),
        "entity_resolve": "WITH c AS (SELECT *, c_custkey % 3 = 0 AS o, c_custkey % 2 = 0 AS n FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0) SELECT 'cust_' || c_custkey AS external_id, CASE WHEN o THEN c_name ELSE lower(c_name) END AS label, CASE WHEN o THEN 'person' ELSE 'buyer' END AS type, CASE WHEN o AND n THEN c_name WHEN n THEN c_mktsegment END AS canonical_name, CASE WHEN n THEN 'A,b' ELSE '' END AS aliases, CASE WHEN o AND n THEN 'known' WHEN n THEN 'new' ELSE ' ' END AS summary, CASE WHEN o THEN 'old' ELSE 'batch' END AS source FROM c",
        "entity_references": "SELECT 'seg_' || c_custkey || '_' || lower(c_mktsegment) AS external_id, 'Seg ' || c_custkey || ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, 'concept' AS type, '' AS summary, 'batch' AS source FROM customer WHERE c_custkey % 2 = 1",
        "nuget_packages": "WITH p AS (SELECT p_brand AS project, p_brand || ':project:App' || p_partkey % 9 AS source_qn, 'Pkg.' || p_size AS a, p_partkey % 7 || '.1' AS va, 'Lib.' || p_partkey % 5 AS b, '2.' || p_partkey % 3 AS vb FROM part) SELECT DISTINCT project, source_qn, 'nuget:' || a AS target_qn, a AS package, va AS version FROM p UNION SELECT project, source_qn, 'nuget:' || b, b, vb FROM p",
        "cargo_packages": "WITH p AS (SELECT p_brand AS project, 'c' || p_partkey % 9 AS crate, p_partkey AS k, p_size AS z FROM part WHERE p_partkey % 4 <> 0) SELECT project, crate, 'serde' AS package, '1.' || k % 4 AS version FROM p UNION SELECT project, crate, 'lib' || z, '0.' || k % 3 FROM p UNION SELECT project, crate, 'local', NULL FROM p UNION SELECT project, crate, 'test', '2' FROM p",
    }
