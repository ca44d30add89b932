"""Queries over sources, extractors, logs and the memory graph."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.text import project_key
from strataweave.operators import extract as X
from strataweave.operators import history as H
from strataweave.operators import logs as G
from strataweave.operators import memory_graph as MG
from strataweave.operators import retrieval as K
from strataweave.plans.bind import cte
from strataweave.plans.bind import view as V
from strataweave.sources import files as S
from strataweave.sources import gitlog as L
from strataweave.sources.tables import table


def git_log_touches(s: SparkSession, d: str) -> DataFrame:
    """The history written as `git log --numstat` lines and parsed again."""
    c = V(s, d, "h_commits").select((F.col("commit_id") * 100).alias("line_no"), F.concat_ws("\0", F.col("commit_id").cast("string"), "author", F.date_format("author_date", "yyyy-MM-dd'T'HH:mm:ss"), "message").alias("value"))
    t = V(s, d, "h_touches").select((F.col("commit_id") * 100 + F.col("seq")).alias("line_no"), F.concat_ws("\t", F.col("added").cast("string"), F.col("removed").cast("string"), "path").alias("value"))
    commits, touches = L.parse(c.unionByName(t))
    return touches.join(commits, "commit_id").groupBy("author", "message").agg(F.count("*").alias("touches"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("author_date").alias("last"))


def file_window(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "source_files").where("content is not null and file_path not like '%..%'").select(F.concat(F.lit("f/"), F.col("file_id").cast("string")).alias("path"), "content").dropDuplicates(["path"])
    first = f.agg(F.min("path")).first()[0]  # one name
    return S.window(f, first, 3, 7, around=5, whole_below=0).select("line", F.md5("text").alias("digest"))


def wanted_files(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "source_files").where("file_path is not null").select("file_id", "file_path").distinct()
    return f.where(S.wanted(F.col("file_path"))).groupBy(S.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))


def _code(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files").where("content is not null").dropDuplicates(["file_id"]).select(project_key(F.col("project")).alias("project"), F.col("file_path").alias("path"), "content")


def extract_symbols(s: SparkSession, d: str) -> DataFrame:
    return X.extract(_code(s, d)).groupBy("kind", F.coalesce("label", "type", "name").alias("what")).agg(F.count("*").alias("n"))


def file_complexity(s: SparkSession, d: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, q, *X.complexity(t, not q.endswith(".py"))) for p, q, t in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["project", "path", "nesting", "deep", "functions", "lines", "branches"])

    m = _code(s, d).mapInPandas(run, "project string, path string, nesting int, deep double, functions int, lines int, branches int")
    return m.select("project", "path", "nesting", F.round(H.complexity_score(F.col("nesting"), F.col("deep"), F.col("functions"), F.col("lines"), F.col("branches")), 4).alias("score"))


def markdown_sections(s: SparkSession, d: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, i, h, len(b)) for k, t in f.itertuples(index=False) for i, (h, b) in enumerate(K.sections(t))], columns=["doc_id", "section", "heading", "chars"], dtype=object)

    return table(s, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, section int, heading string, chars int")


def _memory(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims of all orders, all customers, an edge from each customer."""
    o, key = table(s, d, "orders"), F.col("o_orderkey")
    claims = o.select(key.alias("claim_id"), F.col("o_custkey").alias("subject_id"), F.when(key % 3 == 0, F.col("o_custkey") + 1).alias("object_id"), F.when(key % 5 == 0, "conflicted").otherwise("active").alias("status"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"))
    entities = table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return entities, claims, entities.select(F.col("id").alias("source_id"), (F.col("id") + 4).alias("target_id"), F.lit("near").alias("type"))


def memory_counts(s: SparkSession, d: str) -> DataFrame:
    return MG.counts(*_memory(s, d))


def memory_subgraph(s: SparkSession, d: str) -> DataFrame:
    e, c, _ = _memory(s, d)
    return MG.subgraph(e.where("id in (1, 7, 22)"), c, 40, 60)[0]


def memory_relations(s: SparkSession, d: str) -> DataFrame:
    e, _, x = _memory(s, d)
    return MG.relations(x, e)


def runtime_support(s: SparkSession, d: str) -> DataFrame:
    p = V(s, d, "g_repos").select(F.col("source_group").alias("project"), F.concat(F.lit("NET"), (F.col("age_days") % 4 + 5).cast("string"), F.lit(".0")).alias("framework"))
    life = s.createDataFrame([("net5.0", date(2022, 5, 10)), ("net6.0", date(2024, 11, 12)), ("net8.0", date(2026, 11, 10))], "framework string, end_of_life date")
    return G.support_status(p, life, date(2025, 1, 1))


def inspection_targets(s: SparkSession, d: str) -> DataFrame:
    t = V(s, d, "h_touches")
    churned = t.groupBy("path").agg((F.count("*") * 2.0).alias("score")).withColumn("reason", F.lit("changed often"))
    big = t.groupBy("path").agg((F.max("added") / 10).alias("score")).withColumn("reason", F.lit("large change"))
    return G.inspection_targets(churned.unionByName(big), 15)


def log_search(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("logged_at"), F.concat(F.lit("Call "), F.col("event_type")).alias("message"), F.col("props").alias("properties"), (F.col("user_id") % 3).cast("string").alias("service"))
    return G.search_log(e, datetime(2024, 1, 5), datetime(2024, 1, 9), "ERROR", service="1").select("id", "message")


QUERIES = [git_log_touches, file_window, wanted_files, extract_symbols, file_complexity, markdown_sections, runtime_support, inspection_targets, log_search, memory_counts, memory_subgraph, memory_relations]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_MEM = """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END AS o, CASE WHEN o_orderkey % 5 = 0 THEN 'conflicted' ELSE 'active' END AS status, o_orderdate AS t FROM orders), x AS (SELECT c_custkey AS a, c_custkey + 4 AS b FROM customer) """


def oracle_sql() -> dict[str, str]:
    sql = {
        "git_log_touches": f"WITH {cte('h_commits', 'h_touches')} SELECT author, message, count(*) AS touches, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, max(author_date) AS last FROM h_touches JOIN h_commits USING (commit_id) GROUP BY 1, 2",
        "file_window": "WITH f AS (SELECT DISTINCT ON (file_id) 'f/' || file_id AS path, content FROM source_files WHERE content IS NOT NULL AND file_path NOT LIKE '%..%'), m AS (SELECT unnest(regexp_split_to_array(content, '\\r\\n|\\n')) AS t, generate_subscripts(regexp_split_to_array(content, '\\r\\n|\\n'), 1) AS line FROM f WHERE path = (SELECT min(path) FROM f)) SELECT CAST(line AS INT) AS line, md5(t) AS digest FROM m WHERE line BETWEEN -2 AND 12",
        "wanted_files": "WITH f AS (SELECT DISTINCT file_id, lower(replace(file_path, '\\', '/')) AS p FROM source_files WHERE file_path IS NOT NULL) SELECT CASE regexp_extract(p, '\\.(\\w+)$', 1) WHEN 'cs' THEN 'csharp' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE regexp_extract(p, '\\.(\\w+)$', 1) END AS language, count(*) AS files FROM f WHERE NOT regexp_matches(p, '(^|/)(bin|obj|node_modules|build|managed_components|\\.cache|wwwroot/lib|\\.git|packages|testresults)/') AND NOT p LIKE '%.min.js' GROUP BY 1",
        "memory_counts": _MEM + "SELECT 'claims ' || status AS what, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'edges', count(*) FROM x UNION ALL SELECT 'orphan entities', count(*) FROM customer WHERE c_custkey NOT IN (SELECT s FROM c UNION SELECT o FROM c WHERE o IS NOT NULL UNION SELECT a FROM x UNION SELECT b FROM x)",
        "memory_subgraph": _MEM + ", k AS (SELECT DISTINCT claim_id, s, o, t FROM c WHERE s IN (1, 7, 22) OR o IN (1, 7, 22) ORDER BY t DESC, claim_id LIMIT 60), e AS (SELECT s AS id FROM k UNION SELECT o FROM k WHERE o IS NOT NULL) SELECT id, CAST(max(score) AS INT) AS score FROM (SELECT c_custkey AS id, 100 AS score FROM customer WHERE c_custkey IN (1, 7, 22) UNION ALL SELECT id, 50 FROM e) GROUP BY 1 ORDER BY score DESC, id LIMIT 40",
        "memory_relations": _MEM + ", e AS (SELECT c_custkey AS id FROM customer) SELECT a AS id, 'out' AS direction, b AS other_id, 'near' AS type FROM x WHERE a IN (SELECT id FROM e) UNION ALL SELECT b, 'in', a, 'near' FROM x WHERE b IN (SELECT id FROM e)",
        "runtime_support": f"WITH {cte('g_repos')}, k AS (SELECT source_group AS project, CASE age_days % 4 + 5 WHEN 5 THEN true WHEN 6 THEN true WHEN 8 THEN false END AS o FROM g_repos) SELECT project, CASE WHEN count(o) = 0 THEN 'unknown' WHEN NOT bool_or(o) THEN 'supported' WHEN bool_and(o) THEN 'out_of_support' ELSE 'mixed' END AS status FROM k GROUP BY 1",
        "inspection_targets": f"WITH {cte('h_touches')}, r AS (SELECT path, count(*) * 2.0 AS score, 'changed often' AS reason FROM h_touches GROUP BY 1 UNION ALL SELECT path, max(added) / 10, 'large change' FROM h_touches GROUP BY 1) SELECT path, CAST(sum(score) AS DOUBLE) AS score, string_agg(reason, '; ' ORDER BY score DESC, reason DESC) AS reasons FROM r GROUP BY 1 ORDER BY score DESC, path LIMIT 15",
        "log_search": "SELECT event_id AS id, 'Call ' || event_type AS message FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND user_id % 3 = 1 AND (contains(lower('Call ' || event_type), 'error') OR contains(lower(props), 'error'))",
    }
    return sql
