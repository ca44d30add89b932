"""Bundles, subgraphs and orphans of the memory graph: entities (id, ...), claims (claim_id, subject_id, object_id, status, ...), edges (source_id, target_id, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.memory import lookup_key, search_text


def relations(edges: DataFrame, entity: DataFrame) -> DataFrame:
    """(id, direction, other_id, type) of the asked entities: a union of two equi-joins."""
    out = edges.join(entity.select(F.col("id").alias("source_id")), "source_id").select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), F.col("target_id").alias("other_id"), "type")
    inn = edges.join(entity.select(F.col("id").alias("target_id")), "target_id").select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), F.col("source_id").alias("other_id"), "type")
    return out.unionByName(inn)


def subgraph(seeds: DataFrame, claims: DataFrame, most_entities: int, most_claims: int) -> tuple[DataFrame, DataFrame]:
    """(entities with score, claims): the seeds at 100 and the other ends of their claims at 50, one expansion, capped as the answer's size asks."""
    ends = claims.select("claim_id", "subject_id", "object_id", "recorded_at")
    s = seeds.select(F.col("id").alias("seed"))
    touched = ends.join(s, F.col("subject_id") == F.col("seed")).unionByName(ends.join(s, F.col("object_id") == F.col("seed"))).drop("seed").distinct()
    kept = touched.orderBy(F.desc("recorded_at"), "claim_id").limit(most_claims)
    others = kept.select(F.col("subject_id").alias("id")).union(kept.select("object_id")).where("id is not null").distinct()
    all_ids = seeds.select("id", F.lit(100).alias("score")).unionByName(others.select("id", F.lit(50).alias("score"))).groupBy("id").agg(F.max("score").alias("score"))
    return all_ids.orderBy(F.desc("score"), "id").limit(most_entities), kept


def induced(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def orphan_entities(entities: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no claim and no edge refers to: anti joins one after another."""
    used = claims.select(F.col("subject_id").alias("id")).union(claims.select("object_id")).union(edges.select("source_id")).union(edges.select("target_id")).where("id is not null").distinct()
    return entities.join(used, "id", "left_anti")


def bundle(claims: DataFrame, entity_id: int) -> DataFrame:
    """(status, n, latest) of the claims about one entity."""
    return claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id)).groupBy("status").agg(F.count("*").alias("n"), F.max("recorded_at").alias("latest"))


def counts(entities: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): the sizes of the memory graph in long form."""
    by = claims.groupBy(F.concat(F.lit("claims "), F.lower("status")).alias("what")).agg(F.count("*").alias("n"))
    e = entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "n")
    x = edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")
    o = orphan_entities(entities, claims, edges).agg(F.count("*").alias("n")).select(F.lit("orphan entities").alias("what"), "n")
    return by.unionByName(e).unionByName(x).unionByName(o)


def anchored_seeds(entity_seeds: DataFrame, claim_seeds: DataFrame, claims: DataFrame, limit: int) -> DataFrame:
    """(id, score): where claims match by more than vectors but entities by vectors only, the ends of the claims replace the entities.

    entity_seeds: (id, score, kind); claim_seeds: (claim_id, kind). An end scores 95 for an exact claim, 85 for a lexical one, else 70."""
    strong = not claim_seeds.where("kind <> 'vector'").isEmpty()
    if not strong or not entity_seeds.where("kind <> 'vector'").isEmpty():
        return entity_seeds.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)
    score = F.when(F.col("kind") == "exact", 95.0).when(F.col("kind") == "lexical", 85.0).otherwise(70.0)
    hit = claim_seeds.select("claim_id", score.alias("score")).join(claims.select("claim_id", "subject_id", "object_id"), "claim_id")
    ends = hit.select(F.col("subject_id").alias("id"), "score").unionByName(hit.select(F.col("object_id").alias("id"), "score")).where("id is not null")
    return ends.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def sanitised(claim_seeds: DataFrame, query: str, limit: int) -> DataFrame:
    """claim_seeds: (claim_id, external_id, normalized_text, value_text, predicate, recorded_at, score, kind).

    A seed called exact stays so only if its text or id is the query; if it merely contains all of the query's words it becomes
    lexical with at most 90; otherwise it goes."""
    text, key = search_text(F.lit(query)), lookup_key(F.lit(query))
    exact = (search_text(F.col("normalized_text")) == text) | (lookup_key(F.col("external_id")) == key)
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    own = F.concat(F.lit(" "), search_text(F.concat_ws(" ", "normalized_text", "value_text", "predicate", "external_id")), F.lit(" "))
    lexical = (F.size(words) > 0) & F.forall(words, lambda w: own.contains(w))
    claimed = F.col("kind") == "exact"
    kept = claim_seeds.where(~claimed | F.coalesce(exact, F.lit(False)) | lexical)
    weaker = claimed & ~F.coalesce(exact, F.lit(False))
    return kept.withColumns({"score": F.when(weaker, F.least("score", F.lit(90.0))).otherwise(F.col("score")), "kind": F.when(weaker, "lexical").otherwise(F.col("kind"))}).orderBy(F.desc("score"), F.desc("recorded_at"), "claim_id").limit(limit)


def frontier(seeds: DataFrame, claims: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """(kind, id, score): what one expansion adds to the seeds, entities before claims of the same score and name, best first."""
    size = min(max(limit, 1), 100)
    entities, kept = subgraph(seeds, claims, 2 * size + seeds.count(), 2 * size)  # the seeds a request states
    e = entities.join(seeds.select("id"), "id", "left_anti").select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    c = kept.select(F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("id"), F.lit(100.0).alias("score"))
    return e.unionByName(c).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("kind"), "id").limit(size)


def health_signals(diagnostics: DataFrame, orphans: int) -> DataFrame:
    """(signal): what the receipts' diagnostics (one row) and the number of orphaned rows warn of."""
    s = F.array_compact(F.array(
        F.when(F.col("stale_queued") > 0, "stale_queued_writes"), F.when(F.col("stale_processing") > 0, "stale_processing_writes"), F.when(F.col("retrying") > 0, "writes_retrying"),
        F.when(F.col("failed") > 0, "failed_writes_present"), F.when(F.lit(orphans) > 0, "orphaned_claim_graph_rows"),
    ))
    return diagnostics.select(F.explode(s).alias("signal"))
