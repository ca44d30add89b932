"""A store of embeddings by (entity_type, entity_key), and search over the graph's nodes.

Rows: (entity_type, entity_key, embedding, model, dimensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.retrieval import similar

KEY = ["entity_type", "entity_key"]


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored ones of the same key, as a whole."""
    return store.join(incoming.select(*KEY).distinct(), KEY, "left_anti").unionByName(incoming.select(*store.columns))


def delete(store: DataFrame, entity_type: str, key: str | None = None, prefix: str | None = None) -> DataFrame:
    """Without the rows of the type with that key, or with keys that begin with the prefix."""
    gone = (F.col("entity_key") == key) if key is not None else F.col("entity_key").startswith(prefix or "")
    return store.where(~((F.col("entity_type") == entity_type) & gone))


def search(store: DataFrame, query: list[float], k: int, least: float = 0.5, entity_type: str | None = None, model: str | None = None, dimensions: int | None = None) -> DataFrame:
    """(entity_type, entity_key, score): the k nearest of the type, model and dimensions; on a tie by key."""
    rows = store
    for column, value in (("entity_type", entity_type), ("model", model), ("dimensions", dimensions)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return similar(rows.select("entity_type", F.col("entity_key").alias("key"), "embedding"), query, k, least).select("entity_type", F.col("key").alias("entity_key"), "score")


def hydrate(hits: DataFrame, nodes: DataFrame, project: str | None = None) -> DataFrame:
    """Nodes of the hits whose key is a number; a project is chosen after the search, so fewer than k may be left."""
    found = hits.withColumn("id", F.expr("try_cast(entity_key AS bigint)")).where("id is not null").select("id", "score").join(nodes, "id")
    return found if project is None else found.where(F.col("project") == project)


def node_text(label: Column, name: Column, qualified_name: Column, description: Column, project: Column) -> Column:
    """What is embedded of a node: its parts that are not empty, with spaces between."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", label, name, qualified_name, some(description), some(project))


def chunk_key(page: Column, revision: Column, index: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), revision.cast("string"), index.cast("string"))
