"""Repositories that stand for database schemas, and what their graphs hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of a schema's objects and the columns that count them.
COUNTED = {"Table": "tables", "View": "views", "StoredProcedure": "procedures"}
ORDER = ["server_name", "database_name", "name"]


def schema_repositories(repos: DataFrame, search: str | None = None, server: str | None = None, database: str | None = None) -> DataFrame:
    """repos: (name, properties). Those with a server and a database that are not blank, by equality whatever the case, and by a text in any of the three names."""
    r = repos.select("name", F.get_json_object("properties", "$.serverName").alias("server_name"), F.get_json_object("properties", "$.databaseName").alias("database_name"))
    r = r.where(F.col("server_name").rlike(r"\S") & F.col("database_name").rlike(r"\S"))
    if server is not None:
        r = r.where(F.lower("server_name") == server.lower())
    if database is not None:
        r = r.where(F.lower("database_name") == database.lower())
    if search is not None:
        at = F.lit(False)
        for c in ORDER:
            at = at | (F.instr(F.lower(c), search.lower()) > 0)
        r = r.where(at)
    return r


def with_counts(schemas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every schema with its tables, views and procedures; nodes are counted before the join."""
    some = nodes.where(F.col("label").isin(*COUNTED)).groupBy(F.col("project").alias("name")).agg(*[F.count_if(F.col("label") == k).alias(c) for k, c in COUNTED.items()])
    return schemas.join(some, "name", "left").fillna(0, list(COUNTED.values()))


def ordered(schemas: DataFrame) -> DataFrame:
    """By server, database and name, each without regard to case first."""
    return schemas.orderBy(*[x for c in ORDER for x in (F.lower(c), c)])


def totals(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count_distinct("name").alias("schemas"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED.values()])
