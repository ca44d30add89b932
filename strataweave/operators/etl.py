"""Incremental loading: what changed, snapshots, slices, upserts, language statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """now: (project, path, content); before: (project, path, hash). (project, path, hash, change): new, changed or deleted."""
    h = now.select("project", "path", F.xxhash64("content").alias("hash"))
    j = h.join(before.withColumnRenamed("hash", "old"), ["project", "path"], "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old"), "changed")
    return j.withColumn("change", change).where("change is not null").drop("old")


def replace_snapshot(stored: DataFrame, incoming: DataFrame, key: str = "project") -> DataFrame:
    """The stored rows of projects that are not in the snapshot, and the snapshot."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*stored.columns))


def normal_path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def replace_slice(nodes: DataFrame, edges: DataFrame, paths: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the nodes of some files. nodes: (project, qualified_name, file_path, version); edges: (project, source_qn, target_qn, type, version).

    A node outside the slice with the same name stays as it is. Edges out of the slice go; edges into it from outside stay
    if their target is there again; a new edge replaces a kept one of the same key."""
    cut = paths.select(normal_path(F.col("file_path")).alias("p")).distinct()
    outside = nodes.join(cut, normal_path(F.col("file_path")) == F.col("p"), "left_anti")
    fresh = new_nodes.join(outside.select("project", "qualified_name"), ["project", "qualified_name"], "left_anti")
    all_nodes = outside.unionByName(fresh.select(*outside.columns))
    names = all_nodes.select("project", "qualified_name")
    gone = nodes.join(outside.select("project", "qualified_name"), ["project", "qualified_name"], "left_anti").select("project", F.col("qualified_name").alias("source_qn"))
    kept = edges.join(gone, ["project", "source_qn"], "left_anti").join(new_edges.select("project", "source_qn", "target_qn", "type"), ["project", "source_qn", "target_qn", "type"], "left_anti")
    whole = kept.unionByName(new_edges.select(*kept.columns))
    whole = whole.join(names.withColumnRenamed("qualified_name", "source_qn"), ["project", "source_qn"], "left_semi").join(names.withColumnRenamed("qualified_name", "target_qn"), ["project", "target_qn"], "left_semi")
    return all_nodes, whole


def upsert_last(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins by key: incoming rows beat stored ones, later incoming rows earlier ones."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(incoming.withColumn("_n", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), F.desc(order)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_n", "_r")


def upsert_coalesce(stored: DataFrame, incoming: DataFrame, key: str, always: list[str]) -> DataFrame:
    """Incoming nulls keep what is stored, but for the columns that are always overwritten."""
    a, b = stored.alias("a"), incoming.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    there = F.col(f"b.{key}").isNotNull()
    return j.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in always else F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in stored.columns if c != key])


def delete_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """Each table without the project's rows; cross edges without those at either end."""
    out = {}
    for name, df in tables.items():
        cols = [c for c in ("project", "source_project", "target_project") if c in df.columns]
        cond = F.lit(True)
        for c in cols:
            cond = cond & (F.lower(c) != project.lower())
        out[name] = df.where(F.coalesce(cond, F.lit(True)))
    return out


def language_stats(files: DataFrame) -> DataFrame:
    """files: ([file_id,] project, language, content). Files, lines, non-blank lines and share of the latter, by project and language.

    Lines are counted where the files are read; repeated rows of a file_id count once."""
    lines = F.split(F.coalesce("content", F.lit("")), r"\r\n|\r|\n")
    f = files.select("project", "language", F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("nonblank"))
    if "file_id" in files.columns:
        one = F.min(F.struct("project", "language", "lines", "nonblank")).alias("m")
        f = files.select("file_id", "project", "language", F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("nonblank")).groupBy("file_id").agg(one).select("m.*")
    g = f.groupBy("project", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("nonblank").alias("nonblank"))
    whole = g.groupBy("project").agg(F.sum("nonblank").alias("total"))
    return g.join(whole, "project").select("project", "language", "files", "lines", "nonblank", F.coalesce(F.bround(F.try_divide("nonblank", "total"), 4), F.lit(0.0)).alias("share"))


def dominant_language(stats: DataFrame) -> DataFrame:
    """Most non-blank lines, then most files, then by name."""
    return stats.groupBy("project").agg(F.min(F.struct((-F.col("nonblank")).alias("a"), (-F.col("files")).alias("b"), F.col("language").alias("l"))).alias("m")).select("project", F.col("m.l").alias("language"))


def duplicates(sample: int = 5, **tables: tuple[DataFrame, list[str], str]) -> DataFrame:
    """(category, key, n, samples): keys that several rows have; tables: name=(rows, key columns, sampled column)."""
    out = None
    for name, (df, keys, value) in tables.items():
        g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col(value).cast("string"))), 1, sample), ",").alias("samples")).where("n > 1")
        one = g.select(F.lit(name).alias("category"), F.concat_ws("|", *keys).alias("key"), "n", "samples")
        out = one if out is None else out.unionByName(one)
    return out
