"""A database's own catalogue as graph rows: tables, columns, routines, keys, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the server itself.
SYSTEM = ["information_schema", "mysql", "performance_schema", "sys", "pg_catalog"]


def schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").toDF("name").where(~F.lower("name").isin(SYSTEM))


def user_schemas(names: DataFrame) -> DataFrame:
    return names.where(~F.lower("name").isin(SYSTEM)).distinct()


def nodes(tables: DataFrame, columns: DataFrame, routines: DataFrame) -> DataFrame:
    """(qualified_name, name, label, properties) from rows like INFORMATION_SCHEMA's."""
    t = tables.select(F.concat_ws(".", "table_schema", "table_name").alias("qualified_name"), F.col("table_name").alias("name"), F.when(F.col("table_type") == "VIEW", "View").otherwise("Table").alias("label"), F.to_json(F.struct("table_schema")).alias("properties"))
    c = columns.select(F.concat_ws(".", "table_schema", "table_name", "column_name").alias("qualified_name"), F.col("column_name").alias("name"), F.lit("Column").alias("label"), F.to_json(F.struct("data_type", "is_nullable", "ordinal_position")).alias("properties"))
    r = routines.select(F.concat_ws(".", "routine_schema", "routine_name").alias("qualified_name"), F.col("routine_name").alias("name"), F.when(F.col("routine_type") == "FUNCTION", "Function").otherwise("StoredProcedure").alias("label"), F.to_json(F.struct("routine_schema")).alias("properties"))
    return t.unionByName(c).unionByName(r)


def edges(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(source_qn, target_qn, type): HAS_COLUMN, and FOREIGN_KEY from column to column."""
    has = columns.select(F.concat_ws(".", "table_schema", "table_name").alias("source_qn"), F.concat_ws(".", "table_schema", "table_name", "column_name").alias("target_qn"), F.lit("HAS_COLUMN").alias("type"))
    fk = keys.where("referenced_table_name is not null").select(F.concat_ws(".", "table_schema", "table_name", "column_name").alias("source_qn"), F.concat_ws(".", "referenced_table_schema", "referenced_table_name", "referenced_column_name").alias("target_qn"), F.lit("FOREIGN_KEY").alias("type"))
    return has.unionByName(fk)


def listing(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(table, columns, foreign_keys): columns by their position, as text, with the keys that leave the table."""
    cols = edge_rows.where("type = 'HAS_COLUMN'").join(node_rows.select(F.col("qualified_name").alias("target_qn"), "name", F.get_json_object("properties", "$.ordinal_position").cast("int").alias("o")), "target_qn")
    by = cols.groupBy(F.col("source_qn").alias("table")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]), ",").alias("columns"))
    fks = edge_rows.where("type = 'FOREIGN_KEY'").join(cols.select(F.col("target_qn").alias("source_qn"), F.col("source_qn").alias("table")).withColumnRenamed("source_qn", "s"), F.col("source_qn") == F.col("s")).groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("target_qn")), ",").alias("foreign_keys"))
    tables = node_rows.where("label in ('Table', 'View')").select(F.col("qualified_name").alias("table"), "label")
    return tables.join(by, "table", "left").join(fks, "table", "left")


def missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected names that are not there, whatever their case."""
    have = actual.select(F.lower("name").alias("k")).distinct()
    return expected.where(F.col("name").isNotNull()).withColumn("k", F.lower("name")).join(have, "k", "left_anti").select("name").orderBy("name")
