"""Named tables: load, query, describe, list."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_table(spark: SparkSession, table: str, limit: int | None = None) -> DataFrame:
    """A table by name; a limit of 0 or None means all rows."""
    df = spark.table(table)
    return df.limit(int(limit)) if limit else df


def query(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with named parameters (``:name``) and DataFrames (``{name}``); never paste values in."""
    return spark.sql(sql, args=dict(args or {}), **frames)


def table_info(spark: SparkSession, table: str) -> DataFrame:
    """(cid, name, type, nullable) per column, from the catalog."""
    fields = spark.table(table).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, nullable boolean")


def list_tables(spark: SparkSession) -> DataFrame:
    """(schema, name) of all tables and views in all schemas."""
    names = [row.namespace for row in spark.sql("SHOW SCHEMAS").collect()]
    frames = [
        spark.sql(f"SHOW TABLES IN `{name}`").select(
            F.lit(name).alias("schema"), F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary")
        )
        for name in names
    ]
    tables = reduce(DataFrame.unionByName, frames)
    # Temporary views show up under every schema.
    named = tables.filter(~F.col("temporary"))
    temporary = tables.filter("temporary").select(F.lit("").alias("schema"), "name", "temporary").distinct()
    return named.unionByName(temporary).select("schema", "name")


def count_by_schema(tables: DataFrame) -> DataFrame:
    return tables.groupBy("schema").agg(F.count("name").alias("n"))


def tables_like(tables: DataFrame, part: str = "mart") -> DataFrame:
    """Tables whose name holds the part, case ignored."""
    return tables.filter(F.lower("name").contains(part.lower())).orderBy("schema", "name")


def save(df: DataFrame, name: str, as_view: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """Keep a relation under a name: a view, or a table written once and read by its consumers."""
    if as_view:
        df.createOrReplaceTempView(name)
    else:
        writer = df.write.mode("overwrite").format("parquet")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)
