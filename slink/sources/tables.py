"""Warehouse folders of Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def list_tables(spark: SparkSession, source: str, limit: int | None = None) -> DataFrame:
    """Tables of a folder (`name.parquet`, a file or a directory of parts), or of a catalog database.

    A folder is listed as a DataFrame of files; file contents are never read.
    """
    if "/" in source:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(source)
            .select("path", "length")
        )
        # Longest prefix left of the first `.parquet`, so part files count for their table.
        name = F.regexp_extract("path", r"/([^/]+?)\.parquet(?:/|$)", 1)
        tables = (
            files.groupBy(name.alias("table_name"))
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        )
    else:
        rows = [(t.name,) for t in spark.catalog.listTables(source)]
        tables = spark.createDataFrame(rows, "table_name string").select(
            "table_name", F.lit(None).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes")
        )
    return tables.orderBy("table_name").limit(limit) if limit else tables


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = 100) -> DataFrame:
    """Run a statement over named DataFrames, with the row cap where it has no LIMIT."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    result = spark.sql(sql)
    return result if limit is None or re.search(r"\sLIMIT\s", sql) else result.limit(limit)


def cap_rows(df: DataFrame, order: list, has_limit: bool = False, limit: int = 100) -> DataFrame:
    """First `limit` rows in a total order; untouched when the query has its own limit."""
    return df if has_limit else df.orderBy(*order).limit(limit)
