"""Import of a warehouse in one call: tables, profiled columns and the index over both, written version by version.

Below the given path stand `tables`, `columns` and `index`, each with one folder per version. A version is the one before with what
this import saw on top: known tables and columns keep their ids, new ones get ids behind them, and what is no longer there stays listed.
An import that was cut off is repeated under its own number, and gives the same result. One that finds no column leaves an empty version,
which the next import takes for its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slink.functions import fixed_values as fixed
from slink.functions import text
from slink.operators import catalog, documents, values
from slink.operators.documents import Embedder
from slink.sources.stores import materialize, write_index
from slink.streaming.catalog_stream import last_version, read_version, version_path

TABLE_SCHEMA = "table_id int, fqn string, table_name string, rows long, version long"
COLUMN_SCHEMA = (
    "table_id int, column_id int, fqn string, table_name string, ordinal int, column_name string, type string, kind string, "
    "is_null boolean, default string, comment string, distinct_rows long, rows long, null_rows long, version long"
)
DESCRIBED = ["ordinal", "type", "kind", "is_null", "default", "comment", "distinct_rows", "rows", "null_rows"]


@dataclass(frozen=True)
class ImportLimits:
    """Tables of the listing, first columns of a table, most frequent values of a column."""

    tables: int = fixed.MAX_LIMIT
    columns: int = fixed.MAX_LIMIT
    values: int = fixed.MAX_LIMIT


def read_imported(spark: SparkSession, path: str, part: str, version: int | None = None) -> DataFrame:
    """`tables`, `columns` or `index` of a version, the newest if none is named."""
    number = last_version(spark, f"{path}/{part}") if version is None else version
    if number is None:
        raise LookupError(f"nothing was imported to {path}")
    return read_version(spark, f"{path}/{part}", number)


def _stored(spark: SparkSession, path: str, part: str, below: int, schema: str) -> DataFrame:
    before = last_version(spark, f"{path}/{part}", below=below)
    return spark.createDataFrame([], schema) if before is None else read_version(spark, f"{path}/{part}", before)


def _write_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: int, database: str, schema: str) -> None:
    """Tables with rows and without a skipped name, on top of the stored ones."""
    counted = catalog.drop_tables_by_pattern(catalog.drop_empty_tables(catalog.row_counts(tables)))
    seen = counted.select(
        text.fqn(F.lit(database), F.lit(schema), F.col("table_name")).alias("fqn"),
        "table_name",
        "rows",
        F.lit(version).cast("long").alias("version"),
    )
    stored = _stored(spark, path, "tables", version, TABLE_SCHEMA)
    merged = catalog.catalog_upsert(stored, seen, ["fqn"], ["table_name", "rows", "version"]).drop("action")
    known = merged.join(stored.select("fqn", "table_id"), "fqn", "left")
    # One row per table of the warehouse: a listing that the driver holds anyway.
    highest = F.max("table_id").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.col("table_id").isNull()).orderBy("fqn"))
    numbered = known.withColumn("table_id", F.coalesce("table_id", F.coalesce(highest, F.lit(-1)) + place))
    fields = T.StructType.fromDDL(TABLE_SCHEMA).names
    numbered.select(*fields).coalesce(1).write.mode("overwrite").parquet(version_path(f"{path}/tables", version))


def _wanted(spark: SparkSession, tables: dict[str, DataFrame], limits: ImportLimits) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Description of the columns to import, and the tables cut down to them, so that no scan reads another column."""
    described = catalog.drop_columns_by_pattern(catalog.limit_columns(catalog.describe_columns(spark, tables), limits.columns))
    # Schema rows, which come from the driver.
    names = {(r["table_name"], r["column_name"]) for r in described.select("table_name", "column_name").collect()}
    cut = {}
    for name, df in tables.items():
        kept = [f"`{c}`" for c in df.columns[: limits.columns] if (name.upper(), c.upper()) in names]
        if kept:
            cut[name] = df.select(*kept)
    return described, cut


def _write_columns(
    spark: SparkSession,
    described: DataFrame,
    cut: dict[str, DataFrame],
    path: str,
    version: int,
    approx: bool,
    id_stride: int,
) -> None:
    """Profiled columns of the tables of this version, on top of the stored ones."""
    stored = _stored(spark, path, "columns", version, COLUMN_SCHEMA)
    values_ = [*DESCRIBED, "fqn", "table_name", "version"]
    keys = ["table_id", "column_name"]
    if cut:
        tables = read_version(spark, f"{path}/tables", version).select("table_id", "fqn", "table_name")
        seen = (
            described.join(catalog.distinct_counts(cut, approx), ["table_name", "column_name"])
            .join(tables, "table_name")
            .withColumn("version", F.lit(version).cast("long"))
        )
        merged = catalog.catalog_upsert(stored, seen, keys, values_).drop("action")
    else:
        merged = stored.select(*keys, *values_)
    known = merged.join(stored.select(*keys, "column_id"), keys, "left")
    highest = F.max("column_id").over(Window.partitionBy("table_id"))
    place = F.row_number().over(Window.partitionBy("table_id", F.col("column_id").isNull()).orderBy("ordinal", "column_name"))
    first = F.col("table_id") * id_stride
    number = F.coalesce("column_id", F.coalesce(highest, first - 1) + place)
    full = F.raise_error(F.lit(f"a table has more than {id_stride} columns over all versions")).cast("int")
    numbered = known.withColumn("column_id", F.when(number < first + id_stride, number).otherwise(full))
    fields = T.StructType.fromDDL(COLUMN_SCHEMA).names
    numbered.select(*fields).coalesce(1).write.mode("overwrite").parquet(version_path(f"{path}/columns", version))


def _index_documents(spark: SparkSession, columns: DataFrame, cut: dict[str, DataFrame], limits: ImportLimits) -> DataFrame:
    """All documents of the imported tables with their numbers; cleaned values are written once, as five kinds use them."""
    ids = columns.select("table_name", "column_name", "table_id", "column_id")
    texts = {n: df for n, df in cut.items() if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields)}
    if texts:
        kept = values.indexed_values(texts, limits.values).join(ids, ["table_name", "column_name"])
        kept = materialize(kept, "kept-values")
    else:
        kept = spark.createDataFrame([], "table_id int, column_id int, value string, value_rank int")
    return documents.assign_offsets(materialize(documents.build_documents(columns, kept), "documents"))


def import_catalog(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    path: str,
    limits: ImportLimits | None = None,
    approx: bool = False,
    database: str = "WAREHOUSE",
    schema: str = "PUBLIC",
    id_stride: int = 100,
) -> int:
    """Write the next version of tables and columns; its number.

    The first tables of the listing by name, without empty ones and those with skipped names; of each the first columns, without skipped
    names. All are counted and profiled in two jobs over the whole warehouse. With `approx`, distinct values are sketch counts.
    """
    limits = limits or ImportLimits()
    listed = dict(sorted(tables.items())[: limits.tables])
    before = last_version(spark, f"{path}/columns")
    version = 0 if before is None else before + 1
    if listed:
        _write_tables(spark, listed, path, version, database, schema)
    described, cut = _wanted(spark, _tables_of(spark, listed, path, version), limits)
    _write_columns(spark, described, cut, path, version, approx, id_stride)
    return version


def _tables_of(spark: SparkSession, listed: dict[str, DataFrame], path: str, version: int) -> dict[str, DataFrame]:
    """The listed tables that the written version took in. One name per table comes to the driver, as many as it gave."""
    if not listed:
        return {}
    seen = read_version(spark, f"{path}/tables", version).filter(F.col("version") == version)
    names = {r["table_name"] for r in seen.select("table_name").collect()}
    return {name: df for name, df in listed.items() if name.upper() in names}


def import_warehouse(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    path: str,
    limits: ImportLimits | None = None,
    data_source_id: int = 1,
    embedder: Embedder | None = None,
    approx: bool = False,
    database: str = "WAREHOUSE",
    schema: str = "PUBLIC",
    id_stride: int = 100,
) -> int:
    """`import_catalog`, then the index of the same version; its number.

    The index covers the tables that this import saw, with all columns stored for them. It is written once, by data source and kind of
    document, and is complete or not there.
    """
    limits = limits or ImportLimits()
    listed = dict(sorted(tables.items())[: limits.tables])
    version = import_catalog(spark, tables, path, limits, approx, database, schema, id_stride)
    taken = _tables_of(spark, listed, path, version)
    _, cut = _wanted(spark, taken, limits)
    names = [name.upper() for name in taken]
    columns = read_imported(spark, path, "columns", version).filter(F.col("table_name").isin(names) if names else F.lit(False))
    numbered = _index_documents(spark, columns, cut, limits)
    embedded = documents.embed(numbered, "content", embedder).withColumn("data_source_id", F.lit(data_source_id))
    write_index(embedded, version_path(f"{path}/index", version))
    return version
