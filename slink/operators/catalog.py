"""Warehouse catalogue: description, profile, filters, upsert."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slink.functions import fixed_values as fixed
from slink.functions import text

# Texts longer than this are compared by digest when distinct values are counted.
KEY_CHARS = 64

COLUMN_SCHEMA = pa.schema(
    [
        ("table_name", pa.string()),
        ("ordinal", pa.int32()),
        ("column_name", pa.string()),
        ("type", pa.string()),
        ("kind", pa.string()),
        ("is_null", pa.bool_()),
        ("default", pa.string()),
        ("comment", pa.string()),
    ]
)
ID_SCHEMA = pa.schema([("table_name", pa.string()), ("table_id", pa.int32())])


def metadata_frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Metadata as a local relation: its true size is known to the planner, which then broadcasts it or not."""
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def table_ids(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Table ids in name order, from 0."""
    return metadata_frame(spark, [(name.upper(), i) for i, name in enumerate(sorted(tables))], ID_SCHEMA)


def warehouse_type(data_type: T.DataType) -> str:
    """Type name in the warehouse's spelling."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "VARCHAR(16777216)"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "NUMBER(38,0)"
    if isinstance(data_type, T.DecimalType):
        return f"NUMBER({data_type.precision},{data_type.scale})"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(data_type, T.TimestampNTZType):
        return "TIMESTAMP_NTZ(9)"
    if isinstance(data_type, T.TimestampType):
        return "TIMESTAMP_TZ(9)"
    if isinstance(data_type, (T.VariantType, T.MapType, T.StructType)):
        return "VARIANT"
    return data_type.typeName().upper()


def describe_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column, from the schemas alone."""
    rows = [
        (
            name.upper(),
            ordinal,
            field.name.upper(),
            warehouse_type(field.dataType),
            "COLUMN",
            field.nullable,
            field.metadata.get("default"),
            field.metadata.get("comment"),
        )
        for name, df in sorted(tables.items())
        for ordinal, field in enumerate(df.schema.fields)
    ]
    return metadata_frame(spark, rows, COLUMN_SCHEMA)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; each table is counted from its own scan, without any column."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n.upper()).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def _as_text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0).cast(field.dataType)  # -0.0 and 0.0 are one value
    return column.cast("string")


def _as_key(field: T.StructField) -> Column:
    """A cell as a short text: long ones become a digest, longer than any plain key so the two never meet."""
    value = _as_text(field)
    if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value
    return F.when(F.length(value) > KEY_CHARS, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


def long_cells(tables: dict[str, DataFrame], only_strings: bool = False, as_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every cell as (column_no, value), one row each, and the names of the numbered columns."""
    parts, names = [], []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if not only_strings or isinstance(f.dataType, T.StringType)]
        if not fields:
            continue
        pairs = []
        for field in fields:
            pairs += [F.lit(len(names)), _as_key(field) if as_key else _as_text(field)]
            names.append((len(names), name.upper(), field.name.upper()))
        parts.append(df.select(F.stack(F.lit(len(fields)), *pairs).alias("column_no", "value")))
    spark = parts[0].sparkSession
    schema = pa.schema([("column_no", pa.int32()), ("table_name", pa.string()), ("column_name", pa.string())])
    return reduce(DataFrame.unionByName, parts), metadata_frame(spark, names, schema)


def _approx_counts(name: str, df: DataFrame) -> DataFrame:
    measures = [
        F.struct(
            F.lit(f.name.upper()).alias("column_name"),
            F.approx_count_distinct(_as_text(f)).alias("distinct_rows"),
            F.count("*").alias("rows"),
            (F.count("*") - F.count(F.col(f"`{f.name}`"))).alias("null_rows"),
        )
        for f in df.schema.fields
    ]
    one = df.agg(F.array(*measures).alias("measures"))
    return one.select(F.lit(name.upper()).alias("table_name"), F.inline("measures"))


def distinct_counts(tables: dict[str, DataFrame], approx: bool = False) -> DataFrame:
    """Rows, nulls and distinct values of every column of every table, in one job.

    Exact form: cells are combined per (column, value) on the map side, shuffled
    once by that pair, then added up per column, so a hot value is one row per
    task. Long texts travel as digests, and columns as numbers.
    """
    if approx:
        return reduce(DataFrame.unionByName, [_approx_counts(name, df) for name, df in tables.items()])
    cells, names = long_cells(tables, as_key=True)
    per_value = cells.groupBy("column_no", "value").agg(F.count("*").alias("n"))
    counted = per_value.groupBy("column_no").agg(
        F.count("value").alias("distinct_rows"),
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"),
    )
    return counted.join(names, "column_no").select("table_name", "column_name", "distinct_rows", "rows", "null_rows")


def profile(spark: SparkSession, tables: dict[str, DataFrame], approx: bool = False) -> DataFrame:
    """Description and counts, one row per column; empty tables show zeros."""
    counted = distinct_counts(tables, approx)
    zero = F.lit(0).cast("long")
    return describe_columns(spark, tables).join(counted, ["table_name", "column_name"], "left").select(
        "table_name",
        "ordinal",
        "column_name",
        "type",
        "kind",
        "is_null",
        "default",
        F.coalesce("distinct_rows", zero).alias("distinct_rows"),
        F.coalesce("rows", zero).alias("rows"),
        F.coalesce("null_rows", zero).alias("null_rows"),
    )


def catalog_tables(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    data_source_id: int = 1,
    database: str = "WAREHOUSE",
    schema: str = "PUBLIC",
) -> DataFrame:
    """Tables with ids in name order (from 0) and row counts."""
    return table_ids(spark, tables).join(row_counts(tables), "table_name").select(
        F.lit(data_source_id).alias("data_source_id"),
        "table_id",
        "table_name",
        text.fqn(F.lit(database), F.lit(schema), F.col("table_name")).alias("fqn"),
        "rows",
        F.lit(False).alias("skip"),
    )


def catalog_columns(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    database: str = "WAREHOUSE",
    schema: str = "PUBLIC",
    id_stride: int = 100,
) -> DataFrame:
    """Columns with ids `table_id * id_stride + ordinal`, without touching any data."""
    widest = max(len(df.columns) for df in tables.values())
    if widest > id_stride:
        raise ValueError(f"id_stride {id_stride} is below the widest table ({widest} columns)")
    return describe_columns(spark, tables).join(table_ids(spark, tables), "table_name").select(
        "table_id",
        "table_name",
        text.fqn(F.lit(database), F.lit(schema), F.col("table_name")).alias("fqn"),
        (F.col("table_id") * id_stride + F.col("ordinal")).alias("column_id"),
        "ordinal",
        F.col("column_name"),
        "type",
    )


def drop_empty_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.coalesce("rows", F.lit(-1)) != 0)


def drop_tables_by_pattern(tables: DataFrame, patterns: list[str] = fixed.SKIP_TABLE_PATTERNS, name: str = "table_name") -> DataFrame:
    return tables.filter(~text.any_pattern(F.col(name), patterns))


def drop_columns_by_pattern(columns: DataFrame, patterns: list[str] = fixed.SKIP_COLUMN_PATTERNS, name: str = "column_name") -> DataFrame:
    return columns.filter(~text.any_pattern(F.col(name), patterns))


def limit_columns(columns: DataFrame, n: int = fixed.MAX_LIMIT) -> DataFrame:
    return columns.filter(F.col("ordinal") < n)


def string_columns_only(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("type").rlike("^VARCHAR"))


def low_cardinality_columns(profiled: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with fewer distinct values than the limit; off when there is none."""
    return profiled if limit is None else profiled.filter(F.col("distinct_rows") < limit)


def smallest_first(tables: DataFrame) -> DataFrame:
    """Position of each table by rows, ascending, NULL as 0."""
    return tables.orderBy(F.coalesce("rows", F.lit(0)), "table_name")


def default_columns(columns: DataFrame, pattern: str = fixed.DEFAULT_COLUMN_PATTERN) -> DataFrame:
    """Key and creation-time columns that every shown table starts with."""
    return columns.filter(F.col("column_name").rlike(pattern))


def catalog_summary(tables: DataFrame, database_schema: Column | None = None) -> DataFrame:
    """Per schema: number of tables, and the tables with their rows, ascending."""
    schema = F.substring_index("fqn", ".", 2) if database_schema is None else database_schema
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "table_name")))
    return (
        tables.groupBy(schema.alias("schema_name"))
        .agg(F.count("*").alias("tables"), listed.alias("listed"))
        .select(
            "schema_name",
            "tables",
            F.array_join(F.transform("listed", lambda t: F.concat_ws(":", t["table_name"], t["rows"].cast("string"))), ",").alias(
                "tables_by_rows"
            ),
        )
    )


def short_schema_text(columns: DataFrame) -> DataFrame:
    """`table: name`, then one indented line per column in readable form."""
    lines = F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit(" "), text.prettify_name(F.col("column_name"))).alias("line"))))
    return columns.groupBy("table_id", "table_name").agg(lines.alias("lines")).select(
        "table_id",
        F.concat(
            F.lit("table: "), F.lower("table_name"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")
        ).alias("schema_text"),
    )


def catalog_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Incoming rows replace stored ones by key; `action` tells insert, update or keep."""
    old = current.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    merged = old.join(new, keys, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "keep")
        .otherwise("update")
    )
    source = F.coalesce("_new", "_old")
    return merged.select(*keys, source.alias("_row"), action.alias("action")).select(
        *keys, *[F.col(f"_row.{v}").alias(v) for v in values], "action"
    )
