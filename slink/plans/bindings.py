"""How the supplied tables stand in for a warehouse, its index and its questions.

Each binding exists twice: as DataFrames, and as SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slink.functions import fixed_values as fixed
from slink.operators import catalog
from slink.plans.warehouse_import import import_catalog, read_imported
from slink.sources.shared import new_path

TABLES = [
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; its schema is read from the file footers only once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TABLES}


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_columns(spark, tables(spark, sf_dir))


def imported_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the written catalogue, after an import that profiles all tables with sketch counts."""
    path = new_path(spark, "catalog")
    return read_imported(spark, path, "columns", import_catalog(spark, tables(spark, sf_dir), path, approx=True))


def warehouse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_tables(spark, tables(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks once."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding", "label")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a document: its label is the table, its number spreads it over indexes and columns."""
    vec = F.col("vec_id")
    slot = (vec % 9).cast("int")
    name = F.element_at(F.array(*[F.lit(i) for i in fixed.ALL_INDEXES]), slot + 1)
    column_id = F.col("label") * 100 + (F.floor(vec / 9) % 2).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.lit(1).alias("data_source_id"),
        name.alias("index_name"),
        vec,
        F.col("label").alias("table_id"),
        F.when(slot >= 3, column_id).alias("column_id"),
        F.when(slot >= 7, F.concat(F.lit("v"), (F.floor(vec / 18) % 3).cast("string"))).alias("value"),
        "embedding",
    )


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


DESCRIBED = " UNION ALL ".join(
    f"SELECT {i} AS table_id, '{t.upper()}' AS table_name, row_number() OVER () - 1 AS ordinal, "
    f"upper(column_name) AS column_name, column_type FROM (DESCRIBE {t})"
    for i, t in enumerate(TABLES)
)

COUNTED = " UNION ALL ".join(
    f"SELECT {i} AS table_id, '{t.upper()}' AS table_name, count(*) AS n_rows FROM {t}" for i, t in enumerate(TABLES)
)

# cat(table_id, table_name, fqn, column_id, ordinal, column_name, type)
CATALOG_CTE = f"""
cat AS (
  SELECT table_id, table_name, 'WAREHOUSE.PUBLIC.' || table_name AS fqn, table_id * 100 + ordinal AS column_id,
         ordinal, column_name,
         CASE WHEN column_type = 'VARCHAR' THEN 'VARCHAR(16777216)'
              WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'NUMBER(38,0)'
              WHEN column_type = 'DOUBLE' THEN 'FLOAT'
              WHEN column_type = 'TIMESTAMP' THEN 'TIMESTAMP_NTZ(9)'
              ELSE 'ARRAY' END AS type
  FROM ({DESCRIBED})
)"""

# cat_tables(table_id, table_name, fqn, n_rows)
CATALOG_TABLES_CTE = f"""
cat_tables AS (SELECT table_id, table_name, 'WAREHOUSE.PUBLIC.' || table_name AS fqn, n_rows FROM ({COUNTED}))"""

# docs(index_name, vec_id, table_id, column_id, value, e, n) and all scored pairs
INDEX_CTE = f"""
docs AS (
  SELECT [{_names(fixed.ALL_INDEXES)}][CAST(vec_id % 9 AS INT) + 1] AS index_name, vec_id, label AS table_id,
         CASE WHEN vec_id % 9 >= 3 THEN label * 100 + (vec_id // 9) % 2 END AS column_id,
         CASE WHEN vec_id % 9 >= 7 THEN 'v' || CAST((vec_id // 18) % 3 AS VARCHAR) END AS value,
         embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings
),
pairs AS (
  SELECT q.vec_id AS question_id, d.index_name, d.vec_id, d.table_id, d.column_id, d.value,
         round(list_dot_product(q.e, d.e) / (q.n * d.n), 12) + 0.0 AS score
  FROM docs q, docs d
)"""


def hits_cte(limits: tuple[int, int], name: str = "hits") -> str:
    """Scored pairs cut to the limits per question and index."""
    return f"""{name} AS (
  SELECT * REPLACE (round(score, 4) + 0.0 AS score) FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, index_name ORDER BY score DESC, vec_id) AS hit_rank FROM pairs
  ) WHERE hit_rank <= CASE WHEN index_name IN ({_names(fixed.VALUE_INDEXES)}) THEN {limits[1]} ELSE {limits[0]} END
)"""


WEIGHT_SQL = "CASE index_name " + " ".join(
    f"WHEN '{n}' THEN {w}"
    for n, w in zip(
        fixed.ALL_INDEXES, fixed.TABLE_WEIGHTS + fixed.COLUMN_WEIGHTS + fixed.VALUE_WEIGHTS, strict=True
    )
) + " END"

ELEMENT_ORDER_SQL = """CASE WHEN value IS NOT NULL THEN 2 WHEN column_id IS NOT NULL THEN 1 ELSE 0 END,
  table_id, coalesce(column_id, -1), coalesce(value, '')"""

LEVEL_SQL = "CASE WHEN value IS NOT NULL THEN 'value' WHEN column_id IS NOT NULL THEN 'column' ELSE 'table' END"

# weighted(question_id, table_id, column_id, value, score)
WEIGHTED_CTE = f"""
{hits_cte(fixed.WEIGHTED_RANK_LIMITS)},
weighted_hits AS (
  SELECT *, CASE WHEN round(score * {WEIGHT_SQL}, 6) = 0 THEN 0.0 ELSE round(score * {WEIGHT_SQL}, 6) END AS weighted FROM hits
),
weighted AS (
  SELECT question_id, table_id, column_id, value, max(weighted) AS score
  FROM weighted_hits GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {ELEMENT_ORDER_SQL}) AS rank FROM weighted
)"""


def features_cte(limits: tuple[int, int]) -> str:
    """features(question_id, table_id, column_id, value, nine scores), table scores copied onto columns."""
    lows = ", ".join(f"min(score) FILTER (index_name = '{n}') AS {n}_score" for n in fixed.ALL_INDEXES)
    level = "CASE WHEN f.value IS NOT NULL THEN 'value' WHEN f.column_id IS NOT NULL THEN 'column' ELSE 'table' END"
    copied = ", ".join(f"CASE WHEN {level} = 'column' THEN t.{n} ELSE f.{n} END AS {n}" for n in fixed.TABLE_SCORES)
    own = ", ".join(f"f.{n}" for n in fixed.COLUMN_SCORES + fixed.VALUE_SCORES)
    return f"""{hits_cte(limits)},
lows AS (SELECT question_id, table_id, column_id, value, {lows} FROM hits GROUP BY question_id, table_id, column_id, value),
features AS (
  SELECT f.question_id, f.table_id, f.column_id, f.value, {copied}, {own}
  FROM lows f LEFT JOIN (SELECT * FROM lows WHERE column_id IS NULL) t
    ON f.question_id = t.question_id AND f.table_id = t.table_id
)"""
