"""Import of the supplied warehouse, and linking of question texts over what was imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from slink.plans import bindings as b
from slink.plans.catalog_queries import CLEAN_CTE, DOCUMENTS_CTE, PROFILED
from slink.plans.link_schema import link_question_texts
from slink.plans.ranking_queries import BUDGET, DEFAULT_NAMES, pack_cte
from slink.plans.registry import query
from slink.plans.warehouse_import import import_catalog, import_warehouse, read_imported
from slink.sources.shared import new_path


@query(
    "i1_import_catalog",
    f"""WITH {b.CATALOG_CTE}
    SELECT table_id, fqn, column_id, ordinal, column_name, type, distinct_rows, rows, null_rows
    FROM cat JOIN ({PROFILED}) USING (table_name, column_name)""",
)
def i1(spark, sf_dir):
    """The supplied tables, an emptied one and one of a skipped name, which must not come in."""
    listed = dict(b.tables(spark, sf_dir))
    listed["zz_emptied"] = listed["nation"].filter(F.col("n_name").isNull())
    listed["zz_history_scd"] = listed["region"]
    path = new_path(spark, "import")
    version = import_catalog(spark, listed, path)
    return read_imported(spark, path, "columns", version).select(
        "table_id", "fqn", "column_id", "ordinal", "column_name", "type", "distinct_rows", "rows", "null_rows"
    )


# entries(index_name, vec_id, table_id, column_id, value, content)
ENTRIES_CTE = f"""
entries AS (
  WITH {CLEAN_CTE}, {DOCUMENTS_CTE}
  SELECT index_name, row_number() OVER (
      PARTITION BY index_name ORDER BY table_id, coalesce(column_id, -1), value, chunk_no) - 1 AS vec_id,
    table_id, column_id, value, content FROM built
)"""

# From texts(text) to vectors(text, e, n) of the default embedder.
VECTORS_CTE = """
words AS (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM texts),
word_counts AS (SELECT text, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM words GROUP BY ALL),
word_norms AS (SELECT text, sqrt(sum(n * n)) AS norm FROM word_counts GROUP BY ALL),
weights AS (
  SELECT text, map_from_entries(list((dim, CAST(CAST(n / norm AS FLOAT) AS DOUBLE)))) AS m
  FROM word_counts JOIN word_norms USING (text) GROUP BY text
),
dense AS (
  SELECT text, list_transform(range(64), lambda d: coalesce(m[d], 0.0::DOUBLE)) AS e FROM texts LEFT JOIN weights USING (text)
),
vectors AS (
  SELECT text, e, CASE WHEN list_dot_product(e, e) = 0 THEN 1.0 ELSE sqrt(list_dot_product(e, e)) END AS n FROM dense
)"""


def imported(spark, sf_dir):
    path = new_path(spark, "import")
    version = import_warehouse(spark, b.tables(spark, sf_dir), path, approx=True)
    return read_imported(spark, path, "index", version), read_imported(spark, path, "columns", version)


@query(
    "i2_import_index",
    f"""WITH {b.CATALOG_CTE}, {ENTRIES_CTE}, texts AS (SELECT DISTINCT content AS text FROM entries), {VECTORS_CTE}
    SELECT index_name, vec_id, table_id, column_id, value, md5(content) AS content_digest, round(list_sum(e), 4) + 0.0 AS total
    FROM entries JOIN vectors ON content = text""",
)
def i2(spark, sf_dir):
    index, _ = imported(spark, sf_dir)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return index.select(
        "index_name", "vec_id", "table_id", "column_id", "value", F.md5("content").alias("content_digest"), (F.round(total, 4) + 0.0).alias("total")
    )


@query(
    "i3_link_question_texts",
    f"""WITH {b.CATALOG_CTE}, {ENTRIES_CTE},
    texts AS (SELECT content AS text FROM entries UNION SELECT text FROM benchmark), {VECTORS_CTE},
    pairs AS MATERIALIZED (
      SELECT q.question_id, d.index_name, d.vec_id, d.table_id, d.column_id, d.value,
        round(list_dot_product(q.e, d.e) / (q.n * d.n), 12) + 0.0 AS score
      FROM (SELECT item_id AS question_id, e, n FROM benchmark JOIN vectors USING (text)) q,
           (SELECT * FROM entries JOIN vectors ON content = text) d
    ),
    {b.WEIGHTED_CTE}, {pack_cte('ranked', BUDGET)}
    SELECT question_id, tokens, schema_ddl FROM packed""",
)
def i3(spark, sf_dir):
    """Benchmark texts ask; their words meet the documents that the import made of the warehouse."""
    index, columns = imported(spark, sf_dir)
    questions = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return link_question_texts(questions, index, columns, BUDGET, default_pattern=DEFAULT_NAMES)
