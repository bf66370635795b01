"""Catalogue, profile and value queries over the supplied warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions import render, text
from slink.operators import catalog, documents, search, values
from slink.operators.grouping import top_k_per_group
from slink.plans import bindings as b
from slink.plans.registry import query
from slink.sources.stores import materialize
from slink.sources.tables import list_tables

STRINGS = {
    "benchmark": ["text"],
    "conversations": ["role", "text"],
    "customer": ["c_name", "c_mktsegment"],
    "documents": ["text", "lang", "source"],
    "events": ["event_type", "props"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "nation": ["n_name"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "pages": ["url", "html"],
    "part": ["p_name", "p_brand", "p_type"],
    "region": ["r_name"],
    "supplier": ["s_name"],
}

VALUE_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t.upper()}' AS table_name, '{c.upper()}' AS column_name, {c} AS value, count(*) AS n "
    f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, cs in STRINGS.items()
    for c in cs
)

# Names of many shapes, one per part, as a warehouse listing might hold them.
NAMES_SQL = """
SELECT p_partkey, CASE p_partkey % 8
  WHEN 0 THEN 'FIVETRAN_AUDIT' WHEN 1 THEN '_AIRBYTE_' || upper(replace(p_name, ' ', '_'))
  WHEN 2 THEN upper(replace(p_name, ' ', '_')) || '_SCD' WHEN 3 THEN '__HEVO_' || p_type
  WHEN 4 THEN '_FIVETRAN_ID' WHEN 5 THEN 'is_default_' || lower(p_type)
  WHEN 6 THEN 'values_' || lower(p_type) ELSE upper(replace(p_name, ' ', '_')) END AS name
FROM part
"""


def names(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    upper = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    slot = F.col("p_partkey") % 8
    name = (
        F.when(slot == 0, "FIVETRAN_AUDIT")
        .when(slot == 1, F.concat(F.lit("_AIRBYTE_"), upper))
        .when(slot == 2, F.concat(upper, F.lit("_SCD")))
        .when(slot == 3, F.concat(F.lit("__HEVO_"), "p_type"))
        .when(slot == 4, "_FIVETRAN_ID")
        .when(slot == 5, F.concat(F.lit("is_default_"), F.lower("p_type")))
        .when(slot == 6, F.concat(F.lit("values_"), F.lower("p_type")))
        .otherwise(upper)
    )
    return part.select("p_partkey", name.alias("name"))


@query("s1_list_tables", f"SELECT lower(table_name) AS table_name, n_rows AS rows FROM ({b.COUNTED})")
def s1(spark, sf_dir):
    counts = catalog.row_counts(b.tables(spark, sf_dir)).withColumn("table_name", F.lower("table_name"))
    return list_tables(spark, sf_dir).join(counts, "table_name").select("table_name", "rows")


@query("s2_describe_columns", f"WITH {b.CATALOG_CTE} SELECT table_name, ordinal, column_name, type, 'COLUMN' AS kind FROM cat")
def s2(spark, sf_dir):
    return catalog.describe_columns(spark, b.tables(spark, sf_dir)).select("table_name", "ordinal", "column_name", "type", "kind")


@query(
    "s11_short_schema_text",
    f"""WITH {b.CATALOG_CTE}
    SELECT table_id, 'table: ' || lower(table_name) || chr(10) ||
      string_agg(' ' || replace(lower(column_name), '_', ' '), chr(10) ORDER BY ordinal) || chr(10) AS schema_text
    FROM cat GROUP BY table_id, table_name""",
)
def s11(spark, sf_dir):
    return catalog.short_schema_text(b.imported_columns(spark, sf_dir))


# An emptied copy of nation joins the listing, so the filter has something to drop.
@query("p1_drop_empty_tables", f"WITH {b.CATALOG_TABLES_CTE} SELECT table_name, n_rows AS rows FROM cat_tables WHERE n_rows <> 0")
def p1(spark, sf_dir):
    listed = dict(b.tables(spark, sf_dir))
    listed["zz_emptied"] = listed["nation"].filter(F.col("n_name").isNull())
    return catalog.drop_empty_tables(catalog.row_counts(listed)).select("table_name", "rows")


@query(
    "p2_drop_tables_by_pattern",
    f"SELECT p_partkey, name FROM ({NAMES_SQL}) WHERE NOT regexp_matches(name, 'FIVETRAN_AUDIT|^_AIRBYTE_|_SCD$')",
)
def p2(spark, sf_dir):
    return catalog.drop_tables_by_pattern(names(spark, sf_dir), name="name")


@query(
    "p3_drop_columns_by_pattern",
    f"""SELECT p_partkey, name FROM ({NAMES_SQL}) WHERE NOT (regexp_matches(name, '^__HEVO_|^_FIVETRAN_|^_AIRBYTE_|_SCD$')
      OR contains(lower(name), 'default') OR contains(lower(name), 'values'))""",
)
def p3(spark, sf_dir):
    return catalog.drop_columns_by_pattern(names(spark, sf_dir), name="name")


@query(
    "p4_fqn_names",
    """SELECT p_partkey, 'WAREHOUSE.' || p_type || '.' || p_name AS fqn, p_name AS unqualified,
       'WAREHOUSE.' || p_type || '."' || p_name || '"' AS quoted FROM part""",
)
def p4(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").withColumn("fqn", text.fqn(F.lit("WAREHOUSE"), F.col("p_type"), F.col("p_name")))
    fqn = F.col("fqn")
    return part.select("p_partkey", "fqn", text.unqualified(fqn).alias("unqualified"), text.quoted_fqn(fqn).alias("quoted"))


@query("p5_limit_columns", f"WITH {b.CATALOG_CTE} SELECT table_name, column_name, ordinal FROM cat WHERE ordinal < 3")
def p5(spark, sf_dir):
    return catalog.limit_columns(b.imported_columns(spark, sf_dir), 3).select("table_name", "column_name", "ordinal")


@query("p6_string_columns_only", f"WITH {b.CATALOG_CTE} SELECT table_name, column_name FROM cat WHERE type LIKE 'VARCHAR%'")
def p6(spark, sf_dir):
    return catalog.string_columns_only(b.imported_columns(spark, sf_dir)).select("table_name", "column_name")


@query("p7_drop_blank_values", "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source")
def p7(spark, sf_dir):
    source = F.col("source")
    docs = b.table(spark, sf_dir, "documents").filter(~text.is_empty(source))
    return docs.groupBy(source.alias("value")).agg(F.count("*").alias("n"))


# Texts of every kind the cleaning rules tell apart, derived from whole tables.
CANDIDATES_SQL = """
SELECT 'price' AS kind, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'signed', '-' || CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'dotted', CAST(o_custkey AS VARCHAR) || '.' FROM orders
UNION ALL SELECT 'name', c_name FROM customer
UNION ALL SELECT 'segment', c_mktsegment FROM customer
UNION ALL SELECT 'digest', md5(text) FROM documents
UNION ALL SELECT 'short_digest', substr(md5(text), 1, 19) FROM documents
UNION ALL SELECT 'digest20', substr(md5(text), 1, 20) FROM documents
UNION ALL SELECT 'text', text FROM documents
UNION ALL SELECT 'turn', text FROM conversations
UNION ALL SELECT 'url', url FROM pages
UNION ALL SELECT 'spaced', ' ' FROM region
UNION ALL SELECT 'nothing', '' FROM nation
UNION ALL SELECT 'unknown', CAST(NULL AS VARCHAR) FROM nation
"""

TOKENS_SQL = r"len(regexp_extract_all(value, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'))"
NUMBER_SQL = r"regexp_matches(value, '^[-+]?(\d+\.\d*|\d*\.\d+|\d+)$')"
HEX_SQL = "length(value) >= 20 AND regexp_matches(value, '^[#0-9a-fA-F]+$')"
REASON_SQL = f"""CASE WHEN value IS NULL OR value = '' THEN 'blank' WHEN {NUMBER_SQL} THEN 'only_number'
  WHEN {HEX_SQL} THEN 'long_hex' WHEN length(value) >= 600 THEN 'too_long'
  WHEN length(value) / {TOKENS_SQL} <= 2.0 THEN 'few_chars_per_token'
  WHEN length(value) > 100 THEN 'long_for_index' END"""


def candidates(spark, sf_dir):
    t = b.tables(spark, sf_dir)
    digest = F.md5("text")
    parts = [
        ("price", t["orders"], F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        ("signed", t["orders"], F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))),
        ("dotted", t["orders"], F.concat(F.col("o_custkey").cast("string"), F.lit("."))),
        ("name", t["customer"], F.col("c_name")),
        ("segment", t["customer"], F.col("c_mktsegment")),
        ("digest", t["documents"], digest),
        ("short_digest", t["documents"], F.substring(digest, 1, 19)),
        ("digest20", t["documents"], F.substring(digest, 1, 20)),
        ("text", t["documents"], F.col("text")),
        ("turn", t["conversations"], F.col("text")),
        ("url", t["pages"], F.col("url")),
        ("spaced", t["region"], F.lit(" ")),
        ("nothing", t["nation"], F.lit("")),
        ("unknown", t["nation"], F.lit(None).cast("string")),
    ]
    out = None
    for kind, df, value in parts:
        part = df.select(F.lit(kind).alias("kind"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def flag_counts(df, flag):
    return df.groupBy("kind", flag.alias("flag")).agg(F.count("*").alias("n"))


@query("p8_is_only_number", f"SELECT kind, {NUMBER_SQL} AS flag, count(*) AS n FROM ({CANDIDATES_SQL}) GROUP BY ALL")
def p8(spark, sf_dir):
    return flag_counts(candidates(spark, sf_dir), text.is_only_number(F.col("value")))


@query("p9_is_long_hex", f"SELECT kind, {HEX_SQL} AS flag, count(*) AS n FROM ({CANDIDATES_SQL}) GROUP BY ALL")
def p9(spark, sf_dir):
    return flag_counts(candidates(spark, sf_dir), text.is_long_hex(F.col("value")))


@query(
    "p10_value_length_bounds",
    "SELECT doc_id, length(text) >= 600 AS too_long, length(text) > 100 AS long_for_index FROM documents",
)
def p10(spark, sf_dir):
    too_long, long_for_index = values.length_flags(F.col("text"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", too_long.alias("too_long"), long_for_index.alias("long_for_index")
    )


@query(
    "p11_min_chars_per_token",
    f"SELECT doc_id, {TOKENS_SQL.replace('value', 'text')} AS tokens, length(text) / {TOKENS_SQL.replace('value', 'text')} > 2.0 AS kept FROM documents",
)
def p11(spark, sf_dir):
    content = F.col("text")
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.count_tokens(content).alias("tokens"),
        (text.chars_per_token(content) > fixed.MIN_CHARS_PER_TOKEN).alias("kept"),
    )


@query("p12_clean_values", f"SELECT kind, {REASON_SQL} AS drop_reason, count(*) AS n FROM ({CANDIDATES_SQL}) GROUP BY ALL")
def p12(spark, sf_dir):
    judged = values.clean_values(candidates(spark, sf_dir), keep_dropped=True)
    return judged.groupBy("kind", "drop_reason").agg(F.count("*").alias("n"))


@query(
    "p13_sentinels",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS INT) AS table_id,
      CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS column_id,
      CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS value,
      CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE l_linenumber END AS stored_column_id,
      CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS stored_value
    FROM lineitem""",
)
def p13(spark, sf_dir):
    stored = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_suppkey").alias("t"),
        F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_linenumber")).alias("c"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("v"),
    )
    restored = stored.select(
        "l_orderkey", "l_linenumber", "l_partkey", *search.sentinel_to_null(F.col("t"), F.col("c"), F.col("v"))
    )
    back = search.null_to_sentinel(F.col("table_id"), F.col("column_id"), F.col("value"))
    return restored.select("*", back[1].alias("stored_column_id"), back[2].alias("stored_value"))


@query(
    "p18_pluck",
    "SELECT r_name, r_regionkey FROM region",
)
def p18(spark, sf_dir):
    return b.table(spark, sf_dir, "region").select("r_name", "r_regionkey")


PROFILED = " UNION ALL ".join(
    f"SELECT '{t.upper()}' AS table_name, '{c.upper()}' AS column_name, count(DISTINCT {c}) AS distinct_rows, "
    f"count(*) AS rows, count(*) - count({c}) AS null_rows FROM {t}"
    for t, cs in {
        "benchmark": ["item_id", "text"],
        "conversations": ["conv_id", "turn", "role", "text"],
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "documents": ["doc_id", "text", "lang", "source", "n_chars"],
        "embeddings": ["vec_id", "embedding", "label"],
        "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
        "labels": ["doc_id", "quality", "toxic"],
        "lineitem": [
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        ],
        "nation": ["n_nationkey", "n_name", "n_regionkey"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "pages": ["page_id", "url", "html"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "region": ["r_regionkey", "r_name"],
        "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    }.items()
    for c in cs
)


@query("p20_low_cardinality_columns", f"SELECT table_name, column_name, distinct_rows FROM ({PROFILED}) WHERE distinct_rows < 100")
def p20(spark, sf_dir):
    profiled = catalog.profile(spark, b.tables(spark, sf_dir))
    return catalog.low_cardinality_columns(profiled, 100).select("table_name", "column_name", "distinct_rows")


@query("a1_row_counts", f"SELECT table_name, n_rows AS rows FROM ({b.COUNTED})")
def a1(spark, sf_dir):
    return catalog.row_counts(b.tables(spark, sf_dir))


@query("a2_distinct_counts", f"SELECT table_name, column_name, distinct_rows, rows, null_rows FROM ({PROFILED})")
def a2(spark, sf_dir):
    return catalog.distinct_counts(b.tables(spark, sf_dir))


@query(
    "a3_profile",
    f"""WITH {b.CATALOG_CTE}
    SELECT table_name, ordinal, column_name, type, distinct_rows, rows, null_rows
    FROM cat JOIN ({PROFILED}) USING (table_name, column_name)""",
)
def a3(spark, sf_dir):
    profiled = catalog.profile(spark, b.tables(spark, sf_dir))
    return profiled.select("table_name", "ordinal", "column_name", "type", "distinct_rows", "rows", "null_rows")


@query("a4_value_counts", f"SELECT table_name, column_name, md5(value) AS value_digest, n FROM ({VALUE_COUNTS_SQL})")
def a4(spark, sf_dir):
    counts = values.value_counts(b.tables(spark, sf_dir), catalog.KEY_CHARS + 1, F.md5)
    return counts.select("table_name", "column_name", F.coalesce("digest", F.md5("value")).alias("value_digest"), "n")


@query(
    "w1_top_values",
    f"""SELECT table_name, column_name, md5(value) AS value_digest, n, value_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) AS value_rank
      FROM ({VALUE_COUNTS_SQL})) WHERE value_rank <= 50""",
)
def w1(spark, sf_dir):
    top = values.top_whole_values(b.tables(spark, sf_dir), 50)
    return top.select("table_name", "column_name", F.md5("value").alias("value_digest"), "n", "value_rank")


@query(
    "a12_document_text_table",
    f"""WITH {b.CATALOG_CTE} SELECT table_id, table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal) AS content
    FROM cat GROUP BY table_id, table_name""",
)
def a12(spark, sf_dir):
    return documents.table_text(b.imported_columns(spark, sf_dir)).select("table_id", "content")


# values kept for the index: top n of each text column, cleaned, with catalogue ids
VALUE_LIMIT = fixed.MAX_LIMIT
CLEAN_CTE = f"""
kept AS (
  SELECT table_id, column_id, table_name, fqn, column_name, value, value_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC,
      CASE WHEN length(value) < 600 THEN value END NULLS LAST, sha256(value)) AS value_rank FROM ({VALUE_COUNTS_SQL})
  ) JOIN cat USING (table_name, column_name)
  WHERE value_rank <= {VALUE_LIMIT} AND ({REASON_SQL}) IS NULL
)"""


def kept_values(spark, sf_dir):
    ids = b.columns(spark, sf_dir).select("table_name", "column_name", "table_id", "column_id")
    return values.indexed_values(b.tables(spark, sf_dir), VALUE_LIMIT).join(ids, ["table_name", "column_name"])


@query(
    "a13_document_text_values",
    f"""WITH {b.CATALOG_CTE}, {CLEAN_CTE}
    SELECT column_id, string_agg(value, chr(10) ORDER BY value_rank) AS content FROM kept GROUP BY column_id""",
)
def a13(spark, sf_dir):
    return documents.values_text(kept_values(spark, sf_dir), ["column_id"])


@query(
    "a16_catalog_summary",
    f"""WITH {b.CATALOG_TABLES_CTE}
    SELECT 'WAREHOUSE.PUBLIC' AS schema_name, count(*) AS tables,
      string_agg(table_name || ':' || CAST(n_rows AS VARCHAR), ',' ORDER BY n_rows, table_name) AS tables_by_rows
    FROM cat_tables""",
)
def a16(spark, sf_dir):
    return catalog.catalog_summary(b.warehouse_tables(spark, sf_dir))


@query(
    "w7_default_columns",
    f"""WITH {b.CATALOG_CTE}
    SELECT table_id, string_agg(column_name, ',' ORDER BY ordinal) AS default_columns
    FROM cat WHERE column_name LIKE '%KEY' OR column_name LIKE '%\\_ID' ESCAPE '\\' GROUP BY table_id""",
)
def w7(spark, sf_dir):
    chosen = catalog.default_columns(b.imported_columns(spark, sf_dir), "(KEY|_ID)$")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    return chosen.groupBy("table_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["column_name"]), ",").alias("default_columns")
    )


@query(
    "w8_chunk_text",
    """SELECT doc_id, CAST(i AS INT) AS chunk_no, length(substr(text, i * 7500 + 1, 7500)) AS chars,
      md5(substr(text, i * 7500 + 1, 7500)) AS chunk_digest
    FROM documents, unnest(range((length(text) + 7499) // 7500)) AS r(i)""",
)
def w8(spark, sf_dir):
    chunks = documents.chunk_text(b.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return chunks.select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_digest"))


DOCUMENTS_CTE = f"""
names AS (
  SELECT table_id, table_name, string_agg(column_name, ' ' ORDER BY ordinal) AS spaced,
         string_agg(column_name, chr(10) ORDER BY ordinal) AS lined FROM cat GROUP BY table_id, table_name
),
column_texts AS (
  SELECT table_id, column_id, table_name, column_name, string_agg(value, chr(10) ORDER BY value_rank) AS joined
  FROM kept GROUP BY ALL
),
table_texts AS (
  SELECT table_id, table_name, string_agg(value, chr(10) ORDER BY column_id, value_rank) AS joined FROM kept GROUP BY ALL
),
column_chunks AS (
  SELECT table_id, column_id, table_name, column_name, i AS chunk_no, substr(joined, i * 7500 + 1, 7500) AS chunk
  FROM column_texts, unnest(range((length(joined) + 7499) // 7500)) AS r(i)
),
table_chunks AS (
  SELECT table_id, table_name, i AS chunk_no, substr(joined, i * 7500 + 1, 7500) AS chunk
  FROM table_texts, unnest(range((length(joined) + 7499) // 7500)) AS r(i)
),
built AS (
  SELECT 'table_name' AS index_name, table_id, CAST(NULL AS BIGINT) AS column_id, CAST(NULL AS VARCHAR) AS value, 0 AS chunk_no,
         table_name AS content FROM names
  UNION ALL SELECT 'table_and_all_column_names', table_id, NULL, NULL, 0, table_name || ' ' || spaced FROM names
  UNION ALL SELECT 'table_and_all_column_names_and_all_values', table_id, NULL, NULL, chunk_no,
         n.table_name || chr(10) || lined || chr(10) || chunk FROM table_chunks c JOIN names n USING (table_id)
  UNION ALL SELECT 'column_name', table_id, column_id, NULL, 0, column_name FROM cat
  UNION ALL SELECT 'table_and_column_name', table_id, column_id, NULL, 0, table_name || ' ' || column_name FROM cat
  UNION ALL SELECT 'column_name_and_all_values', table_id, column_id, NULL, chunk_no, column_name || chr(10) || chunk FROM column_chunks
  UNION ALL SELECT 'table_and_column_name_and_all_values', table_id, column_id, NULL, chunk_no,
         table_name || ' ' || column_name || chr(10) || chunk FROM column_chunks
  UNION ALL SELECT 'value', table_id, column_id, value, 0, value FROM kept
  UNION ALL SELECT 'table_column_and_value', table_id, column_id, value, 0, table_name || ' ' || column_name || ' ' || value FROM kept
)"""


def built_documents(spark, sf_dir):
    # Five of the nine kinds use the values: they are written once instead of scanning the warehouse five times.
    kept = materialize(kept_values(spark, sf_dir), "kept-values")
    return documents.build_documents(b.columns(spark, sf_dir), kept)


@query(
    "m2_build_documents",
    f"""WITH {b.CATALOG_CTE}, {CLEAN_CTE}, {DOCUMENTS_CTE}
    SELECT index_name, table_id, column_id, value, chunk_no, md5(content) AS content_digest FROM built""",
)
def m2(spark, sf_dir):
    return built_documents(spark, sf_dir).select(
        "index_name", "table_id", "column_id", "value", "chunk_no", F.md5("content").alias("content_digest")
    )


@query(
    "w12_assign_offsets",
    f"""WITH {b.CATALOG_CTE}, {CLEAN_CTE}, {DOCUMENTS_CTE}
    SELECT index_name, table_id, column_id, value, chunk_no, row_number() OVER (
      PARTITION BY index_name ORDER BY table_id, coalesce(column_id, -1), value, chunk_no) - 1 AS vec_id FROM built""",
)
def w12(spark, sf_dir):
    built = materialize(built_documents(spark, sf_dir), "documents")
    return documents.assign_offsets(built).select(
        "index_name", "table_id", "column_id", "value", "chunk_no", "vec_id"
    )


@query(
    "o1_smallest_first",
    f"WITH {b.CATALOG_TABLES_CTE} SELECT table_name, n_rows AS rows FROM cat_tables",
)
def o1(spark, sf_dir):
    return catalog.smallest_first(catalog.row_counts(b.tables(spark, sf_dir)))


TYPE_SQL = """CASE WHEN type LIKE 'VARCHAR%' THEN 'varchar'
  WHEN type LIKE 'TIMESTAMP_NTZ%' OR type LIKE 'TIMESTAMP_TZ%' THEN 'timestamp'
  WHEN type LIKE 'VARIANT%' THEN NULL
  WHEN type LIKE 'NUMBER%' THEN lower(replace(replace(type, 'NUMBER(38,0)', 'INTEGER'), 'NUMBER', 'NUMERIC'))
  ELSE lower(type) END"""

# Type names with every precision the sizes give, plus the special ones.
TYPES_SQL = """SELECT p_partkey, CASE p_partkey % 8
  WHEN 0 THEN 'VARCHAR(' || CAST(p_size AS VARCHAR) || ')' WHEN 1 THEN 'NUMBER(38,0)'
  WHEN 2 THEN 'NUMBER(' || CAST(p_size AS VARCHAR) || ',2)' WHEN 3 THEN 'TIMESTAMP_NTZ(9)'
  WHEN 4 THEN 'TIMESTAMP_TZ(9)' WHEN 5 THEN 'TIMESTAMP_LTZ(9)' WHEN 6 THEN 'VARIANT' ELSE 'BOOLEAN' END AS type FROM part"""


@query(
    "f6_render_type",
    f"""SELECT p_partkey, type, {TYPE_SQL} AS postgres,
      CASE WHEN type LIKE 'VARCHAR%' THEN 'text'
           WHEN type LIKE 'TIMESTAMP_NTZ%' OR type LIKE 'TIMESTAMP_TZ%' THEN 'timestamp'
           WHEN type LIKE 'VARIANT%' THEN NULL
           ELSE lower(replace(type, 'NUMBER(38,0)', 'NUMBER')) END AS snowflake
    FROM ({TYPES_SQL})""",
)
def f6(spark, sf_dir):
    slot, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    kind = (
        F.when(slot == 0, F.concat(F.lit("VARCHAR("), size, F.lit(")")))
        .when(slot == 1, "NUMBER(38,0)")
        .when(slot == 2, F.concat(F.lit("NUMBER("), size, F.lit(",2)")))
        .when(slot == 3, "TIMESTAMP_NTZ(9)")
        .when(slot == 4, "TIMESTAMP_TZ(9)")
        .when(slot == 5, "TIMESTAMP_LTZ(9)")
        .when(slot == 6, "VARIANT")
        .otherwise("BOOLEAN")
    )
    typed = b.table(spark, sf_dir, "part").select("p_partkey", kind.alias("type"))
    return typed.select(
        "*",
        render.render_type(F.col("type"), "postgres").alias("postgres"),
        render.render_type(F.col("type"), "snowflake").alias("snowflake"),
    )


ESCAPED = r"replace(replace(replace(replace(value, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
LITERAL_SQL = f"""CASE WHEN contains(value, '''') AND NOT contains(value, '"') THEN '"' || {ESCAPED} || '"'
  ELSE '''' || replace({ESCAPED}, '''', '\\''') || '''' END"""
HINTS_SQL = f"""SELECT column_id, string_agg({LITERAL_SQL}, ', ' ORDER BY value_rank) AS listed FROM (
  SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY value_rank) AS hint_no FROM kept) WHERE hint_no <= 5 GROUP BY column_id"""
LINE_SQL = f"' ' || lower(column_name) || ' ' || {TYPE_SQL} || ',' || coalesce(' -- possible values include: ' || listed, '')"


def described_columns(spark, sf_dir):
    kept = kept_values(spark, sf_dir)
    first = top_k_per_group(kept, ["column_id"], [F.asc("value_rank")], fixed.HINTS_STORED, "hint_no")
    hints = first.groupBy("column_id").agg(F.array_sort(F.collect_list(F.struct("hint_no", "value"))).alias("h"))
    joined = b.columns(spark, sf_dir).join(hints, "column_id", "left")
    listed = F.coalesce(F.transform("h", lambda x: x["value"]), F.array().cast("array<string>"))
    return joined.withColumn("line", render.column_line(F.col("column_name"), render.render_type(F.col("type")), listed))


@query(
    "f7_column_line",
    f"WITH {b.CATALOG_CTE}, {CLEAN_CTE} SELECT column_id, {LINE_SQL} AS line FROM cat LEFT JOIN ({HINTS_SQL}) USING (column_id)",
)
def f7(spark, sf_dir):
    return described_columns(spark, sf_dir).select("column_id", "line")


@query(
    "f8_table_ddl",
    f"""WITH {b.CATALOG_CTE}, {CLEAN_CTE}
    SELECT table_id, 'CREATE TABLE ' || lower(table_name) || ' (' || chr(10) || string_agg(line, chr(10) ORDER BY ordinal) || chr(10) || ');' || chr(10) AS ddl
    FROM (SELECT table_id, table_name, ordinal, {LINE_SQL} AS line FROM cat LEFT JOIN ({HINTS_SQL}) USING (column_id))
    GROUP BY table_id, table_name""",
)
def f8(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    grouped = described_columns(spark, sf_dir).filter(F.col("line").isNotNull()).groupBy("table_id", "fqn").agg(lines.alias("lines"))
    return grouped.select(
        "table_id", render.table_ddl(F.col("fqn"), F.transform("lines", lambda x: x["line"])).alias("ddl")
    )


@query("f9_prettify_name", f"WITH {b.CATALOG_CTE} SELECT column_id, replace(lower(column_name), '_', ' ') AS pretty FROM cat")
def f9(spark, sf_dir):
    return b.imported_columns(spark, sf_dir).select("column_id", text.prettify_name(F.col("column_name")).alias("pretty"))


KEYWORD_LIST = ", ".join(f"'{k}'" for k in fixed.KEYWORDS)
KEYWORD_NAMES = "SELECT o_orderkey, [{}][CAST(o_orderkey % 6 AS INT) + 1] AS name FROM orders".format(
    "'order', 'Group', 'o_' || o_orderstatus, 'VALUES', lower(o_orderstatus), 'created_at'"
)


@query(
    "f15_quote_if_keyword",
    f"""SELECT o_orderkey, name, CASE WHEN upper(name) IN ({KEYWORD_LIST}) THEN '"' || name || '"' ELSE name END AS quoted
    FROM ({KEYWORD_NAMES})""",
)
def f15(spark, sf_dir):
    status = F.col("o_orderstatus")
    options = F.array(
        F.lit("order"), F.lit("Group"), F.concat(F.lit("o_"), status), F.lit("VALUES"), F.lower(status), F.lit("created_at")
    )
    named = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(options, (F.col("o_orderkey") % 6).cast("int") + 1).alias("name")
    )
    return named.select("*", text.quote_if_keyword(F.col("name")).alias("quoted"))


# Stored: a profile without two tables and with stale counts. Incoming: a profile without two others.
@query(
    "j13_catalog_upsert",
    f"""WITH stored AS (SELECT table_name, column_name, 0 AS distinct_rows, rows FROM ({PROFILED})
      WHERE table_name NOT IN ('PART', 'REGION')),
    fresh AS (SELECT table_name, column_name, distinct_rows, rows FROM ({PROFILED})
      WHERE table_name NOT IN ('ORDERS', 'NATION'))
    SELECT coalesce(f.table_name, s.table_name) AS table_name, coalesce(f.column_name, s.column_name) AS column_name,
      coalesce(f.distinct_rows, s.distinct_rows) AS distinct_rows, coalesce(f.rows, s.rows) AS rows,
      CASE WHEN s.table_name IS NULL THEN 'insert' WHEN f.table_name IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM stored s FULL JOIN fresh f ON s.table_name = f.table_name AND s.column_name = f.column_name""",
)
def j13(spark, sf_dir):
    # Written once: both sides of the upsert come from it.
    profiled = materialize(catalog.profile(spark, b.tables(spark, sf_dir)), "profile").select(
        "table_name", "column_name", "distinct_rows", "rows"
    )
    stored = profiled.filter(~F.col("table_name").isin("PART", "REGION")).withColumn("distinct_rows", F.lit(0).cast("long"))
    fresh = profiled.filter(~F.col("table_name").isin("ORDERS", "NATION"))
    return catalog.catalog_upsert(stored, fresh, ["table_name", "column_name"], ["distinct_rows", "rows"])
