"""Question log, evaluation groups and a structured query log from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slink.plans.bindings import table

TURN_STRIDE = 100_000

# evaluation groups: one per labelled conversation; gold SQL is the first answer, blank where labelled toxic
GROUPS_CTE = """
groups AS (
  SELECT l.doc_id AS group_id, CASE WHEN quality = 1 THEN 'CORRECT' WHEN toxic = 1 THEN 'INCOMPLETE' ELSE 'UNREAD' END AS status,
         CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN ' ' ELSE a.gold_sql END AS gold_sql, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 END AS data_source_id,
         doc_id AS created
  FROM labels l LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS gold_sql FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a
    ON a.conv_id = l.doc_id
),
questions AS (
  SELECT conv_id * 100000 + turn AS question_id, conv_id AS group_id, text, turn AS created, 'SELECT ' || length(text) AS generated_sql
  FROM conversations WHERE role = 'user'
)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    gold = answers.groupBy("conv_id").agg(F.min_by("text", "turn").alias("gold_sql"))
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 1, "CORRECT").when(F.col("toxic") == 1, "INCOMPLETE").otherwise("UNREAD")
    blank = (F.col("toxic") == 1) | (F.col("doc_id") % 5 == 0)
    return labels.join(gold, labels.doc_id == gold.conv_id, "left").select(
        F.col("doc_id").alias("group_id"),
        status.alias("status"),
        F.when(blank, " ").otherwise(F.col("gold_sql")).alias("gold_sql"),
        F.when(F.col("doc_id") % 7 != 0, 1).alias("data_source_id"),
        F.col("doc_id").alias("created"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        (F.col("conv_id") * TURN_STRIDE + F.col("turn")).alias("question_id"),
        F.col("conv_id").alias("group_id"),
        "text",
        F.col("turn").alias("created"),
        F.concat(F.lit("SELECT "), F.length("text").cast("string")).alias("generated_sql"),
    )


# asked(question_id, group_id, user_id, text, created, sql, failed, answer): every event is a question of its user
ASKED_CTE = """
asked AS (
  SELECT event_id AS question_id, user_id AS group_id, user_id, user_id % 3 AS data_source_id, props AS text, ts AS created,
         CASE WHEN event_type = 'view' THEN NULL ELSE 'SELECT ' || props END AS sql, event_type = 'error' AS failed,
         CASE event_type WHEN 'purchase' THEN 'CORRECT' WHEN 'click' THEN 'INCORRECT' END AS answer
  FROM events
)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("question_id"),
        F.col("user_id").alias("group_id"),
        "user_id",
        (F.col("user_id") % 3).alias("data_source_id"),
        F.col("props").alias("text"),
        F.col("ts").alias("created"),
        F.when(kind != "view", F.concat(F.lit("SELECT "), "props")).alias("sql"),
        (kind == "error").alias("failed"),
        F.when(kind == "purchase", "CORRECT").when(kind == "click", "INCORRECT").alias("answer"),
    )


# The logged query of each event type. Values may use the event's own columns.
#   view     SELECT * FROM documents, labels
#   click    SELECT o.o_orderkey AS k FROM orders AS o WHERE o.o_orderstatus = 'F' AND o.o_orderpriority = <p>
#            AND EXISTS (SELECT l_orderkey FROM lineitem WHERE o_orderkey = l_orderkey)
#            AND EXISTS (SELECT c_custkey FROM customer WHERE c_custkey = o_custkey AND l_partkey = 1)
#            (the sibling's lineitem is out of sight, so l_partkey is not resolved)
#   purchase SELECT l.*, p_name FROM lineitem AS l JOIN part ON l.l_partkey = p_partkey
#            WHERE p_brand = <brand of the user> AND LOWER(p_type) = 'economy'
#   signup   SELECT COUNT(*), doc_id FROM documents, labels, customer
#            WHERE c_mktsegment IN ("BUILDING", "segment of the user") AND c_name IN ('x')
#   error    SELECT orders.o_orderkey, no_such FROM orders AS o, customer WHERE c_name = <user>
#   bare     SELECT lonely (views of every fourth user: a query without tables)
#   nested   SELECT d.c, p_name, d.nope, d.* FROM (SELECT l_partkey AS c FROM lineitem) AS d, part (purchases of every fourth user)
#   deep     SELECT a, * FROM (SELECT b AS a FROM (SELECT l_suppkey AS b FROM lineitem) AS u) AS t, region (clicks of every fourth user)
KIND_SQL = (
    "CASE WHEN event_type = 'view' AND user_id % 4 = 0 THEN 'bare' "
    "WHEN event_type = 'purchase' AND user_id % 4 = 1 THEN 'nested' "
    "WHEN event_type = 'click' AND user_id % 4 = 2 THEN 'deep' ELSE event_type END"
)
LOG = {
    "nested": {
        "tables": [("part", None, ()), ("lineitem", None, (1,))],
        "columns": [("d", "c", 1, ()), (None, "p_name", 1, ()), ("d", "nope", 1, ()), (None, "l_partkey", 2, (1,))],
        "stars": [("d", ())],
        "derived": [("d", "c", None, "l_partkey", (), (1,))],
    },
    "deep": {
        "tables": [("region", None, ()), ("lineitem", None, (1, 1))],
        "columns": [(None, "a", 1, ()), (None, "b", 2, (1,)), (None, "l_suppkey", 2, (1, 1))],
        "stars": [(None, ())],
        "derived": [("t", "a", None, "b", (), (1,)), ("u", "b", None, "l_suppkey", (1,), (1, 1))],
    },
    "bare": {
        "columns": [(None, "lonely", 1, ())],
    },
    "view": {
        "tables": [("documents", None, ()), ("labels", None, ())],
        "stars": [(None, ())],
    },
    "click": {
        "tables": [("orders", "o", ()), ("lineitem", None, (1,)), ("customer", None, (2,))],
        "columns": [("o", "o_orderkey", 2, ()), ("o", "o_orderstatus", 1, ()), ("o", "o_orderpriority", 1, ()), (None, "l_orderkey", 2, (1,)), (None, "o_orderkey", 1, (1,)),
                    (None, "c_custkey", 2, (2,)), (None, "o_custkey", 1, (2,)), (None, "l_partkey", 1, (2,))],
        "eq": [("o", "o_orderstatus", "'F'", ()), ("o", "o_orderpriority", "concat('P', CAST(user_id % 5 AS {string}))", ())],
    },
    "purchase": {
        "tables": [("lineitem", "l", ()), ("part", None, ())],
        "columns": [("l", "l_partkey", 1, ()), (None, "p_partkey", 1, ()), (None, "p_name", 1, ()), (None, "p_brand", 1, ()), (None, "p_type", 1, ())],
        "stars": [("l", ())],
        "eq": [(None, "p_brand", "concat('Brand#', CAST(user_id % 25 AS {string}))", ()), (None, "p_type", "'economy'", ())],
    },
    "signup": {
        "tables": [("documents", None, ()), ("labels", None, ()), ("customer", None, ())],
        "columns": [(None, "doc_id", 1, ()), (None, "c_mktsegment", 1, ()), (None, "c_name", 1, ())],
        "in_items": [
            (None, "c_mktsegment", "'BUILDING'", True, ()),
            (None, "c_mktsegment", "concat('S', CAST(user_id AS {string}))", True, ()),
            (None, "c_name", "'x'", False, ()),
        ],
    },
    "error": {
        "tables": [("orders", "o", ()), ("customer", None, ())],
        "columns": [("orders", "o_orderkey", 1, ()), (None, "no_such", 1, ()), (None, "c_name", 1, ())],
        "eq": [(None, "c_name", "concat('U', CAST(user_id AS {string}))", ())],
    },
}
FIELDS = {
    "derived": [("alias", "string"), ("name", "string"), ("qualifier", "string"), ("column", "string"), ("path", "path"), ("inner", "path")],
    "tables": [("name", "string"), ("alias", "string"), ("path", "path")],
    "columns": [("qualifier", "string"), ("name", "string"), ("times", "int"), ("path", "path")],
    "stars": [("qualifier", "string"), ("path", "path")],
    "eq": [("qualifier", "string"), ("name", "string"), ("value", "expression"), ("path", "path")],
    "in_items": [("qualifier", "string"), ("name", "string"), ("value", "expression"), ("quoted_identifier", "boolean"), ("path", "path")],
}


def _literal(value, kind: str, string: str) -> str:
    if kind == "path":
        numbers = ", ".join(map(str, value))
        return f"CAST(array({numbers}) AS array<int>)" if string == "STRING" else f"CAST([{numbers}] AS INT[])"
    if kind == "expression":
        return value.format(string=string)
    if value is None:
        return f"CAST(NULL AS {string})"
    return f"'{value}'" if kind == "string" else str(value).lower()


def _spark_array(field: str, rows: list[tuple]) -> str:
    plain = {"expression": "string", "path": "array<int>"}
    types = ",".join(f"{n}:{plain.get(k, k)}" for n, k in FIELDS[field])
    structs = [
        "named_struct(" + ", ".join(f"'{n}', {_literal(v, k, 'STRING')}" for (n, k), v in zip(FIELDS[field], row, strict=True)) + ")"
        for row in rows
    ]
    return f"CAST(array({', '.join(structs)}) AS array<struct<{types}>>)"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structured query per event."""
    columns = [F.col("event_id").alias("query_id")]
    for field in FIELDS:
        cases = " ".join(f"WHEN '{kind}' THEN {_spark_array(field, parts.get(field, []))}" for kind, parts in LOG.items())
        columns.append(F.expr(f"CASE {KIND_SQL} {cases} END").alias(field))
    return table(spark, sf_dir, "events").select(*columns)


def _flat(field: str) -> str:
    """The log entries of one field as plain rows, one SELECT per entry."""
    selects = []
    for kind, parts in LOG.items():
        for no, row in enumerate(parts.get(field, [])):
            cells = ", ".join(f"{_literal(v, k, 'VARCHAR')} AS \"{n}\"" for (n, k), v in zip(FIELDS[field], row, strict=True))
            selects.append(f"SELECT event_id AS query_id, {no} AS no, {cells} FROM events WHERE {KIND_SQL} = '{kind}'")
    return " UNION ALL ".join(selects)


# Depth, then a derived table as the last of its query, then position.
_PLACE_SQL = "coalesce(r.shown, r.depth) * 1000000 + CAST(r.shown IS NOT NULL AS INT) * 1000 + t.no"


def _sources(reads: str, level: int, field: str) -> str:
    """What the references of one level mean through a derived column, one level further in."""
    shown = "len(d.path)" if level == 1 else "r.shown"
    return f"""{field}_in{level} AS (
  SELECT r.query_id, r.no, d.qualifier, d."column" AS name, d."inner" AS path, {shown} AS shown
  FROM {reads} r JOIN derived_flat d ON d.query_id = r.query_id AND d.name = r.name
  WHERE (r.qualifier IS NULL OR r.qualifier = d.alias) AND r.path[1:len(d.path)] = d.path AND r.path[1:len(d."inner")] <> d."inner"
)"""


def _resolved(field: str, name: str) -> str:
    """References by the paths of the queries around them, so that tables join by equal (query, path)."""
    return f"""{_sources(f"{field}_flat", 1, field)},
{_sources(f"{field}_in1", 2, field)},
{field}_read AS (
  SELECT query_id, no, qualifier, name, path, NULL::INT AS shown FROM {field}_flat
  UNION ALL SELECT * FROM {field}_in1 UNION ALL SELECT * FROM {field}_in2
),
{field}_seen AS MATERIALIZED (
  SELECT query_id, no, qualifier, name, shown, depth, path[1:depth] AS path
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM {field}_read)
),
{field}_won AS MATERIALIZED (
  SELECT r.query_id, r.no, arg_max(lower(c.table_name), {_PLACE_SQL}) AS table_name, arg_max(r.name, {_PLACE_SQL}) AS real_name
  FROM {field}_seen r JOIN tables_flat t ON t.query_id = r.query_id AND t.path = r.path
  JOIN cat c ON lower(c.table_name) = t.name AND lower(c.column_name) = r.name
  WHERE r.qualifier IS NULL OR r.qualifier = coalesce(t.alias, t.name)
  GROUP BY r.query_id, r.no
),
{name} AS MATERIALIZED (
  SELECT r.* REPLACE (w.real_name AS name), w.table_name FROM {field}_flat r JOIN {field}_won w ON w.query_id = r.query_id AND w.no = r.no
  UNION ALL
  SELECT r.*, NULL AS table_name FROM {field}_flat r ANTI JOIN {field}_won w ON w.query_id = r.query_id AND w.no = r.no
)"""


# needs cat; gives t1..t5(query_id, table_name, column_name, value, touches) and touches
LOG_CTE = f"""
{", ".join(f"{field}_flat AS MATERIALIZED ({_flat(field)})" for field in FIELDS)},
star_out_flat AS MATERIALIZED (
  SELECT s.query_id, s.no * 1000 + d.no AS no, d.qualifier, d."column" AS name, d."inner" AS path, s.no AS star_no, d.name AS shown, d.no AS output
  FROM stars_flat s JOIN derived_flat d ON d.query_id = s.query_id AND d.path = s.path AND (s.qualifier IS NULL OR s.qualifier = d.alias)
),
{_resolved("columns", "columns_resolved")},
{_resolved("eq", "eq_resolved")},
{_resolved("in_items", "in_resolved")},
{_resolved("star_out", "star_out_resolved")},
t1 AS (SELECT query_id, name AS table_name, NULL::VARCHAR AS column_name, NULL::VARCHAR AS value, count(*) AS touches FROM tables_flat GROUP BY ALL),
t2 AS (SELECT query_id, table_name, name AS column_name, NULL::VARCHAR AS value, CAST(sum(times) AS BIGINT) AS touches
  FROM columns_resolved WHERE table_name IS NOT NULL GROUP BY ALL),
star_shown AS (
  SELECT s.query_id, s.no AS star_no, lower(c.column_name) AS shown, t.no AS place, t.name AS table_name, lower(c.column_name) AS column_name
  FROM stars_flat s JOIN tables_flat t ON s.query_id = t.query_id AND s.path = t.path AND (s.qualifier IS NULL OR s.qualifier = coalesce(t.alias, t.name))
  JOIN cat c ON lower(c.table_name) = t.name
  UNION ALL
  SELECT query_id, star_no, shown, 1000000 + output, table_name, name FROM star_out_resolved WHERE table_name IS NOT NULL
),
t3 AS (
  SELECT query_id, w.table_name, w.column_name, NULL::VARCHAR AS value, count(*) AS touches FROM (
    SELECT query_id, star_no, shown, arg_max({{'table_name': table_name, 'column_name': column_name}}, place) AS w
    FROM star_shown GROUP BY ALL) GROUP BY ALL
),
t4 AS (SELECT query_id, table_name, name AS column_name, value, count(*) AS touches FROM eq_resolved WHERE table_name IS NOT NULL GROUP BY ALL),
t5 AS (SELECT query_id, table_name, name AS column_name, value, count(*) AS touches FROM in_resolved
  WHERE table_name IS NOT NULL AND quoted_identifier GROUP BY ALL),
touches AS (
  SELECT query_id, table_name, column_name, value, CAST(sum(touches) AS BIGINT) AS touches
  FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5)
  GROUP BY ALL
)"""
