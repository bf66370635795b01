"""Result comparison, sinks and streams over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slink.functions import text
from slink.operators import evaluation
from slink.operators.grouping import number_rows
from slink.plans import bindings as b
from slink.plans.registry import query
from slink.sources import stores
from slink.sources.shared import new_path
from slink.sources.tables import cap_rows, run_sql

# Each customer is a question whose gold result is the list of its orders. The new result is
# the same, a changed value, extra rows, missing rows, or another order, by the customer number.
OLD_ROWS_SQL = """SELECT o_custkey AS case_id, o_orderkey AS place, o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS status FROM orders"""
NEW_ROWS_SQL = """SELECT o_custkey AS case_id, CASE WHEN o_custkey % 5 = 4 THEN -o_orderkey ELSE o_orderkey END AS place, o_orderkey AS k,
    CAST(o_totalprice + CASE WHEN o_custkey % 5 = 1 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS price, o_orderstatus AS status
  FROM orders WHERE NOT (o_custkey % 5 = 3 AND o_orderstatus = 'P')
  UNION ALL SELECT o_custkey, o_orderkey + 1000000000000, o_orderkey, CAST(o_totalprice AS DOUBLE), o_orderstatus FROM orders WHERE o_custkey % 5 = 2"""

CELLS = "array_to_string(list_sort([CAST(k AS VARCHAR), printf('%.9e', price + 0.0), status]), '|')"
RESULTS_CTE = f"""
old_r AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY place) - 1 AS row_idx, {CELLS} AS cells FROM ({OLD_ROWS_SQL})),
new_r AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY place) - 1 AS row_idx, {CELLS} AS cells FROM ({NEW_ROWS_SQL})),
cases AS (SELECT c_custkey AS case_id, c_nationkey AS group_id, c_custkey AS question_id, c_acctbal FROM customer),
pairs AS (SELECT o.case_id, o.row_idx, o.cells AS old_cells, n.cells AS new_cells FROM old_r o LEFT JOIN new_r n USING (case_id, row_idx)),
matches AS (
  SELECT c.*, coalesce(m, true) AS matched FROM cases c LEFT JOIN (
    SELECT case_id, bool_and(coalesce(old_cells = new_cells, false)) AS m FROM pairs GROUP BY case_id) USING (case_id)
),
bad_groups AS (SELECT n_nationkey AS group_id FROM nation WHERE n_regionkey = 3),
scored AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(matched AS INT) END AS score FROM matches),
report AS (
  SELECT group_id, question_id, score FROM scored WHERE group_id NOT IN (SELECT group_id FROM bad_groups)
  UNION ALL SELECT DISTINCT group_id, NULL, 0 FROM cases WHERE group_id IN (SELECT group_id FROM bad_groups)
)"""
RESULTS = f"WITH {RESULTS_CTE}"
SLICE = 1 << 16


def _rows(df, place):
    """Long result rows with their position; a case of any size is numbered in slices of the order key."""
    keyed = df.withColumn("place", place)
    cells = text.canonical_row(keyed, ["o_orderkey", "o_totalprice", "o_orderstatus"])
    rows = keyed.select(F.col("o_custkey").alias("case_id"), "place", cells.alias("cells"))
    return number_rows(rows, ["case_id"], F.floor(F.col("place") / SLICE), [F.col("place")])


def old_result(spark, sf_dir):
    return _rows(b.table(spark, sf_dir, "orders"), F.col("o_orderkey"))


def new_result(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    kind, status = F.col("o_custkey") % 5, F.col("o_orderstatus")
    extra = orders.filter(kind == 2).withColumn("_shift", F.lit(1_000_000_000_000))
    changed = (
        orders.filter(~((kind == 3) & (status == "P")))
        .withColumn("o_totalprice", F.col("o_totalprice") + F.when((kind == 1) & (status == "F"), 1).otherwise(0))
        .withColumn("_shift", F.lit(0).cast("long"))
    )
    place = F.when((kind == 4) & (F.col("_shift") == 0), -F.col("o_orderkey")).otherwise(F.col("o_orderkey") + F.col("_shift"))
    return _rows(changed.unionByName(extra), place)


def cases(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("question_id"), "c_acctbal"
    )


def failed_cases(spark, sf_dir):
    """Customers in debt stand for queries that failed."""
    return cases(spark, sf_dir).filter(F.col("c_acctbal") < 0).select("case_id")


def failed_groups(spark, sf_dir):
    return b.table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 3).select(F.col("n_nationkey").alias("group_id"))


def joined(cells):
    return F.array_join(cells, "|")


@query("f17_canonical_row", f"SELECT k AS o_orderkey, {CELLS} AS cells FROM ({OLD_ROWS_SQL})")
def f17(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    cells = text.canonical_row(orders, ["o_orderstatus", "o_totalprice", "o_orderkey"])
    return orders.select("o_orderkey", joined(cells).alias("cells"))


@query("j14_positional_row_join", RESULTS + "SELECT case_id, row_idx, old_cells, new_cells FROM pairs")
def j14(spark, sf_dir):
    pairs = evaluation.positional_row_join(old_result(spark, sf_dir), new_result(spark, sf_dir))
    return pairs.select("case_id", "row_idx", joined(F.col("old_cells")).alias("old_cells"), joined(F.col("new_cells")).alias("new_cells"))


@query("v1_result_match", RESULTS + "SELECT case_id, matched FROM matches")
def v1(spark, sf_dir):
    matched = evaluation.result_match(cases(spark, sf_dir), old_result(spark, sf_dir), new_result(spark, sf_dir))
    return matched.select("case_id", "matched")


@query(
    "v1_result_match_strict",
    RESULTS
    + """SELECT case_id, coalesce(m, true) AS matched FROM cases LEFT JOIN (
      SELECT case_id, bool_and(coalesce(o.cells = n.cells, false)) AS m FROM old_r o FULL JOIN new_r n USING (case_id, row_idx) GROUP BY case_id) USING (case_id)""",
)
def v1_strict(spark, sf_dir):
    matched = evaluation.result_match(cases(spark, sf_dir), old_result(spark, sf_dir), new_result(spark, sf_dir), strict=True)
    return matched.select("case_id", "matched")


@query(
    "v2_result_diff",
    RESULTS
    + """SELECT case_id, row_idx, o.cells AS old_cells, n.cells AS new_cells FROM old_r o FULL JOIN new_r n USING (case_id, row_idx)
    WHERE o.cells IS DISTINCT FROM n.cells""",
)
def v2(spark, sf_dir):
    diff = evaluation.result_diff(old_result(spark, sf_dir), new_result(spark, sf_dir))
    return diff.select("case_id", "row_idx", joined(F.col("old_cells")).alias("old_cells"), joined(F.col("new_cells")).alias("new_cells"))


@query("v3_error_cases", RESULTS + "SELECT case_id, matched, score FROM scored")
def v3(spark, sf_dir):
    matched = evaluation.result_match(cases(spark, sf_dir), old_result(spark, sf_dir), new_result(spark, sf_dir))
    return evaluation.error_cases(matched, failed_cases(spark, sf_dir)).select("case_id", "matched", "score")


def report(spark, sf_dir):
    return evaluation.evaluation_report(
        cases(spark, sf_dir),
        old_result(spark, sf_dir),
        new_result(spark, sf_dir),
        failed_groups(spark, sf_dir),
        failed_cases(spark, sf_dir),
    )


@query("v4_evaluation_report", RESULTS + "SELECT group_id, question_id, score FROM report")
def v4(spark, sf_dir):
    return report(spark, sf_dir)


@query(
    "v4_report_summary",
    RESULTS + "SELECT round(avg(score), 6) AS accuracy, count(*) AS cases FROM report",
)
def v4_summary(spark, sf_dir):
    return evaluation.accuracy(report(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("a10_accuracy", "SELECT round(avg(quality), 6) AS accuracy, count(*) AS cases FROM labels")
def a10(spark, sf_dir):
    scores = b.table(spark, sf_dir, "labels").select(F.col("quality").alias("score"))
    return evaluation.accuracy(scores).withColumn("accuracy", F.round("accuracy", 6))


@query("a11_outcome_counts", "SELECT CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS outcome, count(*) AS cases FROM labels GROUP BY 1")
def a11(spark, sf_dir):
    return evaluation.outcome_counts(b.table(spark, sf_dir, "labels").select(F.col("quality").alias("score")))


@query(
    "s10_evaluation_store",
    RESULTS
    + """SELECT s.case_id, s.score = 1 AS correct, count(*) AS compared FROM scored s
    JOIN (SELECT case_id, row_idx FROM old_r UNION SELECT case_id, row_idx FROM new_r) r USING (case_id) GROUP BY ALL""",
)
def s10(spark, sf_dir):
    old = stores.materialize(old_result(spark, sf_dir), "old-result")
    new = stores.materialize(new_result(spark, sf_dir), "new-result")
    scored = evaluation.error_cases(evaluation.result_match(cases(spark, sf_dir), old, new), failed_cases(spark, sf_dir))
    path = new_path(spark, "evaluation")
    stores.write_evaluation(scored, evaluation.positional_row_join(old, new, keep_extra=True), path)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("case_id", F.col("correct").cast("boolean").alias("correct")).agg(F.count("*").alias("compared"))


@query(
    "s3_run_sql",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority""",
)
def s3(spark, sf_dir):
    statement = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority"
    return run_sql(spark, statement, {"orders": b.table(spark, sf_dir, "orders")})


@query("s4_cap_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def s4(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cap_rows(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("s8_write_csv", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name || ', \"x\"' || chr(13) || chr(10) || 'y' END AS note FROM nation")
def s8(spark, sf_dir):
    note = F.when(F.col("n_regionkey") != 2, F.concat("n_name", F.lit(', "x"\r\ny')))
    noted = b.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", note.alias("note"))
    path = new_path(spark, "csv")
    stores.write_csv(noted, path)
    return stores.read_csv(spark, path, noted.schema)


@query("s9_write_json", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS region FROM nation")
def s9(spark, sf_dir):
    region = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("region")
    nation = b.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", region)
    path = new_path(spark, "json")
    stores.write_json(nation, path)
    return spark.read.schema(nation.schema).json(path)
