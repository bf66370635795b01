"""Question log, touch points and text functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slink.functions import text
from slink.operators import documents, question_log, touches
from slink.plans import bindings as b
from slink.plans import log_bindings as lb
from slink.plans.registry import query

GOLD = f"WITH {lb.GROUPS_CTE}"
ASKED = f"WITH {lb.ASKED_CTE}"
LOGGED = f"WITH {b.CATALOG_CTE}, {lb.LOG_CTE}"


def gold(spark, sf_dir):
    return lb.groups(spark, sf_dir), lb.questions(spark, sf_dir)


@query(
    "s5_read_gold_questions",
    GOLD + "SELECT group_id, question_id, text FROM groups JOIN questions USING (group_id) WHERE status = 'CORRECT'",
)
def s5(spark, sf_dir):
    return question_log.read_gold_questions(*gold(spark, sf_dir)).select("group_id", "question_id", "text")


@query("p15_effective_sql", ASKED + "SELECT question_id, CASE WHEN answer IS NULL THEN sql ELSE answer END AS effective FROM asked")
def p15(spark, sf_dir):
    log = lb.asked(spark, sf_dir)
    user_sql = F.coalesce("answer", F.lit(""))
    return log.select("question_id", text.effective_sql(user_sql, F.col("sql")).alias("effective"))


@query(
    "p16_is_blank",
    GOLD + "SELECT group_id, gold_sql IS NULL OR trim(gold_sql) = '' AS blank, gold_sql IS NULL OR gold_sql = '' AS empty FROM groups",
)
def p16(spark, sf_dir):
    sql = F.col("gold_sql")
    return lb.groups(spark, sf_dir).select("group_id", text.is_blank(sql).alias("blank"), text.is_empty(sql).alias("empty"))


@query("p17_exclude_completed", GOLD + "SELECT group_id, status FROM groups WHERE status <> 'CORRECT'")
def p17(spark, sf_dir):
    return question_log.exclude_completed(lb.groups(spark, sf_dir)).select("group_id", "status")


@query(
    "p19_gold_sql_or_generated",
    GOLD
    + """SELECT g.group_id, coalesce(CASE WHEN trim(gold_sql) = '' THEN NULL ELSE gold_sql END, q.generated_sql) AS sql
    FROM groups g LEFT JOIN (SELECT group_id, arg_max(generated_sql, created) AS generated_sql FROM questions GROUP BY group_id) q
      USING (group_id)""",
)
def p19(spark, sf_dir):
    return question_log.gold_sql_or_generated(*gold(spark, sf_dir)).select("group_id", "sql")


@query(
    "j8_group_questions",
    GOLD
    + """SELECT group_id, question_id, gold_sql FROM groups JOIN questions USING (group_id)
    WHERE gold_sql <> '' AND data_source_id IS NOT NULL""",
)
def j8(spark, sf_dir):
    return question_log.group_questions(*gold(spark, sf_dir)).select("group_id", "question_id", "gold_sql")


@query(
    "j10_unlabelled_questions",
    GOLD
    + """SELECT arg_max(question_id, created * 1000000000 + question_id) AS question_id, text, max(created) AS created FROM questions
    WHERE group_id NOT IN (SELECT group_id FROM groups) GROUP BY text""",
)
def j10(spark, sf_dir):
    groups, asked = gold(spark, sf_dir)
    evaluated = asked.join(groups, "group_id", "left_semi").select("question_id")
    return question_log.unlabelled_questions(asked, evaluated)


@query(
    "j12_cache_lookup",
    """WITH requests AS (SELECT doc_id, text, sha256(text) AS key FROM documents),
    cache AS (SELECT DISTINCT sha256(text) AS key, length(text) AS cached_value FROM documents JOIN labels USING (doc_id)),
    computed AS (SELECT key, any_value(length(text)) AS v FROM requests WHERE key NOT IN (SELECT key FROM cache) GROUP BY key)
    SELECT r.doc_id, r.key, c.key IS NOT NULL AS hit, coalesce(c.cached_value, m.v) AS result
    FROM requests r LEFT JOIN cache c USING (key) LEFT JOIN computed m USING (key)""",
)
def j12(spark, sf_dir):
    docs, labels = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")
    requests = docs.select("doc_id", "text")
    cache = (
        docs.join(labels, "doc_id", "left_semi")
        .groupBy(text.content_hash(F.col("text")).alias("key"))
        .agg(F.max(F.length("text")).alias("cached_value"))
    )
    looked, misses = documents.cache_lookup(requests, cache, "text")
    computed = misses.select("key", F.length("text").alias("cached_value"))
    grown = documents.append_to_cache(cache, computed)
    found = looked.select("doc_id", "key", "hit")
    return found.join(grown, "key").select("doc_id", "key", "hit", F.col("cached_value").alias("result"))


@query(
    "a14_section_tokens",
    r"""SELECT conv_id AS question_id, CAST(sum(n) AS BIGINT) AS used_tokens, CAST(500 - sum(n) AS BIGINT) AS remaining_tokens, sum(n) > 500 AS over_budget
    FROM (SELECT conv_id, len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS n FROM conversations) GROUP BY conv_id""",
)
def a14(spark, sf_dir):
    sections = b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), "text")
    return question_log.section_tokens(sections, 500)


@query(
    "a15_char_entropy",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL),
    t AS (SELECT doc_id, sum(n) AS m FROM c GROUP BY doc_id)
    SELECT doc_id, round(-sum(n / m * log2(n / m)), 6) + 0.0 AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""",
)
def a15(spark, sf_dir):
    return question_log.char_entropy(b.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "a17_feedback_summary",
    ASKED
    + """SELECT CASE WHEN sql IS NULL THEN 'UNGENERATED' WHEN failed THEN 'INVALID' ELSE coalesce(answer, 'UNANSWERED') END AS state,
      count(*) AS questions FROM asked GROUP BY 1""",
)
def a17(spark, sf_dir):
    return question_log.feedback_summary(lb.asked(spark, sf_dir))


@query(
    "a18_unique_group_questions",
    ASKED
    + """SELECT group_id, question_id, text FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id, text ORDER BY created, question_id) AS rn FROM asked) WHERE rn = 1""",
)
def a18(spark, sf_dir):
    return question_log.unique_group_questions(lb.asked(spark, sf_dir))


@query(
    "w9_latest_question_per_group",
    GOLD
    + """SELECT group_id, question_id, generated_sql FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created DESC, question_id DESC) AS rn FROM questions) WHERE rn = 1""",
)
def w9(spark, sf_dir):
    return question_log.latest_question_per_group(lb.questions(spark, sf_dir)).select("group_id", "question_id", "generated_sql")


@query(
    "w10_preview",
    GOLD
    + """SELECT group_id, string_agg(text, ', ' ORDER BY created) AS preview FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created) AS rn FROM questions) WHERE rn <= 3 GROUP BY group_id""",
)
def w10(spark, sf_dir):
    return question_log.preview(lb.questions(spark, sf_dir))


@query(
    "w11_latest_per_text",
    ASKED
    + """SELECT question_id, text, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY created DESC, question_id DESC) AS rn FROM asked) WHERE rn = 1""",
)
def w11(spark, sf_dir):
    newest = question_log.latest_per_text(lb.asked(spark, sf_dir))
    return newest.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query("o3_question_history", ASKED + "SELECT question_id, text FROM asked WHERE user_id = 8 AND data_source_id = 2")
def o3(spark, sf_dir):
    return question_log.question_history(lb.asked(spark, sf_dir), 8, 2).select("question_id", "text")


@query(
    "o5_next_open_group",
    GOLD
    + """SELECT group_id, status FROM groups WHERE status <> 'CORRECT' AND group_id IN (SELECT group_id FROM questions)
    ORDER BY created DESC, group_id DESC LIMIT 1""",
)
def o5(spark, sf_dir):
    return question_log.next_open_group(*gold(spark, sf_dir)).select("group_id", "status")


@query("f1_content_hash", "SELECT doc_id, sha256(text) AS key FROM documents")
def f1(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("key"))


@query(
    "f2_cache_key",
    ASKED + "SELECT question_id, 'query-cache-' || data_source_id || '-' || sha256(text) AS key FROM asked",
)
def f2(spark, sf_dir):
    log = lb.asked(spark, sf_dir)
    return log.select("question_id", text.cache_key(F.col("data_source_id"), F.col("text")).alias("key"))


@query(
    "f5_count_tokens",
    r"SELECT page_id, len(regexp_extract_all(html, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS tokens FROM pages",
)
def f5(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", text.count_tokens(F.col("html")).alias("tokens"))


@query(
    "f10_long_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || CASE WHEN day(o_orderdate) BETWEEN 10 AND 19 THEN 'th'
      WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd'
      ELSE 'th' END || strftime(o_orderdate, ', %Y') AS long_date FROM orders""",
)
def f10(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", text.long_date(F.col("o_orderdate")).alias("long_date"))


# Model answers: plain text, a fenced block, and a fenced block with a language tag, by turn.
ANSWERS_SQL = """(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Here: ```sql' || chr(10) || text || '``` and ```x```'
  WHEN 1 THEN '```' || text || '```' ELSE text END AS answer FROM conversations)"""


@query(
    "f11_extract_code_block",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(answer, '(?s)```(?:sql)?(.*?)```')
      THEN regexp_extract(answer, '(?s)```(?:sql)?(.*?)```', 1) ELSE answer END AS code FROM {ANSWERS_SQL}""",
)
def f11(spark, sf_dir):
    slot = F.col("turn") % 3
    fence = F.lit("```")
    answer = (
        F.when(slot == 0, F.concat(F.lit("Here: ```sql\n"), "text", F.lit("``` and ```x```")))
        .when(slot == 1, F.concat(fence, "text", fence))
        .otherwise(F.col("text"))
    )
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return turns.select("conv_id", "turn", text.extract_code_block(F.col("answer")).alias("code"))


@query(
    "f12_backticks_to_quotes",
    """SELECT p_partkey, 'SELECT "' || p_name || '" FROM "' || p_brand || '"' AS sql FROM part""",
)
def f12(spark, sf_dir):
    tick = F.lit("`")
    sql = F.concat(F.lit("SELECT `"), "p_name", F.lit("` FROM "), tick, "p_brand", tick)
    return b.table(spark, sf_dir, "part").select("p_partkey", text.backticks_to_quotes(sql).alias("sql"))


# SQL texts with and without NOW() and LIMIT, one per event.
LOGGED_TEXT_SQL = """(SELECT event_id, CASE event_id % 4
  WHEN 0 THEN 'SELECT ' || user_id || ' WHERE ts > NOW() - 1' WHEN 1 THEN 'SELECT date_trunc(NOW()), xNOW() FROM ' || event_type
  WHEN 2 THEN 'SELECT a FROM t LIMIT ' || user_id ELSE 'SELECT a FROM t limit ' || user_id END AS sql FROM events)"""


def logged_text(spark, sf_dir):
    slot, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    sql = (
        F.when(slot == 0, F.concat(F.lit("SELECT "), user, F.lit(" WHERE ts > NOW() - 1")))
        .when(slot == 1, F.concat(F.lit("SELECT date_trunc(NOW()), xNOW() FROM "), "event_type"))
        .when(slot == 2, F.concat(F.lit("SELECT a FROM t LIMIT "), user))
        .otherwise(F.concat(F.lit("SELECT a FROM t limit "), user))
    )
    return b.table(spark, sf_dir, "events").select("event_id", sql.alias("sql"))


@query(
    "f13_normalise_now",
    f"SELECT event_id, replace(replace(sql, ' NOW()', ' CURRENT_TIMESTAMP()'), '(NOW()', '(CURRENT_TIMESTAMP()') AS sql FROM {LOGGED_TEXT_SQL}",
)
def f13(spark, sf_dir):
    return logged_text(spark, sf_dir).select("event_id", text.normalise_now(F.col("sql")).alias("sql"))


@query(
    "f14_ensure_limit_text",
    f"SELECT event_id, CASE WHEN contains(sql, ' LIMIT ') THEN sql ELSE sql || ' LIMIT 100' END AS sql FROM {LOGGED_TEXT_SQL}",
)
def f14(spark, sf_dir):
    return logged_text(spark, sf_dir).select("event_id", text.ensure_limit_text(F.col("sql")).alias("sql"))


@query(
    "f16_flatten",
    """SELECT l_orderkey, string_agg(l_returnflag || ',' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS items
    FROM lineitem GROUP BY l_orderkey""",
)
def f16(spark, sf_dir):
    pair = F.struct("l_linenumber", "l_partkey", F.array("l_returnflag", "l_linestatus").alias("v"))
    nested = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("lines"))
    lists = F.transform("lines", lambda x: x["v"])
    return nested.select("l_orderkey", F.array_join(F.flatten(lists), ",").alias("items"))


# Priorities of an order written twice around a blank: only the first of each counts.
@query(
    "a9_ordered_unique",
    """SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS hints FROM orders""",
)
def a9(spark, sf_dir):
    hints = F.array("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(""), F.lit(None), "o_orderpriority")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.ordered_unique(hints), "|").alias("hints"))


# ---- touch points ----


def log(spark, sf_dir):
    return lb.query_log(spark, sf_dir), b.columns(spark, sf_dir)


@query("t1_table_touches", LOGGED + "SELECT query_id, table_name, touches FROM t1")
def t1(spark, sf_dir):
    return touches.table_touches(lb.query_log(spark, sf_dir))


@query("t2_column_touches", LOGGED + "SELECT query_id, table_name, column_name, touches FROM t2")
def t2(spark, sf_dir):
    return touches.column_touches(*log(spark, sf_dir))


@query(
    "t2_unresolved_references",
    LOGGED + "SELECT query_id, qualifier, name AS column_name FROM columns_resolved WHERE table_name IS NULL",
)
def t2_unresolved(spark, sf_dir):
    return touches.unresolved_references(*log(spark, sf_dir))


@query("t3_star_touches", LOGGED + "SELECT query_id, table_name, column_name, touches FROM t3")
def t3(spark, sf_dir):
    return touches.star_touches(*log(spark, sf_dir))


@query("t4_value_touches", LOGGED + "SELECT query_id, table_name, column_name, value, touches FROM t4")
def t4(spark, sf_dir):
    return touches.value_touches(*log(spark, sf_dir))


@query("t5_in_value_touches", LOGGED + "SELECT query_id, table_name, column_name, value, touches FROM t5")
def t5(spark, sf_dir):
    return touches.in_value_touches(*log(spark, sf_dir))


@query(
    "t6_alias_touches",
    LOGGED
    + """SELECT query_id, table_name, name AS column_name, CAST(sum(times - 1) AS BIGINT) AS touches
    FROM columns_resolved WHERE table_name IS NOT NULL GROUP BY ALL HAVING sum(times - 1) > 0""",
)
def t6(spark, sf_dir):
    return touches.alias_touches(*log(spark, sf_dir))


@query(
    "t7_workload_touches",
    LOGGED
    + """SELECT query_id, CASE WHEN value IS NOT NULL THEN 'value' WHEN column_name IS NOT NULL THEN 'column' ELSE 'table' END AS level,
      count(*) AS elements FROM touches GROUP BY ALL""",
)
def t7(spark, sf_dir):
    return touches.workload_touches(touches.touch_counts(*log(spark, sf_dir)))


@query("a5_touch_counts", LOGGED + "SELECT query_id, table_name, column_name, value, touches FROM touches")
def a5(spark, sf_dir):
    return touches.touch_counts(*log(spark, sf_dir))


RESOLVED = f"""{LOGGED}, ids AS (
  SELECT t.query_id, t.table_name, t.column_name, t.value, n.table_id, c.column_id FROM touches t
  LEFT JOIN (SELECT DISTINCT table_id, lower(table_name) AS table_name FROM cat) n USING (table_name)
  LEFT JOIN cat c ON c.table_id = n.table_id AND lower(c.column_name) = t.column_name)"""


@query("j1_resolve_element_ids", RESOLVED + "SELECT query_id, value, table_id, column_id, true AS resolved FROM ids")
def j1(spark, sf_dir):
    log_df, columns = log(spark, sf_dir)
    resolved = touches.resolve_element_ids(touches.touch_counts(log_df, columns), columns)
    return resolved.select("query_id", "value", "table_id", "column_id", "resolved")


@query(
    "j2_element_names",
    RESOLVED + "SELECT query_id, value, upper(table_name) AS table_name, upper(column_name) AS column_name FROM ids",
)
def j2(spark, sf_dir):
    log_df, columns = log(spark, sf_dir)
    ids = touches.resolve_element_ids(touches.touch_counts(log_df, columns), columns).select("query_id", "value", "table_id", "column_id")
    return touches.element_names(ids, columns).select("query_id", "value", "table_name", "column_name")
