"""Search, ranking, packing and training queries over the vector index."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions import vectors
from slink.operators import documents as docs_op
from slink.operators import packing, question_log, ranking, sampling, search, training
from slink.plans import bindings as b
from slink.plans import log_bindings as lb
from slink.plans.catalog_queries import LITERAL_SQL, TOKENS_SQL, TYPE_SQL
from slink.plans.link_schema import few_shot_rankings, link_schema
from slink.plans.registry import query
from slink.sources.shared import new_path
from slink.sources.stores import materialize, read_index, read_training, write_index, write_training

HITS = f"WITH {b.INDEX_CTE}, {b.hits_cte(fixed.WEIGHTED_RANK_LIMITS)}"
RANKED = f"WITH {b.INDEX_CTE}, {b.WEIGHTED_CTE}"
DEFAULT_NAMES = "(KEY|_ID)$"
BUDGET = 150


WEIGHTED = search.limits_for(fixed.WEIGHTED_RANK_LIMITS)


def hits(spark, sf_dir, k=WEIGHTED):
    return search.exact_knn(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), k)


def element_hits(spark, sf_dir, k=WEIGHTED):
    return search.exact_knn(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), k, carry=ranking.ELEMENT)


def element_scores(spark, sf_dir, fold="highest"):
    return search.element_knn(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), WEIGHTED, ranking.ELEMENT, fold)


def ranked(spark, sf_dir):
    return ranking.weighted_rank(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir))


RANK_COLUMNS = ["question_id", "table_id", "column_id", "value", "score", "rank"]


@query(
    "f3_l2_normalize",
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS e FROM embeddings),
    n AS (SELECT vec_id, CASE WHEN list_dot_product(e, e) = 0 THEN e ELSE list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) END AS u FROM v)
    SELECT vec_id, round(list_dot_product(u, u), 6) AS squared, round(list_sum(u), 6) + 0.0 AS total FROM n""",
)
def f3(spark, sf_dir):
    # Scaled by the label, so that label 0 gives zero vectors.
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    unit = b.table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return unit.select(
        "vec_id",
        F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("squared"),
        (F.round(total, 6) + 0.0).alias("total"),
    )


@query(
    "f4_dot",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], z.embedding::DOUBLE[]), 4) + 0.0 AS score
    FROM embeddings a JOIN embeddings z ON z.vec_id = a.vec_id + 1""",
)
def f4(spark, sf_dir):
    left = b.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("z"))
    pairs = left.join(right, "vec_id")
    return pairs.select("vec_id", (F.round(vectors.dot(F.col("a"), F.col("z")), 4) + 0.0).alias("score"))


@query("j11_similarity_join", HITS + "SELECT question_id, index_name, vec_id, score FROM hits")
def j11(spark, sf_dir):
    best = search.full_knn(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), WEIGHTED, once=True)
    return best.select("question_id", "index_name", "vec_id", search.shown_score())


@query(
    "w2_top_k_hits",
    f"{HITS} SELECT question_id, index_name, vec_id, score, hit_rank AS rank FROM hits",
)
def w2(spark, sf_dir):
    return hits(spark, sf_dir).drop("data_source_id")


@query(
    "m3_exact_knn",
    f"""WITH {b.INDEX_CTE} SELECT question_id, vec_id, round(score, 4) + 0.0 AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 50""",
)
def m3(spark, sf_dir):
    flat = b.index_documents(spark, sf_dir).withColumn("index_name", F.lit("all"))
    return search.exact_knn(b.questions(spark, sf_dir), flat, 50).select("question_id", "vec_id", "score", "rank")


@query("j3_hits_to_elements", HITS + "SELECT question_id, index_name, vec_id, table_id, column_id, value, score FROM hits")
def j3(spark, sf_dir):
    return element_hits(spark, sf_dir).select("question_id", "index_name", "vec_id", "table_id", "column_id", "value", "score")


@query(
    "p14_drop_missing_hits",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS vec_id FROM events WHERE event_type <> 'error'",
)
def p14(spark, sf_dir):
    found = F.when(F.col("event_type") == "error", -1).otherwise(F.col("user_id"))
    imported = b.table(spark, sf_dir, "events").select("event_id", found.alias("vec_id"))
    return search.drop_missing_hits(imported)


WEIGHTED_HITS = f"""weighted_hits AS (
  SELECT *, CASE WHEN round(score * {b.WEIGHT_SQL}, 6) = 0 THEN 0.0 ELSE round(score * {b.WEIGHT_SQL}, 6) END AS weighted FROM hits)"""


@query("f18_weight_scores", f"{HITS}, {WEIGHTED_HITS} SELECT question_id, index_name, vec_id, weighted AS score FROM weighted_hits")
def f18(spark, sf_dir):
    return ranking.weight_scores(element_hits(spark, sf_dir)).select("question_id", "index_name", "vec_id", "score")


@query("a6_best_score", HITS + "SELECT question_id, table_id, column_id, value, max(score) AS score FROM hits GROUP BY ALL")
def a6(spark, sf_dir):
    return ranking.best_score(element_scores(spark, sf_dir))


LOWS = ", ".join(f"min(score) FILTER (index_name = '{n}') AS {n}_score" for n in fixed.ALL_INDEXES)


@query("a7_index_scores", HITS + f"SELECT question_id, table_id, column_id, value, {LOWS} FROM hits GROUP BY question_id, table_id, column_id, value")
def a7(spark, sf_dir):
    return ranking.index_scores(element_scores(spark, sf_dir, "lowest"))


@query(
    "a8_dedup_rankings",
    HITS
    + f""", best AS (SELECT question_id, table_id, column_id, value, max(score) AS score FROM hits GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {b.ELEMENT_ORDER_SQL}) AS rank FROM best""",
)
def a8(spark, sf_dir):
    return ranking.dedup_rankings(element_scores(spark, sf_dir)).select(*RANK_COLUMNS)


@query(
    "o2_order_rankings",
    HITS
    + f"""SELECT question_id, table_id, column_id, value, score,
      row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {b.ELEMENT_ORDER_SQL}) AS rank FROM hits""",
)
def o2(spark, sf_dir):
    """All hits of all nine indexes; an element can stand in the list more than once."""
    return ranking.order_hit_lists(element_scores(spark, sf_dir, "all")).select(*RANK_COLUMNS)


@query("u1_union_levels", HITS + f"SELECT {b.LEVEL_SQL} AS level, question_id, count(*) AS elements, min(score) AS low, max(score) AS high FROM (SELECT question_id, table_id, column_id, value, max(score) AS score FROM hits GROUP BY ALL) GROUP BY ALL")
def u1(spark, sf_dir):
    levels = []
    for kind, names in zip(ranking.LEVELS, (fixed.TABLE_INDEXES, fixed.COLUMN_INDEXES, fixed.VALUE_INDEXES), strict=True):
        # Each level searches its own indexes.
        index = b.index_documents(spark, sf_dir).filter(F.col("index_name").isin(names))
        found = search.element_knn(b.questions(spark, sf_dir), index, WEIGHTED, ranking.ELEMENT)
        levels.append(ranking.best_score(found).withColumn("level", F.lit(kind)))
    merged = ranking.union_levels(*levels)
    return merged.groupBy("level", "question_id").agg(
        F.count("*").alias("elements"), F.min("score").alias("low"), F.max("score").alias("high")
    )


LEARNED_FEATURES = f"WITH {b.INDEX_CTE}, {b.features_cte(fixed.LEARNED_RANK_LIMITS)}"
TRAINING_FEATURES = f"WITH {b.INDEX_CTE}, {b.features_cte(fixed.TRAINING_RANK_LIMITS)}"
NINE = ", ".join(fixed.ALL_SCORES)


def features(spark, sf_dir, limits=fixed.LEARNED_RANK_LIMITS):
    return ranking.score_features(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), limits)


@query("j4_copy_table_scores", LEARNED_FEATURES + f"SELECT question_id, table_id, column_id, {', '.join(fixed.TABLE_SCORES)} FROM features WHERE value IS NULL AND column_id IS NOT NULL")
def j4(spark, sf_dir):
    columns = features(spark, sf_dir).filter(ranking.level() == "column")
    return columns.select("question_id", "table_id", "column_id", *fixed.TABLE_SCORES)


@query(
    "m5_score_features",
    f"WITH {b.INDEX_CTE}, {b.features_cte(fixed.TRAINING_RANK_LIMITS)} SELECT question_id, table_id, column_id, value, {NINE} FROM features",
)
def m5(spark, sf_dir):
    return features(spark, sf_dir, fixed.TRAINING_RANK_LIMITS)


def _vector_sql(kind):
    return "concat_ws('|', " + ", ".join(f"CAST(CAST(coalesce({n}, 0) AS DECIMAL(9,4)) AS VARCHAR)" for n in ranking.FEATURES[kind]) + ")"


VECTOR_SQL = f"CASE {b.LEVEL_SQL} WHEN 'table' THEN {_vector_sql('table')} WHEN 'column' THEN {_vector_sql('column')} ELSE {_vector_sql('value')} END"


def shown(vector):
    return F.array_join(F.transform(vector, lambda x: x.cast("decimal(9,4)").cast("string")), "|")


@query("f19_feature_vector", LEARNED_FEATURES + f"SELECT question_id, table_id, column_id, value, {VECTOR_SQL} AS features FROM features")
def f19(spark, sf_dir):
    wide = features(spark, sf_dir)
    return wide.select("question_id", *ranking.ELEMENT, shown(ranking.feature_vectors()).alias("features"))


# ---- networks with fixed weights ----


def fixed_model(kind: str) -> ranking.MlpWeights:
    """Weights from a plain rule, the same in Spark and SQL."""
    inputs, seed = len(ranking.FEATURES[kind]), {"table": 1, "column": 2, "value": 3}[kind]
    hidden = range(fixed.HIDDEN_UNITS)
    w1 = np.array([[round(math.sin(1 + 7 * h + 3 * i + seed) / 2, 4) for i in range(inputs)] for h in hidden])
    b1 = np.array([round(math.cos(h + seed) / 10, 4) for h in hidden])
    w2 = np.array([round(math.sin(5 * h + seed) / 5, 4) for h in hidden])
    return ranking.MlpWeights(w1, b1, w2, 0.05 * seed)


MODELS = {kind: fixed_model(kind) for kind in ranking.LEVELS}


def _network_sql(kind, x):
    m = MODELS[kind]
    units = ", ".join(
        "{'w': [" + ", ".join(f"{float(v)}::DOUBLE" for v in m.w1[h]) + f"], 'b': {float(m.b1[h])}::DOUBLE, 'v': {float(m.w2[h])}::DOUBLE" + "}"
        for h in range(fixed.HIDDEN_UNITS)
    )
    return f"({m.b2} + list_sum(list_transform([{units}], lambda u: greatest(0, list_dot_product(u.w, {x}) + u.b) * u.v)))"


def _inputs_sql(kind):
    return "[" + ", ".join(f"coalesce({n}, 0)::DOUBLE" for n in ranking.FEATURES[kind]) + "]"


NETWORK_SQL = (
    f"CASE {b.LEVEL_SQL} WHEN 'table' THEN {_network_sql('table', _inputs_sql('table'))} "
    f"WHEN 'column' THEN {_network_sql('column', _inputs_sql('column'))} ELSE {_network_sql('value', _inputs_sql('value'))} END"
)
SCALED_SQL = f"round({NETWORK_SQL} * CASE WHEN value IS NULL THEN 1.0 ELSE 0.9 END, 6) + 0.0"


@query("m6_mlp_score", LEARNED_FEATURES + f"SELECT question_id, table_id, column_id, value, {SCALED_SQL} AS score FROM features")
def m6(spark, sf_dir):
    scored = ranking.mlp_score(features(spark, sf_dir), MODELS)
    return scored.select("question_id", *ranking.ELEMENT, (F.col("score") + 0.0).alias("score"))


LEARNED_CTE = f"""{b.features_cte(fixed.LEARNED_RANK_LIMITS)},
learned AS (SELECT question_id, table_id, column_id, value, {SCALED_SQL} AS score FROM features),
learned_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {b.ELEMENT_ORDER_SQL}) AS rank FROM learned)"""


def learned(spark, sf_dir):
    return ranking.learned_rank(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir), MODELS)


@query("m11_learned_rank", f"WITH {b.INDEX_CTE}, {LEARNED_CTE} SELECT question_id, table_id, column_id, value, score, rank FROM learned_ranked")
def m11(spark, sf_dir):
    return learned(spark, sf_dir).select("question_id", *ranking.ELEMENT, (F.col("score") + 0.0).alias("score"), "rank")


@query(
    "m4_weighted_rank",
    RANKED + "SELECT question_id, table_id, column_id, value, score, rank FROM ranked",
)
def m4(spark, sf_dir):
    return ranked(spark, sf_dir).select(*RANK_COLUMNS)


# ---- two data sources: even labels are one, odd labels the other, each numbering its vectors from 0 ----

TWO_SOURCES = f"""WITH {b.INDEX_CTE},
sourced AS (SELECT *, table_id % 2 AS source FROM docs),
near AS (
  SELECT q.vec_id AS question_id, d.source, d.index_name, d.vec_id, d.table_id, d.column_id, d.value,
         round(list_dot_product(q.e, d.e) / (q.n * d.n), 12) + 0.0 AS score
  FROM (SELECT * FROM sourced) q JOIN sourced d ON q.source = d.source
),
cut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, index_name ORDER BY score DESC, vec_id) AS n FROM near)
  WHERE n <= CASE WHEN index_name IN ({", ".join(f"'{n}'" for n in fixed.VALUE_INDEXES)}) THEN 2 ELSE 5 END
)
SELECT question_id, source AS data_source_id, index_name, table_id, column_id, value, round(score, 4) + 0.0 AS score FROM cut"""


@query("j11_similarity_join_sources", TWO_SOURCES)
def j11_sources(spark, sf_dir):
    """Questions find only elements of their own source, whose vector numbers stand in the other source as well."""
    index = b.index_documents(spark, sf_dir).withColumn("data_source_id", (F.col("table_id") % 2).cast("long"))
    number = F.dense_rank().over(Window.partitionBy("data_source_id", "index_name").orderBy("vec_id")) - 1
    index = index.withColumn("vec_id", number.cast("long"))
    asking = b.questions(spark, sf_dir).withColumn("data_source_id", (F.col("label") % 2).cast("long"))
    found = search.exact_knn(asking, index, search.limits_for((5, 2)))
    return search.hits_to_elements(found, index).select(
        "question_id", "data_source_id", "index_name", "table_id", "column_id", "value", "score"
    )


# ---- touched elements: all elements of the table a question is labelled with; every other question writes values in upper case ----

TOUCHED_CTE = """
elements AS (SELECT DISTINCT table_id, column_id, value FROM docs),
touched AS (
  SELECT q.vec_id AS question_id, e.table_id, e.column_id, CASE WHEN q.vec_id % 2 = 1 THEN upper(e.value) ELSE e.value END AS value
  FROM embeddings q JOIN elements e ON e.table_id = q.label
)"""


def elements(spark, sf_dir):
    return b.index_documents(spark, sf_dir).select(*ranking.ELEMENT).distinct()


def touched(spark, sf_dir):
    asked = b.questions(spark, sf_dir).select("question_id", F.col("label").alias("table_id"))
    value = F.when(F.col("question_id") % 2 == 1, F.upper("value")).otherwise(F.col("value"))
    return asked.join(elements(spark, sf_dir), "table_id").withColumn("value", value).select("question_id", *ranking.ELEMENT)


def sampler(spark, sf_dir):
    return sampling.Sampler(b.questions(spark, sf_dir), b.index_documents(spark, sf_dir))


def written_features(spark, sf_dir, limits=fixed.TRAINING_RANK_LIMITS):
    return materialize(features(spark, sf_dir, limits), "features")


SAME = "f.question_id = t.question_id AND f.table_id = t.table_id AND f.column_id IS NOT DISTINCT FROM t.column_id"
POSITIVE_CTE = f"""{TOUCHED_CTE},
exact AS (
  SELECT f.* FROM features f JOIN touched t ON {SAME} AND f.value IS NOT DISTINCT FROM t.value WHERE f.value IS NULL
),
loose AS (
  SELECT DISTINCT f.* FROM features f JOIN touched t ON {SAME} AND lower(f.value) = lower(t.value) WHERE f.value IS NOT NULL
),
positive AS (SELECT * FROM exact UNION ALL SELECT * FROM loose),
pool AS (
  SELECT f.* FROM features f WHERE NOT EXISTS (
    SELECT 1 FROM positive t WHERE {SAME} AND f.value IS NOT DISTINCT FROM t.value)
),
wanted AS (SELECT question_id, {b.LEVEL_SQL} AS level, count(*) AS wanted FROM touched GROUP BY ALL),
negative AS (
  SELECT * EXCLUDE (place, level) FROM (
    SELECT *, {b.LEVEL_SQL} AS level, row_number() OVER (PARTITION BY question_id, {b.LEVEL_SQL}
      ORDER BY md5('7|' || question_id || '|' || table_id || '|' || coalesce(CAST(column_id AS VARCHAR), '') || '|' || coalesce(value, ''))) AS place
    FROM pool) JOIN wanted USING (question_id, level) WHERE place <= wanted
)"""
SEED = 7


@query("j5_positives", TRAINING_FEATURES + f", {POSITIVE_CTE} SELECT question_id, table_id, column_id FROM exact")
def j5(spark, sf_dir):
    found = sampler(spark, sf_dir).positives(touched(spark, sf_dir).filter(F.col("value").isNull()))
    return found.select("question_id", "table_id", "column_id")


@query("j6_positives_ci", TRAINING_FEATURES + f", {POSITIVE_CTE} SELECT question_id, table_id, column_id, value FROM loose")
def j6(spark, sf_dir):
    found = sampler(spark, sf_dir).positives(touched(spark, sf_dir).filter(F.col("value").isNotNull()))
    return found.select("question_id", *ranking.ELEMENT)


@query("j7_negative_pool", TRAINING_FEATURES + f", {POSITIVE_CTE} SELECT question_id, table_id, column_id, value FROM pool")
def j7(spark, sf_dir):
    scores = written_features(spark, sf_dir)
    found = training.positives(scores, touched(spark, sf_dir)).unionByName(training.positives_ci(scores, touched(spark, sf_dir)))
    return training.negative_pool(scores, found).select("question_id", *ranking.ELEMENT)


@query("m8_sample_negatives", TRAINING_FEATURES + f", {POSITIVE_CTE} SELECT question_id, table_id, column_id, value, wanted FROM negative")
def m8(spark, sf_dir):
    drawing, asked = sampler(spark, sf_dir), touched(spark, sf_dir)
    positive = materialize(drawing.positives(asked), "positives")
    return drawing.negative_pairs(asked, positive, SEED).select("question_id", *ranking.ELEMENT, "wanted")


@query(
    "u3_stack_examples",
    TRAINING_FEATURES
    + f""", {POSITIVE_CTE} SELECT question_id, table_id, column_id, value, label FROM (
      SELECT question_id, table_id, column_id, value, 1.0::DOUBLE AS label FROM positive
      UNION ALL SELECT question_id, table_id, column_id, value, 0.0::DOUBLE FROM pool)""",
)
def u3(spark, sf_dir):
    scores = written_features(spark, sf_dir)
    exact = touched(spark, sf_dir).filter(F.col("value").isNull())
    found = training.positives(scores.filter(F.col("value").isNull()), exact).unionByName(
        training.positives_ci(scores, touched(spark, sf_dir))
    )
    stacked = training.stack_examples(found, training.negative_pool(scores, found))
    return stacked.select("question_id", *ranking.ELEMENT, "label")


SPLIT_SQL = "CASE WHEN {0} % 10 <= 6 THEN 'train' WHEN {0} % 10 = 7 THEN 'test' WHEN {0} % 10 = 8 THEN 'validation' ELSE 'unused' END"


@query("w13_split_of", f"SELECT doc_id, {SPLIT_SQL.format('doc_id')} AS split FROM labels")
def w13(spark, sf_dir):
    return b.table(spark, sf_dir, "labels").select("doc_id", training.split_of(F.col("doc_id")).alias("split"))


def training_set(spark, sf_dir, limits=fixed.TRAINING_RANK_LIMITS):
    asking = b.questions(spark, sf_dir)
    groups = asking.select("question_id", F.floor(F.col("question_id") / 4).alias("group_id"))
    return sampling.sampled_training_set(asking, b.index_documents(spark, sf_dir), touched(spark, sf_dir), groups, SEED, limits)


TRAINING_CTE = f"""{POSITIVE_CTE},
examples AS (
  SELECT *, {b.LEVEL_SQL} AS element_type, {SPLIT_SQL.format('(question_id // 4)')} AS split FROM (
    SELECT *, 1.0::DOUBLE AS label FROM positive UNION ALL SELECT * EXCLUDE (wanted), 0.0::DOUBLE FROM negative)
)"""
TRAINING = f"WITH {b.INDEX_CTE}, {b.features_cte(fixed.TRAINING_RANK_LIMITS)}, {TRAINING_CTE}"


@query(
    "m9_build_training_set",
    TRAINING + f"SELECT question_id, table_id, column_id, value, element_type, split, {VECTOR_SQL} AS features, label FROM examples",
)
def m9(spark, sf_dir):
    return training_set(spark, sf_dir).withColumn("features", shown(F.col("features")))


@query(
    "s7_training_store",
    TRAINING + f"SELECT question_id, table_id, column_id, {VECTOR_SQL} AS features, label FROM examples WHERE element_type = 'column' AND split = 'train'",
)
def s7(spark, sf_dir):
    path = new_path(spark, "training")
    write_training(training_set(spark, sf_dir), path)
    back = read_training(spark, path, "column", "train")
    return back.select("question_id", "table_id", "column_id", shown(F.col("features")).alias("features"), "label")


@query(
    "m10_evaluate_mse",
    TRAINING + f"SELECT element_type, split, round(avg((label - {NETWORK_SQL}) * (label - {NETWORK_SQL})), 6) AS mse FROM examples GROUP BY ALL",
)
def m10(spark, sf_dir):
    return training.evaluate_mse(training_set(spark, sf_dir), MODELS)


@query(
    "m7_train_mlp",
    TRAINING
    + f"""SELECT element_type, round(avg((label - {NETWORK_SQL}) * (label - {NETWORK_SQL})), 6) AS first_loss, true AS falls
    FROM examples WHERE split = 'train' GROUP BY ALL""",
)
def m7(spark, sf_dir):
    """The loss that training starts from, with weights by rule, and whether all its epochs lower it."""
    examples = materialize(training_set(spark, sf_dir).filter(F.col("split") == "train"), "examples")
    rows = []
    for kind in ranking.LEVELS:
        _, losses = training.train_mlp(examples, kind, start=MODELS[kind])
        rows.append((kind, round(losses[0], 6), losses[-1] < losses[0]))
    return spark.createDataFrame(rows, "element_type string, first_loss double, falls boolean")


@query(
    "f20_nan_guard",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax = 0 OR (l_discount = 0 AND l_quantity > 25) AS has_nan FROM lineitem""",
)
def f20(spark, sf_dir):
    nan = F.lit(float("nan"))
    lines = b.table(spark, sf_dir, "lineitem")
    examples = lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.array(F.when(F.col("l_tax") == 0, nan).otherwise(F.col("l_tax")), F.col("l_quantity")).alias("features"),
        F.when((F.col("l_discount") == 0) & (F.col("l_quantity") > 25), nan).otherwise(F.col("l_discount")).alias("label"),
    )
    return training.nan_guard(examples, strict=False).drop("features", "label")


# ---- few-shot ----

STORED_CTE = """
stored AS (SELECT vec_id AS matched_id, vec_id // 4 AS group_id, label FROM embeddings),
near AS (
  SELECT question_id, vec_id AS matched_id, round(score, 4) + 0.0 AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 3
),
shots AS (
  SELECT n.question_id, n.matched_id, s.label, g.gold_sql FROM near n JOIN stored s USING (matched_id) JOIN groups g USING (group_id)
  WHERE g.gold_sql IS NOT NULL AND g.gold_sql <> ''
)"""
SHOTS = f"WITH {b.INDEX_CTE}, {lb.GROUPS_CTE}, {STORED_CTE}"


def stored_questions(spark, sf_dir):
    """Every vector is also a stored question; four in a row form a group."""
    return b.questions(spark, sf_dir).select(
        "question_id", F.floor(F.col("question_id") / 4).alias("group_id"), F.col("question_id").cast("string").alias("text"), "label", "embedding"
    )


def nearest_stored(spark, sf_dir):
    index = stored_questions(spark, sf_dir).select(F.lit("few_shot").alias("index_name"), F.col("question_id").alias("vec_id"), "embedding")
    found = search.exact_knn(b.questions(spark, sf_dir), index, fixed.FEW_SHOT_MATCHES)
    return found.select("question_id", F.col("vec_id").alias("matched_id"), "score", "rank")


def shots(spark, sf_dir):
    return question_log.few_shot_examples(nearest_stored(spark, sf_dir), stored_questions(spark, sf_dir), lb.groups(spark, sf_dir))


def stored_touches(spark, sf_dir):
    """Elements the gold SQL of a stored question touches: those of its label's table."""
    labelled = b.questions(spark, sf_dir).select(F.col("question_id").alias("matched_id"), F.col("label").alias("table_id"))
    return labelled.join(elements(spark, sf_dir), "table_id")


@query("o4_few_shot_top3", SHOTS + "SELECT question_id, matched_id, score, rank FROM near")
def o4(spark, sf_dir):
    return nearest_stored(spark, sf_dir)


@query("j9_few_shot_examples", SHOTS + "SELECT question_id, matched_id, gold_sql FROM shots")
def j9(spark, sf_dir):
    return shots(spark, sf_dir).select("question_id", "matched_id", "gold_sql")


FEW_SHOT_CTE = f"""
{b.WEIGHTED_CTE},
elements AS (SELECT DISTINCT table_id, column_id, value FROM docs),
boosted AS (SELECT DISTINCT s.question_id, e.table_id, e.column_id, e.value, 100.0::DOUBLE AS score FROM shots s JOIN elements e ON e.table_id = s.label),
merged AS (
  SELECT question_id, table_id, column_id, value, max(score) AS score FROM (
    SELECT question_id, table_id, column_id, value, score FROM weighted UNION ALL SELECT * FROM boosted) GROUP BY ALL
),
merged_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {b.ELEMENT_ORDER_SQL}) AS rank FROM merged)"""


@query("u2_merge_rankings", f"{SHOTS}, {FEW_SHOT_CTE} SELECT question_id, count(*) AS elements, sum(CASE WHEN score = 100 THEN 1 ELSE 0 END)::BIGINT AS boosted FROM merged_ranked GROUP BY question_id")
def u2(spark, sf_dir):
    boosted = few_shot_rankings(shots(spark, sf_dir), stored_touches(spark, sf_dir))
    merged = ranking.merge_rankings(ranked(spark, sf_dir), boosted)
    return merged.groupBy("question_id").agg(
        F.count("*").alias("elements"), F.count_if(F.col("score") == fixed.FEW_SHOT_SCORE).alias("boosted")
    )


@query("m12_few_shot_rankings", f"{SHOTS}, {FEW_SHOT_CTE} SELECT question_id, table_id, column_id, value, score, rank FROM merged_ranked")
def m12(spark, sf_dir):
    boosted = few_shot_rankings(shots(spark, sf_dir), stored_touches(spark, sf_dir))
    return ranking.merge_rankings(ranked(spark, sf_dir), boosted).select(*RANK_COLUMNS)


# ---- packing ----


def _tokens(text_sql):
    return TOKENS_SQL.replace("value", f"({text_sql})")


def pack_cte(source: str, budget: int) -> str:
    """From a ranking to kept elements (`kept`) and one DDL per question (`packed`)."""
    return f"""
costs AS (
  SELECT *, regexp_matches(column_name, '{DEFAULT_NAMES}') AS is_default,
         {_tokens(f"' ' || lower(column_name) || ' ' || {TYPE_SQL} || ','")} + 1 AS column_cost FROM cat
),
tcosts AS (
  SELECT table_id, table_name, {_tokens("'CREATE TABLE ' || lower(table_name) || ' (' || chr(10) || ' ' || chr(10) || ');' || chr(10)")}
    + sum(CASE WHEN is_default THEN column_cost ELSE 0 END) AS table_cost FROM costs GROUP BY table_id, table_name
),
e1 AS (
  SELECT r.question_id, r.table_id, r.column_id, r.value, r.rank, table_cost, column_cost, is_default,
    row_number() OVER (PARTITION BY question_id, r.table_id ORDER BY rank) = 1 AS ft,
    r.column_id IS NOT NULL AND row_number() OVER (PARTITION BY question_id, r.table_id, r.column_id ORDER BY rank) = 1 AS fc,
    r.column_id IS NOT NULL AND r.value <> '' AND row_number() OVER (PARTITION BY question_id, r.table_id, r.column_id, r.value ORDER BY rank) = 1 AS fh
  FROM {source} r JOIN tcosts USING (table_id) LEFT JOIN costs c ON c.column_id = r.column_id
),
e2 AS (
  SELECT *, CASE WHEN fh THEN sum(CASE WHEN fh THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, table_id, column_id ORDER BY rank) END AS hint_no FROM e1
),
costed AS (
  SELECT *, CASE WHEN ft THEN table_cost ELSE 0 END + CASE WHEN fc AND NOT is_default THEN column_cost ELSE 0 END
    + CASE WHEN hint_no = 1 THEN {_tokens("' -- possible values include: ' || " + LITERAL_SQL.replace("value", "VALUE"))}
           WHEN hint_no <= 6 THEN {_tokens("', ' || " + LITERAL_SQL.replace("value", "VALUE"))} ELSE 0 END AS cost FROM e2
),
prefixed AS (
  SELECT *, coalesce(sum(cost) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tokens_before FROM costed
),
kept AS (SELECT * FROM prefixed WHERE tokens_before <= {budget}),
shown AS (
  SELECT question_id, table_id, column_id, min(rank) AS place,
    string_agg({LITERAL_SQL}, ', ' ORDER BY hint_no) FILTER (hint_no <= 5) AS listed
  FROM kept WHERE column_id IS NOT NULL GROUP BY ALL
),
all_columns AS (
  SELECT coalesce(s.question_id, d.question_id) AS question_id, coalesce(s.table_id, d.table_id) AS table_id,
    coalesce(s.column_id, d.column_id) AS column_id, CASE WHEN d.column_id IS NULL THEN s.place ELSE d.ordinal - 1000000000 END AS place, s.listed
  FROM shown s FULL JOIN (
    SELECT DISTINCT k.question_id, c.table_id, c.column_id, c.ordinal FROM kept k JOIN costs c ON c.table_id = k.table_id WHERE c.is_default
  ) d ON s.question_id = d.question_id AND s.column_id = d.column_id
),
ddls AS (
  SELECT k.question_id, k.table_id, k.first_rank, k.tokens, 'CREATE TABLE ' || lower(t.table_name) || ' (' || chr(10) ||
    coalesce(l.lines, '') || chr(10) || ');' || chr(10) AS ddl
  FROM (SELECT question_id, table_id, min(rank) AS first_rank, sum(cost) AS tokens FROM kept GROUP BY ALL) k
  JOIN tcosts t USING (table_id)
  LEFT JOIN (
    SELECT a.question_id, a.table_id, string_agg(' ' || lower(column_name) || ' ' || {TYPE_SQL} || ',' ||
      coalesce(' -- possible values include: ' || listed, ''), chr(10) ORDER BY place) AS lines
    FROM all_columns a JOIN cat c USING (column_id) GROUP BY ALL) l ON l.question_id = k.question_id AND l.table_id = k.table_id
),
packed AS (
  SELECT question_id, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(ddl, chr(10) ORDER BY first_rank DESC) AS schema_ddl FROM ddls GROUP BY question_id
)"""


PACKED = f"{RANKED}, {b.CATALOG_CTE}, {pack_cte('ranked', BUDGET)}"


def costed(spark, sf_dir):
    return packing.element_cost(ranked(spark, sf_dir), packing.column_costs(b.columns(spark, sf_dir), DEFAULT_NAMES))


@query("w4_element_cost", PACKED + "SELECT question_id, rank, CAST(cost AS BIGINT) AS cost FROM costed")
def w4(spark, sf_dir):
    return costed(spark, sf_dir).select("question_id", "rank", "cost")


@query("w3_pack_budget", PACKED + "SELECT question_id, rank, CAST(cost AS BIGINT) AS cost, CAST(tokens_before AS BIGINT) AS tokens_before FROM kept")
def w3(spark, sf_dir):
    return packing.pack_budget(costed(spark, sf_dir), BUDGET).select("question_id", "rank", "cost", "tokens_before")


NAMED_SQL = """named AS (
  SELECT p_size AS question_id, 11 AS table_id, 1101 AS column_id, p_name AS value, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank FROM part)"""


@query(
    "w5_cap_hints",
    f"""WITH {NAMED_SQL}, d AS (SELECT question_id, value, min(rank) AS rank FROM named GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS hint_no FROM d)
    SELECT question_id, value, hint_no, hint_no <= 5 AS rendered FROM n WHERE hint_no <= 6""",
)
def w5(spark, sf_dir):
    # Part names as value hits of one column; the size asks, and the part key is the ranking order.
    named = b.table(spark, sf_dir, "part").select(
        F.col("p_size").alias("question_id"),
        F.lit(11).alias("table_id"),
        F.lit(1101).alias("column_id"),
        F.col("p_name").alias("value"),
        F.col("p_partkey").alias("rank"),
    )
    return packing.cap_hints(named).select("question_id", "value", "hint_no", "rendered")


@query(
    "w6_table_output_order",
    RANKED
    + """SELECT question_id, table_id, row_number() OVER (PARTITION BY question_id ORDER BY first_rank DESC) AS position
    FROM (SELECT question_id, table_id, min(rank) AS first_rank FROM ranked GROUP BY ALL)""",
)
def w6(spark, sf_dir):
    return packing.table_output_order(ranked(spark, sf_dir)).select("question_id", "table_id", "position")


@query("m13_pack_schema", PACKED + "SELECT question_id, tokens, schema_ddl FROM packed")
def m13(spark, sf_dir):
    return packing.pack_schema(ranked(spark, sf_dir), b.columns(spark, sf_dir), BUDGET, DEFAULT_NAMES)


@query(
    "m15_link_schema",
    f"{SHOTS}, {FEW_SHOT_CTE}, {b.CATALOG_CTE}, {pack_cte('merged_ranked', BUDGET)} SELECT question_id, tokens, schema_ddl FROM packed",
)
def m15(spark, sf_dir):
    return link_schema(
        b.questions(spark, sf_dir),
        b.index_documents(spark, sf_dir),
        b.columns(spark, sf_dir),
        BUDGET,
        few_shot=(shots(spark, sf_dir), stored_touches(spark, sf_dir)),
        default_pattern=DEFAULT_NAMES,
    )


# ---- embedding and index store ----

EMBEDDED = """WITH words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source}),
counts AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM words GROUP BY ALL),
norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL)
SELECT {key}, dim, round(CAST(CAST(n / norm AS FLOAT) AS DOUBLE), 4) AS weight FROM counts JOIN norms USING ({key})"""


def dimensions(df, key):
    long = df.select(key, F.posexplode("embedding").alias("dim", "weight"))
    return long.filter(F.col("weight") != 0).select(key, "dim", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query("m1_embed", EMBEDDED.format(key="doc_id", source="documents"))
def m1(spark, sf_dir):
    texts = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dimensions(docs_op.embed(texts, "text"), "doc_id")


@query(
    "m14_build_few_shot_index",
    f"WITH {lb.GROUPS_CTE}, gold AS (SELECT question_id, text FROM groups JOIN questions USING (group_id) WHERE status = 'CORRECT') "
    + "SELECT * FROM (" + EMBEDDED.format(key="question_id", source="gold") + ")",
)
def m14(spark, sf_dir):
    """One vector per gold question, written by data source and read back."""
    gold = question_log.read_gold_questions(lb.groups(spark, sf_dir), lb.questions(spark, sf_dir))
    vectors_ = docs_op.embed(gold.select("question_id", "text"), "text").select(
        F.lit(1).alias("data_source_id"), F.lit("few_shot").alias("index_name"), "question_id", "embedding"
    )
    path = new_path(spark, "few-shot")
    write_index(vectors_, path)
    return dimensions(read_index(spark, path, 1, "few_shot"), "question_id")


@query(
    "s6_index_store",
    f"WITH {b.INDEX_CTE} SELECT index_name, vec_id, table_id, column_id, value, round(list_sum(e), 6) + 0.0 AS total FROM docs",
)
def s6(spark, sf_dir):
    path = new_path(spark, "index")
    write_index(b.index_documents(spark, sf_dir), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return read_index(spark, path, data_source_id=1).select(
        "index_name", "vec_id", "table_id", "column_id", "value", (F.round(total, 6) + 0.0).alias("total")
    )
