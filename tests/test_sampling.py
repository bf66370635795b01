"""Drawing first and scoring afterwards gives what scoring everything gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators import block_stream, ranking, sampling, search, training

ELEMENT = ranking.ELEMENT


def index(spark, n_documents=240, n_tables=5, seed=4):
    """Documents of all nine indexes; elements have several, and one table has most."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_documents):
        name = fixed.ALL_INDEXES[i % 9]
        table = 0 if rng.random() < 0.6 else int(rng.integers(n_tables))
        column = table * 10 + int(rng.integers(3)) if name not in fixed.TABLE_INDEXES else None
        value = f"V{rng.integers(4)}" if name in fixed.VALUE_INDEXES else None
        rows.append((name, i, table, column, value, rng.integers(-3, 4, 6).astype(float).tolist()))
    return spark.createDataFrame(rows, "index_name string, vec_id long, table_id int, column_id int, value string, embedding array<float>")


def asking(spark, n=30, seed=9):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(n)], "question_id long, embedding array<float>")


def touched(spark, documents, n=30):
    """Every question touches the elements of two tables, half of them with values in lower case, and one unknown value."""
    elements = documents.select(*ELEMENT).distinct()
    pairs = spark.createDataFrame([(i, t) for i in range(n) for t in {i % 5, (i * 3) % 5}], "question_id long, table_id int")
    value = F.when(F.col("question_id") % 2 == 1, F.lower("value")).otherwise(F.col("value"))
    known = pairs.join(elements, "table_id").withColumn("value", value).select("question_id", *ELEMENT)
    return known.union(spark.createDataFrame([(0, 1, 10, "nowhere")], known.schema))


def old_features(questions, documents, limits):
    """Features by way of all hits."""
    hits = search.hits_to_elements(search.exact_knn(questions, documents, search.limits_for(limits)), documents)
    return ranking.copy_table_scores(ranking.index_scores(hits))


def plain(df):
    return sorted(tuple("" if v is None else str(v) for v in row) for row in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("limits, block", [((1000, 1000), 8192), ((4, 3), 8192), ((1000, 2), 30), ((1000, 1000), 3), ((4, 3), 3)])
def test_features_of_element_blocks_equal_those_of_hits(spark, monkeypatch, limits, block):
    """Also where an index is cut, and where a table's elements (30) or an element (3) do not fit a block."""
    questions, documents = asking(spark), index(spark)
    want = plain(old_features(questions, documents, limits))
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", block)
    monkeypatch.setattr(ranking, "DOCUMENT_BLOCK", block)
    monkeypatch.setattr(block_stream, "STRIP_ROWS", 11)
    monkeypatch.setattr(ranking, "WIDE_CELLS", 500)
    assert plain(ranking.score_features(questions, documents, limits)) == want


@pytest.mark.parametrize("limits", [(1000, 1000), (6, 5)])
def test_sampled_set_equals_that_of_all_scores(spark, monkeypatch, limits):
    questions, documents = asking(spark), index(spark)
    touches = touched(spark, documents)
    groups = questions.select("question_id", F.col("question_id").alias("group_id"))
    features = old_features(questions, documents, limits)
    want = training.build_training_set(features, touches, groups, 7)
    monkeypatch.setattr(sampling, "ELEMENT_BLOCK", 10)
    got = sampling.sampled_training_set(questions, documents, touches, groups, 7, limits)
    assert plain(got) == plain(want)


def test_strict_sets_name_what_is_missing(spark):
    questions, documents = asking(spark), index(spark)
    groups = questions.select("question_id", F.col("question_id").alias("group_id"))
    unknown = spark.createDataFrame([(1, 99, None, None)], "question_id long, table_id int, column_id int, value string")
    with pytest.raises(ValueError, match="without scores"):
        sampling.sampled_training_set(questions, documents, unknown, groups, strict=True)
    everything = questions.filter("question_id = 1").select("question_id").crossJoin(documents.select(*ELEMENT).distinct())
    with pytest.raises(ValueError, match="not enough"):
        sampling.sampled_training_set(questions, documents, everything, groups, strict=True)


def test_empty_tables_give_no_examples(spark):
    questions, documents = asking(spark), index(spark)
    groups = questions.select("question_id", F.col("question_id").alias("group_id"))
    none = touched(spark, documents).limit(0)
    assert sampling.sampled_training_set(questions, documents, none, groups).count() == 0
    assert sampling.sampled_training_set(questions, documents.limit(0), none, groups).count() == 0


def test_streams_are_bounded_by_the_cores(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 2)
    monkeypatch.setattr(block_stream, "STRIP_ROWS", 2)
    found = search.similarity_join(asking(spark), index(spark), 3)
    most = block_stream.STREAMS_PER_CORE * spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() <= most
    assert found.select("question_id").distinct().count() == 30


def test_kept_hits_are_one_row_per_element_and_index(spark):
    """All hits of a question may be thousands of chunks of few elements."""
    questions, documents = asking(spark), index(spark)
    hits = sampling.Sampler(questions, documents, (1000, 20)).hits
    assert hits.count() == hits.select("question_id", "index_name", *ELEMENT).distinct().count()
    assert hits.count() < search.full_knn(questions, documents, search.limits_for((1000, 20))).filter("index_name in ('value', 'table_column_and_value')").count()
