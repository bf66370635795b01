"""Scores that are folded while documents pass element by element."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slink.operators import block_stream, element_scores, ranking, sampling, search, training
from tests.test_sampling import ELEMENT, asking, index, old_features, plain, touched


def test_pairs_meet_documents_without_a_row_for_each(spark, monkeypatch):
    """A question goes once to each table that it wants elements of, however many documents these have."""
    questions, documents = asking(spark), index(spark)
    moved = []
    plain_stream = sampling.cell_stream
    monkeypatch.setattr(sampling, "cell_stream", lambda left, right, *a: moved.append((left.count(), right.count())) or plain_stream(left, right, *a))
    touches = touched(spark, documents)
    pairs = touches.filter(F.col("value").isNull())
    got = sampling.Sampler(questions, documents, (1000, 1000)).score(pairs)
    tables = pairs.select("question_id", "table_id").distinct().count()
    assert moved == [(tables, 240)] and tables < pairs.distinct().count() == got.count()


def test_kept_hits_are_not_moved_for_features(spark, monkeypatch):
    """Neither for a table with an element of many documents nor to find the last kept hit."""
    questions, documents = asking(spark), index(spark)
    want = plain(old_features(questions, documents, (4, 3)))
    monkeypatch.setattr(search, "similarity_join", lambda *a, **b: pytest.fail("hits are moved"))
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 3)
    monkeypatch.setattr(ranking, "DOCUMENT_BLOCK", 3)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 1)
    monkeypatch.setattr(element_scores, "LINES_AT_ONCE", 2)
    assert plain(ranking.score_features(questions, documents, (4, 3))) == want


@pytest.mark.parametrize("held", [10**9, 0])
@pytest.mark.parametrize("changed", ["", "nan", "sources", "copies"])
def test_cut_points_are_the_last_hits(spark, monkeypatch, held, changed):
    """From documents that are held or, where an index is too large for that, from hits that are held."""
    monkeypatch.setattr(search, "HELD_INDEX_NUMBERS", held)
    monkeypatch.setattr(search, "HELD_SCORES", 500)
    monkeypatch.setattr(search, "TRIED", 16)
    questions, documents = asking(spark), index(spark, 300)
    if changed == "nan":
        documents = documents.withColumn("embedding", F.when(F.col("vec_id") % 8 < 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    if changed == "sources":
        documents = documents.withColumn("data_source_id", 1 + (F.col("vec_id") % 7 == 0).cast("int"))
        questions = questions.withColumn("data_source_id", 1 + (F.col("question_id") % 2).cast("int"))
    if changed == "copies":
        documents = documents.withColumn("embedding", F.when(F.col("vec_id") % 4 > 0, F.array(*[F.lit(x).cast("float") for x in (1, 2, 0, 1, 0, 3)])).otherwise(F.col("embedding")))
    k = search.limits_for((20, 9))
    names, found = search.cut_points(questions, documents, k)
    hits = search.full_knn(questions, documents, k)
    want = hits.filter(F.col("rank") == search.limit_column(k, F.col("index_name"))).join(documents.groupBy(search.source_of(documents), "index_name").agg(F.count("*").alias("n")), [search.SOURCE, "index_name"])
    want = {(r.question_id, r.index_name): (-np.inf if np.isnan(r.score) else r.score, r.vec_id) for r in want.filter(F.col("n") > search.limit_column(k, F.col("index_name"))).collect()}
    got = {(r.question_id, n): x for r in found.collect() for n, *x in zip(names, r.cut_scores, r.cut_ids, strict=True)}
    assert {key: tuple(x) for key, x in got.items() if x[1] != search.NO_VECTOR} == want and want


def test_negatives_of_cut_indexes_are_drawn_where_they_are_found(spark, monkeypatch):
    """With strips for every core as well as with ranges of documents; types stay those of the touches."""
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 1)
    monkeypatch.setattr(sampling, "LEAST_QUESTIONS", 1)
    monkeypatch.setattr(sampling, "TABLE_DOCUMENTS", 20)
    monkeypatch.setattr(sampling, "DOCUMENT_BLOCK", 7)
    monkeypatch.setattr(element_scores, "ROWS_OUT", 3)
    questions, documents = asking(spark), index(spark)
    touches = touched(spark, documents)
    groups = questions.select("question_id", F.col("question_id").alias("group_id"))
    want = training.build_training_set(old_features(questions, documents, (6, 5)), touches, groups, 7)
    got = sampling.sampled_training_set(questions, documents, touches, groups, 7, (6, 5))
    assert plain(got) == plain(want) and got.schema[1].dataType == touches.schema[1].dataType


def test_null_vectors_repeated_questions_and_unknown_elements(spark):
    """A document without a vector makes its element known but gives no score; what is no number is above all others."""
    nan = float("nan")
    documents = spark.createDataFrame(
        [("table_name", 0, 1, None, None, [1.0, 0.0]), ("table_name", 1, 1, None, None, None), ("column_name", 2, 1, 11, None, None), ("column_name", 3, 1, 12, None, [nan, 1.0]), ("column_name", 4, 1, 13, None, [0.0, 0.0]), ("value", 5, None, None, "x", [1.0, 0.0])],
        "index_name string, vec_id long, table_id int, column_id int, value string, embedding array<float>",
    )
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "question_id long, embedding array<float>")
    pairs = spark.createDataFrame([(q, 1, c, None) for q in (1, 2) for c in (None, 11, 12, 13, 14)], f"question_id long, {', '.join(f'{c} {t}' for c, t in zip(ELEMENT, ('int', 'int', 'string'), strict=True))}")
    got = sampling.Sampler(questions, documents).score(pairs)
    rows = {(r.question_id, r.column_id): (r.table_name_score, str(r.column_name_score)) for r in got.collect()}
    assert rows == {(1, None): (0.0, "None"), (1, 11): (0.0, "None"), (1, 12): (0.0, "nan"), (1, 13): (0.0, "0.0"), (2, None): (None, "None"), (2, 11): (None, "None"), (2, 12): (None, "None"), (2, 13): (None, "None")}


def test_tables_end_where_the_next_begins(spark, monkeypatch):
    """A column without its own table's document has no table scores, also after a table that has some."""
    documents = spark.createDataFrame(
        [("table_name", 0, 1, None, None, [1.0, 0.0]), ("column_name", 1, 1, 11, None, [1.0, 0.0]), ("column_name", 2, 2, 21, None, [1.0, 0.0])],
        "index_name string, vec_id long, table_id int, column_id int, value string, embedding array<float>",
    )
    questions = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "question_id long, embedding array<float>")
    for least in (1, 64):
        monkeypatch.setattr(search, "LEAST_QUESTIONS", least)
        got = ranking.score_features(questions, documents, (9, 9))
        assert {(r.column_id, r.table_name_score, r.column_name_score) for r in got.collect()} == {(None, 1.0, None), (11, 1.0, 1.0), (21, None, 1.0)} and got.count() == 60


def test_cells_without_one_side_give_nothing(spark):
    left = spark.createDataFrame([(0, 1), (2, 5)], "cell int, a long")
    right = spark.createDataFrame([(0, 7), (0, 6), (1, 8)], "cell int, b long")

    def kernel(held, blocks):
        for block in blocks:
            yield block.append_column("a", [held["a"].to_pylist() * block.num_rows]).to_batches()[0]

    got = block_stream.cell_stream(left, right, 3, kernel, "b long, a long", ["b"], 1)
    assert sorted(map(tuple, got.collect())) == [(6, 1), (7, 1)]


def test_nothing_is_cut_of_indexes_below_their_limits(spark):
    assert search.cut_points(asking(spark), index(spark), search.limits_for((1000, 1000)))[0] == []
