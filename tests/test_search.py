import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slink.functions import vectors
from slink.operators import block_stream, documents, grouping, ranking, search


def frames(spark, n_questions=40, n_documents=300, width=8, hot=0.7, seed=1):
    """Random vectors; one index holds most documents."""
    rng = np.random.default_rng(seed)
    q = rng.integers(-3, 4, (n_questions, width)).astype(float)
    d = rng.integers(-3, 4, (n_documents, width)).astype(float)
    names = ["value" if rng.random() < hot else "column_name" for _ in range(n_documents)]
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<float>")
    docs = spark.createDataFrame([(n, i, v.tolist()) for i, (n, v) in enumerate(zip(names, d))], "index_name string, vec_id long, embedding array<float>")
    return questions, docs, q, d, names


def brute(q, d, names, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    scores = np.round(unit(q) @ unit(d).T, 12) + 0.0
    shown = lambda x: float(np.sign(x) * np.floor(abs(x) * 1e4 + 0.5) / 1e4) + 0.0
    want = set()
    for i in range(len(q)):
        for name in set(names):
            mine = [j for j in range(len(d)) if names[j] == name]
            best = sorted(mine, key=lambda j: (-scores[i, j], j))[: k if isinstance(k, int) else k[name]]
            want |= {(i, name, j, shown(scores[i, j]), r) for r, j in enumerate(best, 1)}
    return want


@pytest.mark.parametrize("blocks", [(4096, 8192), (16, 8192), (16, 40), (4096, 5)])
@pytest.mark.parametrize("k", [7, {"value": 3, "column_name": 1000}])
def test_exact_for_any_block_size(spark, monkeypatch, blocks, k):
    monkeypatch.setattr(block_stream, "STRIP_ROWS", blocks[0])
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", blocks[1])
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    monkeypatch.setattr(search, "SCORED_AT_ONCE", 3)
    questions, docs, q, d, names = frames(spark)
    got = {tuple(r) for r in search.exact_knn(questions, docs, k).select("question_id", "index_name", "vec_id", "score", "rank").collect()}
    assert got == brute(q, d, names, k)


def test_questions_find_only_their_own_source(spark):
    """Vector numbers restart in each source."""
    questions, docs, q, d, names = frames(spark)
    sourced = lambda df, s: df.withColumn("data_source_id", F.lit(s))
    both = sourced(docs, 1).unionByName(sourced(docs.withColumn("embedding", F.transform("embedding", lambda x: -x)), 2))
    asking = sourced(questions.filter("question_id % 2 = 0"), 1).unionByName(sourced(questions.filter("question_id % 2 = 1"), 2))
    found = search.exact_knn(asking, both, 7)
    got = {tuple(r) for r in found.select("question_id", "index_name", "vec_id", "score", "rank").collect()}
    want = {r for r in brute(q, d, names, 7) if r[0] % 2 == 0} | {r for r in brute(q, -d, names, 7) if r[0] % 2 == 1}
    assert got == want
    links = both.select("data_source_id", "index_name", "vec_id", F.col("data_source_id").alias("table_id"), F.lit(None).cast("int").alias("column_id"), F.lit(None).cast("string").alias("value"))
    elements = search.hits_to_elements(found, links)
    assert elements.count() == len(want) and not elements.filter("table_id <> data_source_id").count()


def test_no_documents_no_hits(spark):
    questions, docs, *_ = frames(spark)
    assert search.exact_knn(questions, docs.limit(0), 5).count() == 0


def test_salted_top_k_equals_plain(spark):
    rows = [("hot", i % 97, f"v{i}") for i in range(5000)] + [("cold", 1, "x")]
    df = spark.createDataFrame(rows, "g string, n long, value string")
    order = [F.desc("n"), F.asc("value")]
    plain = grouping.top_k_per_group(df, ["g"], order, 1500).collect()
    salted = grouping.top_k_per_group(df, ["g"], order, 1500, salt_by=["value"]).collect()
    assert sorted(plain) == sorted(salted) and len(plain) == 1501


def test_number_rows_in_slices(spark):
    rows = [("hot", 3 * i) for i in range(2000)] + [("cold", 5), ("cold", 2)]
    df = spark.createDataFrame(rows, "g string, n long").repartition(7)
    got = {(r.g, r.n): r.row_idx for r in grouping.number_rows(df, ["g"], F.floor(F.col("n") / 100), [F.col("n")]).collect()}
    assert got[("cold", 2)] == 0 and got[("cold", 5)] == 1
    assert all(got[("hot", 3 * i)] == i for i in range(2000))


def test_highest_and_lowest_chunk_scores_differ(spark):
    hits = spark.createDataFrame(
        [(1, "column_name", 5, 501, None, 0.9), (1, "column_name", 5, 501, None, 0.2), (1, "table_name", 5, None, None, 0.7)],
        "question_id long, index_name string, table_id int, column_id int, value string, score double",
    )
    best = {(r.table_id, r.column_id): r.score for r in ranking.best_score(hits).collect()}
    assert best == {(5, 501): 0.9, (5, None): 0.7}
    wide = {r.column_id: r for r in ranking.copy_table_scores(ranking.index_scores(hits)).collect()}
    assert wide[501].column_name_score == 0.2 and wide[501].table_name_score == 0.7
    assert wide[None].column_name_score is None
    vectors_ = {r.column_id: r.v for r in ranking.copy_table_scores(ranking.index_scores(hits)).select("column_id", ranking.feature_vectors().alias("v")).collect()}
    assert vectors_[501] == [0.7, 0.0, 0.0, 0.2, 0.0, 0.0, 0.0] and vectors_[None] == [0.7, 0.0, 0.0]


def test_merge_keeps_the_higher_score(spark):
    schema = "question_id long, table_id int, column_id int, value string, score double"
    a = spark.createDataFrame([(1, 1, None, None, 0.5), (1, 2, None, None, 0.4)], schema)
    z = spark.createDataFrame([(1, 2, None, None, 100.0), (1, 3, 301, "x", 100.0)], schema)
    got = [(r.table_id, r.score) for r in ranking.merge_rankings(a, z).orderBy("rank").collect()]
    assert got == [(2, 100.0), (3, 100.0), (1, 0.5)]


def test_zero_vector_is_kept(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r.u for r in df.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_sentinels(spark):
    df = spark.createDataFrame([(1, -1, ""), (1, 7, "x")], "t int, c int, v string")
    rows = df.select(*search.sentinel_to_null(F.col("t"), F.col("c"), F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(1, None, None), (1, 7, "x")]
    with pytest.raises(Exception, match="without a table"):
        df.select(*search.sentinel_to_null(F.lit(-1), F.col("c"), F.col("v"))).collect()


def test_embedder_is_repeatable_and_unit(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "")], "id int, text string")
    rows = {r.id: r.embedding for r in documents.embed(df, "text").collect()}
    assert rows[1] == rows[2] and abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and sum(rows[3]) == 0


def test_cache_lookup_computes_each_missing_text_once(spark):
    requests = spark.createDataFrame([(i, "hot") for i in range(300)] + [(900, "known"), (901, "rare")], "id int, text string")
    from slink.functions.text import content_hash

    cache = spark.createDataFrame([("known",)], "t string").select(content_hash(F.col("t")).alias("key"), F.lit(1).alias("cached_value"))
    looked, misses = documents.cache_lookup(requests, cache, "text")
    assert looked.filter("hit").count() == 1 and looked.count() == 302
    assert sorted(r.text for r in misses.collect()) == ["hot", "rare"]


@pytest.mark.parametrize("size", [1, 7, 10, 7500])
def test_chunks_of_joined_values(spark, size):
    values = [(1, 101, 1, "alpha"), (1, 101, 2, "b"), (1, 102, 1, "gamma delta"), (2, 201, 1, "é" * 12), (2, 202, 5, "z")]
    df = spark.createDataFrame(values, "table_id int, column_id int, value_rank int, value string")
    for keys in (["table_id"], ["table_id", "column_id"]):
        got = {}
        for r in documents.chunk_joined_values(df, keys, ["value_rank"], size).collect():
            got.setdefault(tuple(r[k] for k in keys), {})[r.chunk_no] = r.chunk
        want = {}
        for t, c, _, v in values:
            want.setdefault((t, c) if len(keys) == 2 else (t,), []).append(v)
        for key, parts in want.items():
            joined = "\n".join(parts)
            assert got[key] == {i // size: joined[i : i + size] for i in range(0, len(joined), size)}


def test_offsets_are_sequential_per_index(spark):
    rows = [("value", t, t * 100 + c, f"v{v}", 0) for t in (1, 2) for c in (0, 1) for v in range(20)] + [("table_name", 1, None, None, 0), ("table_name", 2, None, None, 0)]
    df = spark.createDataFrame(rows, "index_name string, table_id int, column_id int, value string, chunk_no int")
    numbered = documents.assign_offsets(df).orderBy("index_name", "vec_id").collect()
    assert [r.vec_id for r in numbered if r.index_name == "value"] == list(range(80))
    ordered = [(r.table_id, r.column_id, r.value) for r in numbered if r.index_name == "value"]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("k", [1, 5, 40, 500])
@pytest.mark.parametrize("block", [3, 50, 1000])
def test_best_hits_over_blocks_of_copies(monkeypatch, k, block):
    """Equal scores fall to the smaller vec_id whatever block it came in, and held documents are numbered anew."""
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 2)
    monkeypatch.setattr(search, "SCORED_AT_ONCE", 4)
    monkeypatch.setattr(search, "ROWS_OUT", 9)
    rng = np.random.default_rng(3)
    q, d = rng.integers(-2, 3, (11, 4)).astype(float), rng.integers(-2, 3, (300, 4)).astype(float)
    ids = rng.permutation(len(d))
    of = lambda v: pa.array(v.tolist(), pa.list_(pa.float32()))
    questions = pa.table({"question_id": np.arange(11), "data_source_id": np.ones(11, np.int64), "embedding": of(q)})
    docs = pa.table({"data_source_id": np.ones(300, np.int64), "index_name": ["value"] * 300, "vec_id": ids, "embedding": of(d[ids]), "c": [f"c{i}" for i in ids]})
    blocks = [docs.slice(i, block) for i in range(0, 300, block)]
    found = pa.Table.from_batches(search._best_hits(k, ["c"], False)(questions, iter(blocks))).to_pylist()
    want = brute(q, d, ["value"] * 300, k)
    assert {(r["question_id"], r["vec_id"], r["rank"], r["c"]) for r in found} == {(i, j, r, f"c{j}") for i, _, j, _, r in want}
    last = list(search._best_hits(k, [], True)(questions, iter(blocks)))
    got = {(r["question_id"], r["vec_id"]) for batch in last for r in batch.to_pylist()}
    assert got == ({(i, j) for i, _, j, _, r in want if r == k})


def test_hits_of_many_questions_are_final(spark, monkeypatch):
    """Strips for every core meet all documents in one task, so hits are not shuffled."""
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 40)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    questions, docs, *_ = frames(spark)
    plan = search.full_knn(questions, docs, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionBy") + plan.count("Repartition ") <= 1
    few, *_ = frames(spark, n_questions=3)
    assert "Window" in search.full_knn(few, docs, 7)._jdf.queryExecution().optimizedPlan().toString()


def test_shown_scores_are_rounded_half_up(spark):
    values = [0.00005, -0.00005, 0.12345, -0.12345, 0.123449999999, 0.0, -0.00004, 1.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    rows = df.select(search.shown_score(), (F.round("score", 4) + F.lit(0.0)).alias("want")).collect()
    assert [str(r.score) for r in rows] == [str(r.want) for r in rows]


def test_a_repeated_question_is_cut_once(spark):
    """As the window over question and index would."""
    questions, docs, *_ = frames(spark)
    twice = questions.union(questions.filter("question_id < 9").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    got = search.full_knn(twice, docs, 7, once=True)
    plain = search.full_knn(twice, docs, 10_000)
    want = search.top_k_hits(plain.drop("rank"), 7)
    columns = ["question_id", "index_name", "vec_id", "score", "rank"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("n_questions", [40, 3])
def test_hits_of_an_element_leave_their_task_as_one_row(spark, monkeypatch, n_questions):
    """Folded in the search or, with few questions, after it, as the groups of all hits would be."""
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 40)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    monkeypatch.setattr(search, "ROWS_OUT", 50)
    questions, docs, *_ = frames(spark, n_questions=n_questions)
    column = F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 7).cast("int"))
    docs = docs.withColumn("table_id", (F.col("vec_id") % 4).cast("int")).withColumn("column_id", column)
    docs = docs.withColumn("value", F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("v"), F.col("vec_id") % 2)))
    k = {"value": 60, "column_name": 1000}
    keys = ["question_id", "index_name", *ranking.ELEMENT]
    hits = search.exact_knn(questions, docs, k, ranking.ELEMENT)
    steps = F.sort_array(F.collect_list(F.rint(F.col("score") * 10_000).cast("short")))
    for fold, want in {"highest": F.max("score"), "lowest": F.min("score"), "all": steps}.items():
        got = search.element_knn(questions, docs, k, ranking.ELEMENT, fold)
        got = got.withColumn("score", F.sort_array("score")) if fold == "all" else got
        grouped = hits.groupBy(keys).agg(want.alias("score"))
        assert sorted(map(str, got.select(*keys, "score").collect())) == sorted(map(str, grouped.select(*keys, "score").collect()))


def test_folded_scores_that_are_no_numbers():
    scores = np.array([0.5, np.nan, 0.25, 0.123449999999, -0.00005, np.nan])
    first = np.array([0, 2, 5])
    assert np.array_equal(search.FOLDS["highest"](scores, first), [np.nan, 0.25, np.nan], equal_nan=True)
    assert np.array_equal(search.FOLDS["lowest"](scores, first), [0.5, -0.00005, np.nan], equal_nan=True)
    assert search.FOLDS["all"](scores, first).to_pylist() == [[5000, None], [2500, 1234, -1], [None]]


def test_weighted_rank_with_negative_weights(spark):
    """The lowest of several hits of an element is then its best."""
    rng = np.random.default_rng(5)
    questions = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "question_id long, embedding array<float>")
    rows = [("table_name" if i % 2 else "column_name", i, i % 3, 100 * (i % 3) if not i % 2 else None, None, rng.normal(size=4).tolist()) for i in range(60)]
    docs = spark.createDataFrame(rows, "index_name string, vec_id long, table_id int, column_id int, value string, embedding array<float>")
    for weights in ({"table_name": 1.5, "column_name": -0.5}, {"table_name": 1.5, "column_name": 0.5}):
        hits = search.exact_knn(questions, docs, search.limits_for((7, 7)), ranking.ELEMENT)
        want = ranking.order_rankings(ranking.best_score(ranking.weight_scores(hits, weights)))
        got = ranking.weighted_rank(questions, docs, weights, (7, 7))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("k", [1, 5])
def test_pairs_sorted_out_in_single_precision(monkeypatch, k):
    """Hits that single precision cannot tell apart are still ranked by their full scores, of copies the smaller vec_id."""
    monkeypatch.setattr(search, "SKIM_FROM", 2)
    monkeypatch.setattr(search, "SKIMMED_AT_ONCE", 7)
    monkeypatch.setattr(search, "ROWS_OUT", 5)
    rng = np.random.default_rng(8)
    near = rng.normal(size=(6, 16))
    d = np.concatenate([near[i % 6] + rng.normal(size=(40, 16)) * 10.0 ** -(i % 4) * 1e-4 for i in range(6)]).astype(np.float32).astype(float)
    d = np.concatenate([d, d[::3]])
    q = near.astype(np.float32).astype(float)
    ids = rng.permutation(len(d))
    of = lambda v: pa.array(v.tolist(), pa.list_(pa.float32()))
    questions = pa.table({"question_id": np.arange(6), "data_source_id": np.ones(6, np.int64), "embedding": of(q)})
    docs = pa.table({"data_source_id": np.ones(len(d), np.int64), "index_name": ["value"] * len(d), "vec_id": ids, "embedding": of(d[ids])})
    used = []
    plain = search._near
    monkeypatch.setattr(search, "_near", lambda *a: used.append(1) or plain(*a))
    found = pa.Table.from_batches(search._best_hits(k, [])(questions, (docs.slice(i, 20) for i in range(0, len(d), 20)))).to_pylist()
    assert used and {(r["question_id"], r["vec_id"], r["rank"]) for r in found} == {(i, j, r) for i, _, j, _, r in brute(q, d, ["value"] * len(d), k)}


def test_strips_are_as_large_as_vectors_allow(spark, monkeypatch):
    """Each strip meets all documents, so with short vectors few long strips move them less often."""
    monkeypatch.setattr(block_stream, "STRIP_ROWS", 4)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    questions, docs, *_ = frames(spark)
    assert search._plan(questions, docs, 3)[0] == 8
    monkeypatch.setattr(search, "HELD_NUMBERS", 4 * 8)
    assert search._plan(questions, docs, 3)[0] == 16


@pytest.mark.parametrize("at_once", [1, 50, 100_000])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_lists_of_scores_are_ranked_as_hits_are(spark, monkeypatch, at_once, batch):
    """Questions over several batches, equal scores, scores that are no numbers, elements of two indexes and of no table."""
    monkeypatch.setattr(ranking, "RANKED_AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = np.random.default_rng(2)
    elements = [(1, None, None), (None, None, None), (1, 101, None), (2, 201, ""), (2, 201, "é"), (2, None, "z"), (3, 301, "~"), (1, 101, None)]
    rows = [(q, *e, [None if rng.random() < 0.1 else int(x) for x in rng.integers(-10_000, 10_001, rng.integers(0, 9)) // 2000 * 2000]) for q in range(20) for e in elements]
    lists = spark.createDataFrame(rows, "question_id long, table_id int, column_id int, value string, score array<short>")
    hits = lists.withColumn("step", F.explode("score")).withColumn("score", F.when(F.col("step").isNull(), float("nan")).otherwise(F.col("step") / 10_000))
    columns = ["question_id", *ranking.ELEMENT, "score", "rank"]
    got = ranking.order_hit_lists(lists).select(columns).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, ranking.order_rankings(hits).select(columns).collect()))


def test_all_hits_ranked_without_moving_them_one_by_one(spark):
    questions, docs, *_ = frames(spark)
    docs = docs.withColumns({"table_id": (F.col("vec_id") % 4).cast("int"), "column_id": F.lit(None).cast("int"), "value": F.lit(None).cast("string")})
    lists = search.element_knn(questions, docs, 1000, ranking.ELEMENT, "all")
    assert lists.count() == 40 * 2 * 4
    want = ranking.order_rankings(search.exact_knn(questions, docs, 1000, ranking.ELEMENT))
    got = ranking.order_hit_lists(lists)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("changed", ["", "nan", "sources"])
def test_last_kept_from_either_end(spark, monkeypatch, changed):
    """Equal scores, limits on both sides of half an index, indexes of unequal sizes per source, scores that are no numbers."""
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 40)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    questions, docs, _, _, names = frames(spark)
    sizes = {n: names.count(n) for n in set(names)}
    if changed == "sources":
        docs = docs.withColumn("data_source_id", 1 + (F.col("vec_id") % 7 == 0).cast("int"))
        questions = questions.withColumn("data_source_id", 1 + (F.col("question_id") % 2).cast("int"))
    if changed == "nan":
        docs = docs.withColumn("embedding", F.when(F.col("vec_id") == 5, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    for k in ({"value": 9, "column_name": sizes["column_name"] - 3, "table_name": 10**6}, {n: sizes[n] for n in sizes}, {"value": sizes["value"] - 1, "column_name": sizes["column_name"] + 1}):
        _, back = search._from_the_end(questions, docs, k)
        assert back == ({} if changed == "sources" else {n: sizes[n] - k[n] + 1 for n in sizes if sizes[n] / 2 < k[n] <= sizes[n] and not (changed == "nan" and names[5] == n)})
        want = search.full_knn(questions, docs, k).filter(F.col("rank") == search.limit_column(k, F.col("index_name")))
        got = search.last_kept(questions, docs, k)
        columns = ["question_id", "data_source_id", "index_name", "vec_id", "score", "rank"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_strips_for_the_last_hit_ignore_limits_of_other_indexes(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 40)
    monkeypatch.setattr(search, "LEAST_QUESTIONS", 4)
    monkeypatch.setattr(search, "HELD_HITS", 40)
    questions, docs, *_ = frames(spark)
    plans = []
    plain = search._plan
    monkeypatch.setattr(search, "_plan", lambda *a: plans.append(plain(*a)) or plans[-1])
    search.last_kept(questions, docs.filter("index_name = 'value'"), {"value": 4, "table_name": 10**6})
    assert [p[0] for p in plans] == [8]


def test_no_last_hit_without_documents(spark):
    questions, docs, *_ = frames(spark)
    assert search.last_kept(questions, docs.limit(0), {"value": 3, "column_name": 5}).count() == 0
