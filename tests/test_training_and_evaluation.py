import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions.text import canonical_row, content_hash
from slink.operators import catalog, documents, evaluation, question_log, ranking, training
from slink.sources import stores

FEATURE_SCHEMA = "question_id long, table_id int, column_id int, value string, " + ", ".join(f"{n} double" for n in fixed.ALL_SCORES)
TOUCH_SCHEMA = "question_id long, table_id int, column_id int, value string"


def features(spark, elements):
    rows = [(q, t, c, v, *([s] * 9)) for q, t, c, v, s in elements]
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


def test_values_match_exactly_before_case(spark):
    scores = features(spark, [(1, 1, 101, "Paid", 0.9), (1, 1, 101, "paid", 0.1), (1, 1, 101, "OPEN", 0.5), (1, 1, 101, "Open", 0.6), (1, 1, 102, "gone", 0.3)])
    touched = spark.createDataFrame([(1, 1, 101, "paid"), (1, 1, 101, "open"), (1, 1, 101, "gone"), (1, 1, 101, None)], TOUCH_SCHEMA)
    assert sorted(r.value for r in training.positives_ci(scores, touched).collect()) == ["Open", "paid"]


def test_positives_pool_and_sample(spark):
    scores = features(spark, [(q, t, None, None, 0.5) for q in (1, 2) for t in range(10)])
    touched = spark.createDataFrame([(1, 3, None, None), (1, 4, None, None), (2, 5, None, None), (2, 77, None, None)], TOUCH_SCHEMA)
    positive = training.positives(scores, touched)
    assert sorted((r.question_id, r.table_id) for r in positive.collect()) == [(1, 3), (1, 4), (2, 5)]
    assert [r.table_id for r in training.missing_positives(scores, touched).collect()] == [77]
    pool = training.negative_pool(scores, positive)
    assert pool.count() == 17
    key = lambda df: sorted((r.question_id, r.table_id) for r in df.collect())
    once, again = training.sample_negatives(pool, touched, 7), training.sample_negatives(pool.repartition(13), touched, 7)
    assert key(once) == key(again) and len(key(once)) == 4
    assert not set(key(once)) & set(key(positive))
    assert key(training.sample_negatives(pool, touched, 8)) != key(once)


def test_short_pool_is_reported(spark):
    scores = features(spark, [(1, t, None, None, 0.5) for t in range(3)])
    touched = spark.createDataFrame([(1, 0, None, None), (1, 1, None, None)], TOUCH_SCHEMA)
    sampled = training.sample_negatives(training.negative_pool(scores, training.positives(scores, touched)), touched)
    assert [(r.wanted, r.sampled) for r in training.short_pools(sampled).collect()] == [(2, 1)]


def test_splits(spark):
    got = [r.s for r in spark.range(10).select(training.split_of(F.col("id")).alias("s")).collect()]
    assert got == ["train"] * 7 + ["test", "validation", "unused"]


def test_training_lowers_the_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        x = rng.random(3)
        rows.append(("table", "train", x.tolist(), float(x[0] > 0.5)))
    examples = spark.createDataFrame(rows, "element_type string, split string, features array<double>, label double").repartition(5)
    model, losses = training.train_mlp(examples, "table", epochs=200, learning_rate=0.02)
    assert losses[-1] < losses[0] / 2
    mse = training.evaluate_mse(examples, {"table": model}).first()["mse"]
    assert mse <= losses[-1] + 1e-6
    with pytest.raises(ValueError, match="not enough training data"):
        training.train_mlp(examples, "column", epochs=1)
    # Several parts that are averaged after each round.
    monkeypatch.setattr(training, "PART_ROWS", 16)
    _, averaged = training.train_mlp(examples, "table", epochs=200, learning_rate=0.02, local_epochs=10)
    assert len(averaged) == 21 and averaged[-1] < averaged[0] / 2


def plain_adam(model, x, y, n, epochs, rate, seed):
    """Adam written out for one part, weight by weight of the network."""
    theta = training._flat(model)
    m, v, t = np.zeros(len(theta)), np.zeros(len(theta)), 0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for first in range(0, len(y), 256):
            slope = np.zeros(len(theta))
            for i in order[first : first + 256]:
                w = training._shaped(theta, x.shape[1], len(model.b1))
                z = w.w1 @ x[i] + w.b1
                on = (z > 0) * 1.0
                error = 2 * n[i] * (w.w2 @ (z * on) + w.b2 - y[i])
                slope += np.concatenate([np.outer(error * w.w2 * on, x[i]).ravel(), error * w.w2 * on, error * z * on, [error]])
            slope /= len(order[first : first + 256]) * n.sum() / len(n)
            t += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def test_weights_depend_on_the_examples_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    distinct = [("table", x.tolist(), float(x[0] > 0.5)) for x in rng.random((300, 3))]
    # A third of the rows is one row.
    rows = distinct + [distinct[7]] * 150
    examples = spark.createDataFrame(rows, "element_type string, features array<double>, label double")
    start = training.initial_weights(3, 4, seed=2)
    options = dict(epochs=3, learning_rate=0.01, hidden=4, start=start, local_epochs=2)
    thetas = {}
    for part_rows in (65_536, 64):
        monkeypatch.setattr(training, "PART_ROWS", part_rows)
        few, _ = training.train_mlp(examples.coalesce(1), "table", **options)
        many, _ = training.train_mlp(examples.orderBy(F.rand(1)).repartition(7), "table", **options)
        thetas[part_rows] = training._flat(few)
        assert (thetas[part_rows] == training._flat(many)).all()
        placed = training.placed_rows(examples, "table").toPandas().sort_values("place")
        assert len(placed) == 300 and placed["n"].sum() == 450 and placed["n"].max() == 151
        assert placed.groupby("part").size().max() <= part_rows
        # Each part alone, averaged by rows after each round.
        model = start
        for number, epochs in ((0, 2), (1, 1)):
            moved, total = 0.0, 0.0
            for part, held in placed.groupby("part"):
                x, y, n = np.stack(held["features"]), held["label"].to_numpy(), held["n"].to_numpy()
                moved = moved + n.sum() * plain_adam(model, x, y, n, epochs, 0.01, (0, number, part))
                total += n.sum()
            model = training._shaped(moved / total, 3, 4)
        assert np.abs(training._flat(model) - thetas[part_rows]).max() < 1e-9
    assert (thetas[64] != thetas[65_536]).any()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x, y = rng.random((20, 3)), rng.random(20)
    theta = training._flat(training.initial_weights(3, 5, seed=1))
    gradient = training._gradient(training._shaped(theta, 3, 5), x, y)
    for i in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        loss = lambda t: ((training._shaped(t, 3, 5).score(x) - y) ** 2).sum()
        assert abs((loss(up) - loss(down)) / 2e-6 - gradient[i]) < 1e-4


def test_nan_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([float("nan"), 1.0], 0.0)], "features array<double>, label double")
    assert [r.has_nan for r in training.nan_guard(df, strict=False).collect()] == [False, True]
    with pytest.raises(Exception, match="found NaN"):
        training.nan_guard(df).collect()


def test_training_store(spark, tmp_path):
    df = spark.createDataFrame([("table", "train", 1), ("table", "test", 2)], "element_type string, split string, n int")
    stores.write_training(df, str(tmp_path / "t"))
    assert [r.n for r in stores.read_training(spark, str(tmp_path / "t"), "table", "train").collect()] == [1]
    with pytest.raises(ValueError, match="add more evaluation questions"):
        stores.read_training(spark, str(tmp_path / "t"), "value", "train")


def result(spark, rows):
    return spark.createDataFrame(rows, "case_id long, row_idx long, cells array<string>")


def test_result_match_is_lopsided(spark):
    old = result(spark, [(1, 0, ["1", "2"]), (1, 1, ["3", "4"]), (2, 0, ["a"]), (3, 0, ["a"]), (3, 1, ["b"]), (4, 0, ["x"])])
    new = result(spark, [(1, 0, ["1", "2"]), (1, 1, ["3", "4"]), (1, 2, ["5", "6"]), (2, 0, ["b"]), (3, 0, ["a"]), (4, 0, ["x"])])
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "case_id long")
    loose = {r.case_id: r.matched for r in evaluation.result_match(cases, old, new).collect()}
    assert loose == {1: True, 2: False, 3: False, 4: True, 5: True}
    strict = {r.case_id: r.matched for r in evaluation.result_match(cases, old, new, strict=True).collect()}
    assert strict == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert sorted((r.case_id, r.row_idx) for r in evaluation.result_diff(old, new).collect()) == [(1, 2), (2, 0), (3, 1)]


def test_column_order_and_names_do_not_matter(spark):
    a = spark.createDataFrame([(1, 2.5, None)], "a int, b double, c string")
    z = spark.createDataFrame([(None, 1, 2.5)], "x string, y int, z double")
    assert a.select(canonical_row(a, a.columns)).first()[0] == z.select(canonical_row(z, z.columns)).first()[0] == ["1", "2.500000000e+00", "None"]


def test_cells_keep_nan_infinity_null_and_small_numbers_apart(spark):
    values = [float("nan"), float("inf"), float("-inf"), None, 0.00001, 0.00004, 0.0, 1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    cells = [r[0] for r in df.select(canonical_row(df, ["x"])).collect()]
    assert len({c[0] for c in cells}) == len(values)
    close = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (-0.0,), (0.0,)], "x double")
    a, b, c, d = (r[0][0] for r in close.select(canonical_row(close, ["x"])).collect())
    assert a == b and c == d


def test_strict_errors_survive_pruning(spark):
    examples = spark.createDataFrame([(1, [1.0, float("nan")], 0.0)], "id int, features array<double>, label double")
    with pytest.raises(Exception, match="found NaN"):
        training.nan_guard(examples).select("id").collect()
    sections = spark.createDataFrame([(1, "many words are here")], "question_id long, text string")
    with pytest.raises(Exception, match="over its token budget"):
        question_log.section_tokens(sections, 1, strict=True).select("question_id").collect()


def test_cache_lifetime_repeats_and_empty_results(spark):
    when = datetime.datetime(2024, 1, 10)
    hours = datetime.timedelta(hours=1)
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "text string")
    rows = [("a", "old", when - 50 * hours), ("a", "new", when - hours), ("a", "older", when - 3 * hours), ("b", "gone", when - 48 * hours), ("c", "", when)]
    cache = spark.createDataFrame(rows, "text string, cached_value string, cached_at timestamp").select(
        content_hash(F.col("text")).alias("key"), "cached_value", "cached_at"
    )
    looked, misses = documents.cache_lookup(requests, cache, "text", now=F.lit(when))
    assert sorted((r.text, r.hit, r.cached_value) for r in looked.collect()) == [("a", True, "new"), ("b", False, None), ("c", False, None), ("d", False, None)]
    assert sorted(r.text for r in misses.collect()) == ["b", "c", "d"]
    computed = misses.select("key", F.lit("x").alias("cached_value"), F.lit(when).alias("cached_at"))
    once = documents.append_to_cache(cache, computed)
    assert documents.append_to_cache(once, computed).count() == once.count()


def test_report(spark):
    cases = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 20, 3)], "case_id long, group_id long, question_id long")
    rows = result(spark, [(1, 0, ["a"]), (2, 0, ["b"])])
    report = evaluation.evaluation_report(
        cases, rows, rows, spark.createDataFrame([(20,)], "group_id long"), spark.createDataFrame([(2,)], "case_id long")
    )
    assert sorted((r.group_id, r.question_id, r.score) for r in report.collect() if r.question_id) == [(10, 1, 1), (10, 2, 0)]
    assert [(r.group_id, r.score) for r in report.collect() if r.question_id is None] == [(20, 0)]
    assert evaluation.accuracy(report).first()["accuracy"] == pytest.approx(1 / 3)
    assert evaluation.accuracy(report.limit(0)).first()["accuracy"] is None


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "x", y', 1.5), (2, "line\r\nbreak\tand \\n", None), (3, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, note string, x double")
    stores.write_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_bytes().decode()
    assert text.startswith("id,note,x\r\n") and text.count("\r\n") == 4
    assert [tuple(r) for r in stores.read_csv(spark, str(tmp_path / "c"), df.schema).orderBy("id").collect()] == rows


def test_profile_with_nulls_long_texts_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", 0.0), ("a" * 100, -0.0), (None, 1.0), ("a" * 100, None)], "s string, d double")
    got = {(r.table_name, r.column_name): (r.rows, r.distinct_rows, r.null_rows) for r in catalog.profile(spark, {"t": df, "empty": df.limit(0)}).collect()}
    assert got == {("T", "S"): (4, 2, 1), ("T", "D"): (4, 2, 1), ("EMPTY", "S"): (0, 0, 0), ("EMPTY", "D"): (0, 0, 0)}
    approx = {(r.table_name, r.column_name): (r.rows, r.distinct_rows) for r in catalog.profile(spark, {"t": df}, approx=True).collect()}
    assert approx == {("T", "S"): (4, 2), ("T", "D"): (4, 2)}


def test_upsert_actions(spark):
    schema = "k string, n int"
    current = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    incoming = spark.createDataFrame([("b", 3), ("c", 4)], schema)
    got = {r.k: (r.n, r.action) for r in catalog.catalog_upsert(current, incoming, ["k"], ["n"]).collect()}
    assert got == {"a": (1, "keep"), "b": (3, "update"), "c": (4, "insert")}


def test_mlp_score_matches_numpy(spark):
    models = {k: training.initial_weights(len(ranking.FEATURES[k]), seed=i) for i, k in enumerate(ranking.LEVELS)}
    df = features(spark, [(1, 1, None, None, 0.4), (1, 1, 101, None, 0.5), (1, 1, 101, "v", 0.6)])
    got = {ranking.LEVELS[(r.column_id is not None) + (r.value is not None)]: r.score for r in ranking.mlp_score(df, models).collect()}
    for kind, x in zip(ranking.LEVELS, (0.4, 0.5, 0.6)):
        want = models[kind].score(np.full((1, len(ranking.FEATURES[kind])), x))[0] * (0.9 if kind == "value" else 1)
        assert got[kind] == pytest.approx(want, abs=1e-6)
