"""Labelled training sets from rankings and touches, and the small networks trained on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators.grouping import number_rows, top_k_per_group
from slink.operators.ranking import ELEMENT, FEATURES, MlpWeights, feature_vectors, level
from slink.sources.stores import materialize

KEY = ["question_id", *ELEMENT]
BATCH_ROWS = 256
PART_ROWS = 65_536


def split_of(group_id: Column) -> Column:
    """Split of a question group; one slot in ten is not used."""
    slot = F.pmod(group_id, F.lit(fixed.SPLIT_MODULUS))
    return (
        F.when(slot.isin(fixed.TRAIN_SLOTS), "train")
        .when(slot.isin(fixed.TEST_SLOTS), "test")
        .when(slot.isin(fixed.VALIDATION_SLOTS), "validation")
        .otherwise("unused")
    )


def _null_safe(left: DataFrame, right: DataFrame) -> Column:
    """Equal question and element, NULL column or value included. Question and table stay plain hash keys."""
    return (
        (left["question_id"] == right["question_id"])
        & (left["table_id"] == right["table_id"])
        & left["column_id"].eqNullSafe(right["column_id"])
        & left["value"].eqNullSafe(right["value"])
    )


def positives(scores: DataFrame, touches: DataFrame) -> DataFrame:
    """Touched elements that have scores."""
    touched = touches.select(*KEY).distinct()
    return scores.join(touched, _null_safe(scores, touched), "left_semi")


def missing_positives(scores: DataFrame, touches: DataFrame) -> DataFrame:
    """Touched elements without scores; an error for tables and columns."""
    touched = touches.select(*KEY).distinct()
    return touched.join(scores, _null_safe(touched, scores), "left_anti")


def positives_ci(scores: DataFrame, touches: DataFrame) -> DataFrame:
    """Value touches matched exactly, else by equal lower-case value, best score first.

    One join on the lower-case key finds both kinds; each touch keeps its best
    candidate with a map-side minimum. Touches without any are left out.
    """
    best = F.greatest(*[F.coalesce(F.col(n), F.lit(float("-inf"))) for n in fixed.VALUE_SCORES])
    known = scores.filter(F.col("value").isNotNull()).withColumns({"_lower": F.lower("value"), "_best": best})
    wanted = touches.filter(F.col("value").isNotNull()).select(
        "question_id", "table_id", "column_id", F.col("value").alias("_wanted"), F.lower("value").alias("_lower")
    )
    candidates = wanted.distinct().join(known, ["question_id", "table_id", "column_id", "_lower"])
    order = F.struct((F.col("value") != F.col("_wanted")).alias("inexact"), (-F.col("_best")).alias("worse"), "value")
    row = F.struct(*[c for c in scores.columns if c not in ("question_id", "table_id", "column_id")])
    chosen = candidates.groupBy("question_id", "table_id", "column_id", "_wanted").agg(F.min_by(row, order).alias("row"))
    return chosen.select("question_id", "table_id", "column_id", "row.*").select(*scores.columns).dropDuplicates(KEY)


def negative_pool(scores: DataFrame, positive: DataFrame) -> DataFrame:
    """Scored elements that are not positives."""
    taken = positive.select(*KEY)
    return scores.join(taken, _null_safe(scores, taken), "left_anti")


def sample_order(seed: int) -> Column:
    """Digest that puts a question's elements in a random but repeatable order on any partitioning."""
    parts = [F.lit(str(seed)), F.col("question_id").cast("string"), F.col("table_id").cast("string")]
    return F.md5(F.concat_ws("|", *parts, F.coalesce(F.col("column_id").cast("string"), F.lit("")), F.coalesce("value", F.lit(""))))


def sample_negatives(pool: DataFrame, touches: DataFrame, seed: int = 0) -> DataFrame:
    """As many untouched elements per question and level as were touched. `wanted` shows short pools."""
    wanted = touches.distinct().groupBy("question_id", level().alias("level")).agg(F.count("*").alias("wanted"))
    leveled = pool.withColumn("level", level()).join(wanted, ["question_id", "level"])
    # Cut per salt first: with the training limits a question's pool can be millions of elements.
    order = [sample_order(seed), *[F.col(c) for c in ELEMENT]]
    return top_k_per_group(leveled, ["question_id", "level"], order, F.col("wanted"), "_place", ELEMENT).drop("_place")


def short_pools(sampled: DataFrame) -> DataFrame:
    """Questions and levels with fewer negatives than wanted."""
    return sampled.groupBy("question_id", "level", "wanted").agg(F.count("*").alias("sampled")).filter("sampled < wanted")


def stack_examples(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positives with label 1 on top of negatives with label 0."""
    columns = positive.columns
    return positive.withColumn("label", F.lit(1.0)).unionByName(negative.select(*columns).withColumn("label", F.lit(0.0)))


def build_training_set(features: DataFrame, touches: DataFrame, groups: DataFrame, seed: int = 0) -> DataFrame:
    """Examples of all questions and all three levels at once.

    `features` should be a written table: it is read for the positives and for
    the pool. `groups` gives question_id and group_id, which decides the split.
    """
    exact = touches.filter(F.col("value").isNull())
    positive = positives(features.filter(F.col("value").isNull()), exact).unionByName(positives_ci(features, touches))
    negative = sample_negatives(negative_pool(features, positive), touches.select(*KEY), seed)
    return (
        stack_examples(positive, negative)
        .join(groups.select("question_id", "group_id"), "question_id")
        .select(
            "question_id",
            *ELEMENT,
            level().alias("element_type"),
            split_of(F.col("group_id")).alias("split"),
            feature_vectors().alias("features"),
            "label",
        )
    )


def nan_guard(df: DataFrame, features: str = "features", label: str = "label", strict: bool = True) -> DataFrame:
    """Reject NaN in features or labels: an error, or a flag when not strict."""
    bad = F.exists(features, F.isnan) | F.isnan(label)
    if not strict:
        return df.withColumn("has_nan", bad)
    # In a filter, which no selection of columns can prune.
    return df.filter(F.when(bad, F.raise_error(F.lit("found NaN in a training example")).cast("boolean")).otherwise(True))


def predict(examples: DataFrame, models: dict[str, MlpWeights]) -> DataFrame:
    """Network output per example, by its element type."""

    @F.pandas_udf("double")
    def score(kind: pd.Series, features: pd.Series) -> pd.Series:
        out, kinds = np.zeros(len(kind)), kind.to_numpy()
        for name, model in models.items():
            rows = np.flatnonzero(kinds == name)
            if len(rows):
                out[rows] = model.score(np.stack(features.iloc[rows].to_list()).astype(np.float64))
        return pd.Series(out)

    return examples.withColumn("predicted", score("element_type", "features"))


def evaluate_mse(examples: DataFrame, models: dict[str, MlpWeights]) -> DataFrame:
    """Mean squared error per element type and split."""
    error = F.col("label") - F.col("predicted")
    return predict(examples, models).groupBy("element_type", "split").agg(F.round(F.avg(error * error), 6).alias("mse"))


def initial_weights(inputs: int, hidden: int = fixed.HIDDEN_UNITS, seed: int = 0) -> MlpWeights:
    """Uniform start within 1/sqrt(fan-in), the usual range of a linear layer."""
    rng = np.random.default_rng(seed)
    a, c = 1 / np.sqrt(inputs), 1 / np.sqrt(hidden)
    return MlpWeights(rng.uniform(-a, a, (hidden, inputs)), rng.uniform(-a, a, hidden), rng.uniform(-c, c, hidden), float(rng.uniform(-c, c)))


def _flat(w: MlpWeights) -> np.ndarray:
    return np.concatenate([w.w1.ravel(), w.b1, w.w2, [w.b2]])


def _shaped(theta: np.ndarray, inputs: int, hidden: int) -> MlpWeights:
    n = inputs * hidden
    return MlpWeights(theta[:n].reshape(hidden, inputs), theta[n : n + hidden], theta[n + hidden : n + 2 * hidden], float(theta[-1]))


def _gradient(w: MlpWeights, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Summed gradient of the squared error, followed by the summed error and the row count; a row counts `n` times."""
    n = np.ones(len(y)) if n is None else n
    z = x @ w.w1.T + w.b1
    h = np.maximum(z, 0.0)
    residual = h @ w.w2 + w.b2 - y
    d_out = 2 * n * residual
    d_z = np.outer(d_out, w.w2) * (z > 0)
    parts = [(d_z.T @ x).ravel(), d_z.sum(axis=0), h.T @ d_out, [d_out.sum()], [(n * residual**2).sum()], [n.sum()]]
    return np.concatenate(parts)


def _adam_epochs(
    theta: np.ndarray,
    inputs: int,
    hidden: int,
    rows: tuple[np.ndarray, np.ndarray, np.ndarray],
    epochs: int,
    rate: float,
    seed: tuple,
) -> np.ndarray:
    """Weights after some epochs of Adam over seeded batches of the given rows (features, labels, how often each stands).

    A batch's gradient is scaled by the mean count of all rows, so a row that stands often weighs as much over an epoch as its copies would.
    """
    x, y, n = rows
    theta, step = theta.copy(), 0
    momentum, velocity = np.zeros_like(theta), np.zeros_like(theta)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for start in range(0, len(y), BATCH_ROWS):
            some = order[start : start + BATCH_ROWS]
            gradient = _gradient(_shaped(theta, inputs, hidden), x[some], y[some], n[some])[:-2] / (len(some) * n.mean())
            step += 1
            momentum = 0.9 * momentum + 0.1 * gradient
            velocity = 0.999 * velocity + 0.001 * gradient**2
            theta -= rate * (momentum / (1 - 0.9**step)) / (np.sqrt(velocity / (1 - 0.999**step)) + 1e-8)
    return theta


def placed_rows(examples: DataFrame, kind: str) -> DataFrame:
    """Distinct examples of one element type with their counts `n`, each in a `part` that only the data decide.

    Rows are numbered in the order of their digest, and `PART_ROWS` in a row make a part, whatever the partitions of the input. Copies
    are counted before they move, so a row that is a third of the input is one row here.
    """
    rows = examples.filter(F.col("element_type") == kind).groupBy("features", "label").agg(F.count("*").cast("double").alias("n"))
    digest = F.xxhash64("features", "label")
    numbered = number_rows(rows.withColumn("digest", digest), [], F.shiftright("digest", 52), [F.col(c) for c in ("digest", "features", "label")], "place")
    return numbered.select("features", "label", "n", "place", F.floor(F.col("place") / PART_ROWS).alias("part"))


LOCAL_SCHEMA = "position int, part long, total double"


def _local_round(theta: np.ndarray, shape: tuple[int, int], epochs: int, rate: float, seed: tuple):
    """One part's share of a round: its moved weights times its rows, its squared error, its rows."""

    def local(held: pa.Table) -> pa.Table:
        held = held.sort_by("place")
        x = held["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        rows = x, held["label"].to_numpy(), held["n"].to_numpy()
        part = held["part"][0].as_py()
        error, count = _gradient(_shaped(theta, *shape), *rows)[-2:]
        total = np.concatenate([_adam_epochs(theta, *shape, rows, epochs, rate, (*seed, part)) * count, [error, count]])
        positions = pa.array(np.arange(len(total), dtype=np.int32))
        return pa.table({"position": positions, "part": pa.array(np.full(len(total), part, np.int64)), "total": pa.array(total)})

    return local


def train_mlp(
    examples: DataFrame,
    kind: str,
    epochs: int = 1000,
    learning_rate: float = 1e-3,
    hidden: int = fixed.HIDDEN_UNITS,
    seed: int = 0,
    start: MlpWeights | None = None,
    local_epochs: int = 250,
) -> tuple[MlpWeights, list[float]]:
    """Adam on the mean squared error of one element type; (weights, loss before each round and at the end).

    A round is one job: every part of `placed_rows` takes `local_epochs` epochs of 256-row batches from the common weights, and the
    results are averaged by their row counts, in the order of the parts, to the next common weights. Only that average, a few hundred
    numbers, reaches the driver. The weights depend on the examples and the seed, not on how the examples are partitioned.
    """
    inputs = len(FEATURES[kind])
    written = materialize(placed_rows(examples, kind), "training-rows")
    parts = (written.agg(F.max("part")).first()[0] or 0) + 1
    data = written.repartition(parts, "part").persist()
    theta, losses = _flat(start or initial_weights(inputs, hidden, seed)), []
    rounds = -(-epochs // local_epochs)
    try:
        for number in range(rounds + 1):
            # The last round only measures.
            taken = min(local_epochs, epochs - number * local_epochs) if number < rounds else 0

            local = _local_round(theta, (inputs, hidden), taken, learning_rate, (seed, number))
            moved = data.groupBy("part").applyInArrow(local, LOCAL_SCHEMA)
            by_part = F.array_sort(F.collect_list(F.struct("part", "total")))
            summed = moved.groupBy("position").agg(F.aggregate(by_part, F.lit(0.0), lambda a, p: a + p["total"]).alias("total"))
            rows = summed.orderBy("position").collect()
            if not rows:
                raise ValueError(f"not enough training data for {kind}")
            sums = np.array([r["total"] for r in rows])
            losses.append(float(sums[-2] / sums[-1]))
            theta = sums[:-2] / sums[-1]
    finally:
        data.unpersist()
    return _shaped(theta, inputs, hidden), losses
