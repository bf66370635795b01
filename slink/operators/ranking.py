"""From hits to one ranked list of schema elements per question."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators.block_stream import Kernel, cell_stream
from slink.operators.element_scores import ORDER, SCORE_SCHEMA, all_scores, numbered_documents
from slink.operators.search import (
    DOCUMENT_BLOCK,
    SHOWN_DECIMALS,
    SOURCE,
    cut_points,
    element_knn,
    exact_knn,
    limits_for,
    shown_score,
    source_of,
    strips_and_ranges,
)
from slink.sources.stores import materialize

ELEMENT = ["table_id", "column_id", "value"]
LEVELS = ["table", "column", "value"]
FEATURES = {
    "table": fixed.TABLE_SCORES,
    "column": fixed.TABLE_SCORES + fixed.COLUMN_SCORES,
    "value": fixed.VALUE_SCORES,
}
DEFAULT_WEIGHTS = dict(
    zip(fixed.ALL_INDEXES, fixed.TABLE_WEIGHTS + fixed.COLUMN_WEIGHTS + fixed.VALUE_WEIGHTS, strict=True)
)


def level() -> Column:
    return F.when(F.col("value").isNotNull(), "value").when(F.col("column_id").isNotNull(), "column").otherwise("table")


def element_order() -> list[Column]:
    """Total order of elements: tables, then columns, then values, each by id."""
    kind = F.when(F.col("value").isNotNull(), 2).when(F.col("column_id").isNotNull(), 1).otherwise(0)
    return [kind, F.col("table_id"), F.coalesce("column_id", F.lit(-1)), F.coalesce("value", F.lit(""))]


def weight_scores(hits: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Score times the weight of its index; `-0.0` becomes `0.0`."""
    weight = F
    for name, value in weights.items():
        weight = weight.when(F.col("index_name") == name, F.lit(float(value)))
    weighted = F.round(F.col("score") * weight, 6)
    return hits.withColumn("score", F.when(weighted == 0, F.lit(0.0)).otherwise(weighted))


def best_score(scored: DataFrame) -> DataFrame:
    """Highest score per question and element."""
    return scored.groupBy("question_id", *ELEMENT).agg(F.max("score").alias("score"))


def order_rankings(scored: DataFrame) -> DataFrame:
    """`rank` from 1 per question by score, ties by element. Elements per question are bounded by the hit limits."""
    window = Window.partitionBy("question_id").orderBy(F.desc("score"), *element_order())
    return scored.withColumn("rank", F.row_number().over(window))


RANKED_AT_ONCE = 200_000  # hits that a task puts in order at a time, or those of one question


def _ranked_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`order_rankings` of rows that come question by question, with a list of scores each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("question_id")
        last = pc.index(ids, ids[-1]).as_py()
        if last or held and held[-1].column("question_id")[-1] != ids[0]:
            yield from _rank_questions(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _rank_questions(pa.Table.from_batches(held))


def _rank_questions(lists: pa.Table) -> Iterator[pa.RecordBatch]:
    lists = lists.combine_chunks()
    ids = lists["question_id"].combine_chunks()
    sizes = pc.list_value_length(lists["score"].combine_chunks()).to_numpy()
    starts = np.flatnonzero(np.r_[True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)]) if len(ids) else np.zeros(0, int)
    before = np.r_[0, np.cumsum(sizes)]
    first = 0
    while first < len(starts):
        after = max(first + 1, int(np.searchsorted(before[starts], before[starts[first]] + RANKED_AT_ONCE)))
        end = starts[after] if after < len(starts) else len(ids)
        yield _rank(lists.slice(starts[first], end - starts[first]), starts[first:after] - starts[first])
        first = after


def _rank(lists: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Rows of whole questions, which begin at `starts`, to one row per score in ranking order."""
    elements = list(zip(*(lists[c].to_pylist() for c in ELEMENT), strict=True))
    places = {e: i for i, e in enumerate(sorted(set(elements), key=_element_key))}
    place = np.array([places[e] for e in elements], np.int64)
    scores = lists["score"].combine_chunks()
    row = np.repeat(np.arange(len(place)), pc.list_value_length(scores).to_numpy())
    steps = scores.flatten()
    no_number = steps.is_null().to_numpy(zero_copy_only=False)
    steps = steps.fill_null(0).to_numpy().astype(np.int64)
    question = np.searchsorted(starts, row, side="right") - 1
    # NaN stands above all numbers.
    falling = np.where(no_number, 0, 2 * 10**SHOWN_DECIMALS - steps)
    order = np.argsort((question * (4 * 10**SHOWN_DECIMALS) + falling) * len(places) + place[row])
    question, chosen = question[order], pa.array(row[order])
    rank = np.arange(len(order)) - np.searchsorted(question, np.arange(len(starts)))[question] + 1
    score = np.where(no_number, np.nan, steps / 10.0**SHOWN_DECIMALS)[order]
    columns = [lists[c].combine_chunks().take(chosen) for c in ("question_id", *ELEMENT)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(rank.astype(np.int32))], names=["question_id", *ELEMENT, "score", "rank"])


def _element_key(element: tuple) -> tuple:
    """`element_order`, nulls first."""
    table, column, value = element
    kind = 2 if value is not None else 1 if column is not None else 0
    return kind, table is not None, table or 0, -1 if column is None else column, value or ""


def order_hit_lists(lists: DataFrame) -> DataFrame:
    """`order_rankings` of all hits, which come as one list of scores per question, index and element (`element_knn`).

    So a hit is moved as two bytes, and is a row of its own only when it has its rank.
    """
    typed = lists.select("question_id", *[F.col(c).cast(t).alias(c) for c, t in zip(ELEMENT, ("int", "int", "string"), strict=True)], "score")
    placed = typed.repartition("question_id").sortWithinPartitions("question_id")
    return placed.mapInArrow(_ranked_lists, "question_id long, table_id int, column_id int, value string, score double, rank int")


def dedup_rankings(ranked: DataFrame) -> DataFrame:
    """First entry of each element in ranking order, ranked anew."""
    return order_rankings(best_score(ranked))


def union_levels(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def merge_rankings(first: DataFrame, second: DataFrame) -> DataFrame:
    columns = ["question_id", *ELEMENT, "score"]
    return dedup_rankings(union_levels(first.select(*columns), second.select(*columns)))


def index_scores(element_hits: DataFrame) -> DataFrame:
    """Nine scores per question and element. Of several chunks of one element the lowest kept hit counts."""
    measures = [F.min(F.when(F.col("index_name") == name, F.col("score"))).alias(f"{name}_score") for name in fixed.ALL_INDEXES]
    return element_hits.groupBy("question_id", *ELEMENT).agg(*measures)


def copy_table_scores(features: DataFrame) -> DataFrame:
    """Column rows get the three scores of their table.

    A window over (question, table) instead of a self-join: the wide rows are
    computed and shuffled once.
    """
    same_table = Window.partitionBy("question_id", "table_id")
    is_table, is_column = level() == "table", level() == "column"
    copied = {
        name: F.when(is_column, F.max(F.when(is_table, F.col(name))).over(same_table)).otherwise(F.col(name))
        for name in fixed.TABLE_SCORES
    }
    return features.withColumns(copied)


WIDE_CELLS = 2_000_000  # scores of elements side by side that a task holds


def with_cuts(questions: DataFrame, documents: DataFrame, limits: tuple[int, int]) -> tuple[DataFrame, list[int]]:
    """Questions with the last hits they keep, and the numbers of the indexes that have more documents than that."""
    names, cuts = cut_points(questions, documents, limits_for(limits))
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), source_of(questions), "embedding").filter(F.col(SOURCE).isNotNull())
    return asked.join(cuts, "question_id", "left") if names else asked, [fixed.ALL_INDEXES.index(n) for n in names]


def element_stream(questions: DataFrame, documents: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """What `kernel` gives for strips of questions with all documents, which pass table by table and element by element.

    With fewer strips than cores documents are dealt to ranges by table and element; a table's own documents go to
    every range that has elements of it, and `own` says in which of them the table itself counts.
    """
    strips, ranges = strips_and_ranges(questions, documents)
    strip = F.pmod(F.xxhash64("question_id"), F.lit(strips)) * ranges
    left = questions.withColumn("cell", F.explode(F.sequence(strip, strip + (ranges - 1))))
    right = numbered_documents(documents)
    if ranges == 1:
        right = right.withColumns({"range": F.lit(0), "own": F.lit(True)})
    else:
        sizes = materialize(right.groupBy(SOURCE, "table_id").agg(F.ceil(F.count("*") / DOCUMENT_BLOCK).cast("int").alias("slots")), "table-sizes")
        placed = right.join(sizes, [SOURCE, "table_id"])

        def of_slot(slot: Column) -> Column:
            return F.pmod(F.xxhash64(SOURCE, "table_id", slot), F.lit(ranges))

        everywhere = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda slot: of_slot(slot.cast("int"))))
        mine = of_slot(F.pmod(F.xxhash64("column_id", "value"), F.col("slots")).cast("int"))
        right = placed.withColumn("range", F.explode(F.when(level() == "table", everywhere).otherwise(F.array(mine))))
        right = right.withColumn("own", (level() != "table") | (F.col("range") == of_slot(F.lit(0)))).drop("slots")
    right = right.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = right.withColumn("cell", F.col("strip") * ranges + F.col("range")).drop("strip", "range")
    return cell_stream(left, right, strips * ranges, kernel, schema, ORDER, DOCUMENT_BLOCK)


def score_features(questions: DataFrame, documents: DataFrame, limits: tuple[int, int] = fixed.TRAINING_RANK_LIMITS) -> DataFrame:
    """One wide row per question and element found in any index.

    Documents pass a strip of questions element by element, a table's own first, so a task gives finished rows however
    many documents an element has: nothing of the size of questions times elements or hits is shuffled. Only indexes
    with more documents than the limit are searched before, for the last hit that each question keeps.
    """
    asked, over = with_cuts(questions, documents, limits)
    found = element_stream(asked, documents, all_scores(over, WIDE_CELLS), SCORE_SCHEMA)
    return found.withColumns({"table_id": F.col("table_id").cast("int"), "column_id": F.col("column_id").cast("int"), **{n: shown_score(n) for n in fixed.ALL_SCORES}})


def feature_vector(kind: str) -> Column:
    """3, 7 or 2 scores in fixed order, missing ones as 0."""
    return F.array(*[F.coalesce(F.col(name), F.lit(0.0)) for name in FEATURES[kind]])


def feature_vectors() -> Column:
    """Feature vector that fits the row's own level."""
    return (
        F.when(level() == "table", feature_vector("table"))
        .when(level() == "column", feature_vector("column"))
        .otherwise(feature_vector("value"))
    )


def weighted_rank(
    questions: DataFrame,
    documents: DataFrame,
    weights: dict[str, float] = DEFAULT_WEIGHTS,
    limits: tuple[int, int] = fixed.WEIGHTED_RANK_LIMITS,
) -> DataFrame:
    """Nine searches, weighted, best per element, one descending list per question.

    Unless a weight is negative the highest of an element's hits in an index weighs most, so only that one is moved.
    """
    search = element_knn if min(weights.values(), default=0) >= 0 else exact_knn
    hits = search(questions, documents, limits_for(limits), ELEMENT)
    return order_rankings(best_score(weight_scores(hits, weights)))


@dataclass(frozen=True)
class MlpWeights:
    """Linear(n, hidden), ReLU, Linear(hidden, 1)."""

    w1: np.ndarray  # hidden x n
    b1: np.ndarray  # hidden
    w2: np.ndarray  # hidden
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1.T + self.b1, 0.0) @ self.w2 + self.b2


def mlp_score(features: DataFrame, models: dict[str, MlpWeights], decimals: int = 6) -> DataFrame:
    """`score` of every row by the network of its level; value scores are scaled down.

    One Arrow pass scores all three levels as matrix products.
    """

    @F.pandas_udf("double")
    def score(kind: pd.Series, *scores: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=np.float64, na_value=0.0) for s in scores])
        out = np.zeros(len(kind))
        kinds = kind.to_numpy()
        for name, model in models.items():
            rows = np.flatnonzero(kinds == name)
            if len(rows):
                used = [fixed.ALL_SCORES.index(f) for f in FEATURES[name]]
                y = model.score(x[np.ix_(rows, used)])
                out[rows] = y * fixed.VALUE_SCORE_SCALE if name == "value" else y
        return pd.Series(out)

    raw = score(level(), *[F.col(name) for name in fixed.ALL_SCORES])
    return features.withColumn("score", F.round(raw, decimals))


def learned_rank(
    questions: DataFrame,
    documents: DataFrame,
    models: dict[str, MlpWeights],
    limits: tuple[int, int] = fixed.LEARNED_RANK_LIMITS,
) -> DataFrame:
    """Features, network per level, one descending list per question."""
    scored = mlp_score(score_features(questions, documents, limits), models)
    return order_rankings(scored.select("question_id", *ELEMENT, "score"))
