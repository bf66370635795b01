"""Schema linking: from questions to one packed DDL text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators import documents as documents_
from slink.operators import packing, ranking
from slink.operators.documents import Embedder
from slink.operators.ranking import ELEMENT, MlpWeights


def few_shot_rankings(examples: DataFrame, touches: DataFrame) -> DataFrame:
    """Elements touched by the gold SQL of matched questions, all with the same high score.

    `examples` has question_id and matched_id; `touches` has matched_id and the elements.
    """
    touched = examples.select("question_id", "matched_id").join(touches, "matched_id")
    return touched.select("question_id", *ELEMENT).distinct().withColumn("score", F.lit(fixed.FEW_SHOT_SCORE))


def link_schema(
    questions: DataFrame,
    documents: DataFrame,
    columns: DataFrame,
    budget: Column | int,
    few_shot: tuple[DataFrame, DataFrame] | None = None,
    models: dict[str, MlpWeights] | None = None,
    default_pattern: str = fixed.DEFAULT_COLUMN_PATTERN,
) -> DataFrame:
    """One row per question with its schema text: search, rank, merge few-shot elements, pack.

    Ranks by fixed weights, or by the given networks. `few_shot` is the pair
    (examples, touches) of `few_shot_rankings`.
    """
    if models is None:
        ranked = ranking.weighted_rank(questions, documents)
    else:
        ranked = ranking.learned_rank(questions, documents, models)
    if few_shot is not None:
        ranked = ranking.merge_rankings(ranked, few_shot_rankings(*few_shot))
    return packing.pack_schema(ranked, columns, budget, default_pattern)


def link_question_texts(
    questions: DataFrame,
    index: DataFrame,
    columns: DataFrame,
    budget: Column | int,
    embedder: Embedder | None = None,
    **options,
) -> DataFrame:
    """One row per question from its `text`: embed as the index was embedded, then `link_schema`.

    `index` and `columns` are those of an import (`warehouse_import.read_imported`).
    """
    asked = questions.withColumn("question_id", F.col("question_id").cast("long"))
    return link_schema(documents_.embed(asked, "text", embedder), index, columns, budget, **options)
