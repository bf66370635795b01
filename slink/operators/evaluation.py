"""Comparison of result sets and the evaluation report.

Results are long: case_id, row_idx, cells (sorted text, see `canonical_row`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positional_row_join(old: DataFrame, new: DataFrame, keep_extra: bool = False) -> DataFrame:
    """Row i of the old result next to row i of the new one.

    Keyed by (case, position): even one case with most of the rows spreads
    over all tasks.
    """
    left = old.select("case_id", "row_idx", F.col("cells").alias("old_cells"))
    right = new.select("case_id", "row_idx", F.col("cells").alias("new_cells"))
    return left.join(right, ["case_id", "row_idx"], "full_outer" if keep_extra else "left")


def result_match(cases: DataFrame, old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Whether every old row equals the new row at its place. Extra new rows pass unless strict.

    A case without any old rows matches.
    """
    pairs = positional_row_join(old, new, keep_extra=strict)
    equal = F.coalesce(F.col("old_cells") == F.col("new_cells"), F.lit(False))
    per_case = pairs.groupBy("case_id").agg(F.bool_and(equal).alias("matched"))
    return cases.join(per_case, "case_id", "left").withColumn("matched", F.coalesce("matched", F.lit(True)))


def result_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that differ, and rows only one side has."""
    pairs = positional_row_join(old, new, keep_extra=True)
    return pairs.filter(~F.col("old_cells").eqNullSafe(F.col("new_cells")))


def error_cases(matches: DataFrame, errors: DataFrame) -> DataFrame:
    """0/1 score per case; a failing query scores 0."""
    failed = errors.select("case_id", F.lit(True).alias("failed")).distinct()
    score = F.when(F.coalesce("failed", F.lit(False)), 0).otherwise(F.col("matched").cast("int"))
    return matches.join(failed, "case_id", "left").withColumn("score", score).drop("failed")


def evaluation_report(cases: DataFrame, old: DataFrame, new: DataFrame, old_errors: DataFrame, new_errors: DataFrame) -> DataFrame:
    """Score per (group, question). A failing gold query scores its group 0 once, without a question.

    `cases` has case_id, group_id, question_id; old errors are keyed by group,
    new errors by case.
    """
    scored = error_cases(result_match(cases, old, new), new_errors)
    failed_groups = old_errors.select("group_id").distinct()
    usable = scored.join(failed_groups, "group_id", "left_anti").select("group_id", "question_id", "score")
    gold_failed = cases.select("group_id").distinct().join(failed_groups, "group_id", "left_semi").select(
        "group_id", F.lit(None).cast("long").alias("question_id"), F.lit(0).alias("score")
    )
    return usable.unionByName(gold_failed)


def accuracy(scores: DataFrame) -> DataFrame:
    """Share of ones; NULL when there is nothing to score."""
    return scores.agg(F.avg("score").alias("accuracy"), F.count("*").alias("cases"))


def outcome_counts(scores: DataFrame) -> DataFrame:
    outcome = F.when(F.col("score") == 1, "correct").otherwise("incorrect")
    return scores.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("cases"))
