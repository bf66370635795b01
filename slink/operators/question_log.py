"""Questions, their groups, and analytics over the question log.

questions: question_id, group_id, text, created (+ generated_sql)
groups: group_id, status, gold_sql
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions import text as T
from slink.operators.grouping import top_k_per_group

CORRECT = "CORRECT"


def read_gold_questions(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of the groups that are marked correct."""
    return groups.filter(F.col("status") == CORRECT).join(questions, "group_id")


def group_questions(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Groups with their questions; those without SQL, source or questions are left out."""
    usable = groups.filter(~T.is_empty(F.col("gold_sql")) & F.col("data_source_id").isNotNull())
    return usable.join(questions, "group_id")


def exclude_completed(groups: DataFrame, flag: bool = True) -> DataFrame:
    return groups.filter(F.coalesce(F.col("status") != CORRECT, F.lit(True))) if flag else groups


def latest_question_per_group(questions: DataFrame) -> DataFrame:
    """Last question of each group, kept by a map-side maximum instead of a sorted group."""
    last = F.max_by(F.struct("question_id", "text", "generated_sql"), F.struct("created", "question_id"))
    return questions.groupBy("group_id").agg(last.alias("last")).select("group_id", "last.*")


def gold_sql_or_generated(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Groups with blank gold SQL take the SQL generated for their last question."""
    latest = latest_question_per_group(questions).select("group_id", "generated_sql")
    gold = F.when(T.is_blank(F.col("gold_sql")), F.lit(None)).otherwise(F.col("gold_sql"))
    return groups.join(latest, "group_id", "left").withColumn("sql", F.coalesce(gold, "generated_sql")).drop("generated_sql")


def unlabelled_questions(questions: DataFrame, evaluation_questions: DataFrame) -> DataFrame:
    """Questions never turned into evaluation questions, one row per text, newest first."""
    return latest_per_text(questions.join(evaluation_questions, "question_id", "left_anti"))


def latest_per_text(questions: DataFrame) -> DataFrame:
    """Newest question of each text; a hot text is one row per task before the shuffle."""
    newest = F.max(F.struct("created", "question_id"))
    return (
        questions.groupBy("text")
        .agg(newest.alias("n"))
        .select("n.question_id", "text", "n.created")
        .orderBy(F.desc("created"), F.desc("question_id"))
    )


def unique_group_questions(questions: DataFrame) -> DataFrame:
    """First question of each exact text in a group."""
    first = F.min(F.struct("created", "question_id"))
    return questions.groupBy("group_id", "text").agg(first.alias("f")).select("group_id", "f.question_id", "text")


def preview(questions: DataFrame, n: int = fixed.PREVIEW_QUESTIONS) -> DataFrame:
    """First n questions of each group, comma-joined."""
    order = [F.col("created"), F.col("question_id")]
    first = top_k_per_group(questions, ["group_id"], order, n, "place", ["question_id"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return first.groupBy("group_id").agg(F.array_join(F.transform(ordered, lambda q: q["text"]), ", ").alias("preview"))


def question_history(log: DataFrame, user_id, source: int | None = None) -> DataFrame:
    """A user's questions, newest first."""
    mine = log.filter(F.col("user_id") == user_id)
    if source is not None:
        mine = mine.filter(F.col("data_source_id") == source)
    return mine.orderBy(F.desc("created"), F.desc("question_id"))


def next_open_group(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Newest group that is not correct and has questions."""
    open_groups = exclude_completed(groups).join(questions, "group_id", "left_semi")
    return open_groups.orderBy(F.desc("created"), F.desc("group_id")).limit(1)


def feedback_state(sql: Column, failed: Column, answer: Column) -> Column:
    """UNGENERATED without SQL, INVALID after a failed run, else the answer or UNANSWERED."""
    return (
        F.when(sql.isNull(), "UNGENERATED")
        .when(failed, "INVALID")
        .otherwise(F.coalesce(answer, F.lit("UNANSWERED")))
    )


def feedback_summary(log: DataFrame) -> DataFrame:
    state = feedback_state(F.col("sql"), F.col("failed"), F.col("answer"))
    return log.groupBy(state.alias("state")).agg(F.count("*").alias("questions"))


def section_tokens(sections: DataFrame, budget: int, strict: bool = False) -> DataFrame:
    """Tokens per question over its prompt sections, what is left, and whether they are too many."""
    used = sections.groupBy("question_id").agg(F.sum(T.count_tokens(F.col("text"))).alias("used_tokens"))
    over = F.col("used_tokens") > budget
    if strict:
        # In a filter, which no selection of columns can prune.
        used = used.filter(F.when(over, F.raise_error(F.lit("prompt is over its token budget")).cast("boolean")).otherwise(True))
    return used.withColumns({"remaining_tokens": budget - F.col("used_tokens"), "over_budget": over})


def char_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy over the characters of each text, in bits.

    Characters are counted on the map side, so a long text leaves its task as
    one row per distinct character.
    """
    chars = df.select(key, F.explode(F.split(text, "")).alias("char")).filter(F.col("char") != "")
    counts = chars.groupBy(key, "char").agg(F.count("*").alias("n"))
    # -sum(p log p) with p = n / total, from sums that need no second pass.
    per_text = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return per_text.select(key, F.round(F.log2("total") - F.col("weighted") / F.col("total"), 6).alias("entropy"))


def few_shot_examples(hits: DataFrame, questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Matched stored questions with their group's gold SQL, where there is one."""
    stored = questions.select(F.col("question_id").alias("matched_id"), "group_id", F.col("text").alias("matched_text"))
    gold = groups.filter(~T.is_empty(F.col("gold_sql"))).select("group_id", "gold_sql")
    return hits.join(stored, "matched_id").join(gold, "group_id")
