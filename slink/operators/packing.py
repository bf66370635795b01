"""Packing ranked elements into a token budget, and rendering them as DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions import render
from slink.functions.text import count_tokens, is_empty
from slink.operators.grouping import top_k_per_group


def column_costs(columns: DataFrame, default_pattern: str = fixed.DEFAULT_COLUMN_PATTERN, dialect: str = "postgres") -> DataFrame:
    """Line, tokens (one more for the line break) and default flag per column; dropped columns cost nothing."""
    shown_type = render.render_type(F.col("type"), dialect)
    line = render.column_line(F.col("column_name"), F.col("shown_type"))
    return columns.withColumn("shown_type", shown_type).select(
        "table_id",
        "fqn",
        "column_id",
        "ordinal",
        "column_name",
        "shown_type",
        F.col("column_name").rlike(default_pattern).alias("is_default"),
        F.coalesce(count_tokens(line) + 1, F.lit(0)).alias("column_cost"),
    )


def table_costs(costs: DataFrame) -> DataFrame:
    """Header tokens plus those of the default columns, per table."""
    defaults = F.sum(F.when(F.col("is_default"), F.col("column_cost")).otherwise(0))
    return costs.groupBy("table_id", "fqn").agg(defaults.alias("default_cost")).select(
        "table_id", "fqn", (count_tokens(render.table_header(F.col("fqn"))) + F.col("default_cost")).alias("table_cost")
    )


def element_cost(ranked: DataFrame, costs: DataFrame) -> DataFrame:
    """Tokens each ranked element adds, given the elements before it.

    A table costs its header and default columns when first seen, a column its
    line when first seen, a value its text while fewer than six hints are
    stored. First occurrences are window positions, so there is no loop; all
    windows share one shuffle by question, whose size the hit limits bound.
    """
    elements = (
        ranked.join(table_costs(costs).drop("fqn"), "table_id", "left")
        .join(costs.select("column_id", "column_name", "shown_type", "column_cost", "is_default"), "column_id", "left")
        .repartition("question_id")
    )
    table = ["question_id", "table_id"]
    column = [*table, "column_id"]

    def first_of(keys: list[str]) -> Column:
        return F.min("rank").over(Window.partitionBy(*keys)) == F.col("rank")

    has_column = F.col("column_id").isNotNull()
    has_hint = has_column & ~is_empty(F.col("value"))
    # From the finest key to the coarsest, so one sort serves all three.
    marked = (
        elements.withColumn("first_hint", has_hint & first_of([*column, "value"]))
        .withColumn("first_column", has_column & first_of(column))
        .withColumn("first_table", first_of(table))
    )
    so_far = Window.partitionBy(*column).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("hint_no", F.when(F.col("first_hint"), F.sum(F.col("first_hint").cast("int")).over(so_far)))
    hint_cost = F.coalesce(count_tokens(render.hint_cost_text(F.col("value"), F.col("hint_no"))), F.lit(0))
    unknown = F.lit("ranked element is not in the catalogue")
    cost = (
        F.when(F.col("first_table"), F.coalesce("table_cost", F.raise_error(unknown))).otherwise(0)
        + F.when(F.col("first_column") & ~F.coalesce("is_default", F.raise_error(unknown)), F.col("column_cost")).otherwise(0)
        + hint_cost
    )
    return numbered.withColumn("cost", cost.cast("long")).drop("table_cost", "column_cost", "first_table", "first_column")


def pack_budget(costed: DataFrame, budget: Column | int) -> DataFrame:
    """Elements in rank order until the tokens before one exceed the budget, so one overshoot is allowed."""
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return costed.withColumn("tokens_before", F.coalesce(F.sum("cost").over(before), F.lit(0))).filter(F.col("tokens_before") <= limit)


def cap_hints(ranked: DataFrame) -> DataFrame:
    """First six distinct hints of each column in rank order, numbered from 1."""
    hinted = ranked.filter(F.col("column_id").isNotNull() & ~is_empty(F.col("value")))
    distinct = hinted.groupBy("question_id", "table_id", "column_id", "value").agg(F.min("rank").alias("rank"))
    keys = ["question_id", "table_id", "column_id"]
    stored = top_k_per_group(distinct, keys, [F.col("rank")], fixed.HINTS_STORED, "hint_no", ["value"])
    return stored.withColumn("rendered", F.col("hint_no") <= fixed.HINTS_RENDERED)


def table_output_order(ranked: DataFrame) -> DataFrame:
    """Tables in reverse order of first sight."""
    seen = ranked.groupBy("question_id", "table_id").agg(F.min("rank").alias("first_rank"))
    position = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("first_rank")))
    return seen.withColumn("position", position)


def table_entries(costs: DataFrame) -> DataFrame:
    """Per table its name and default columns with their plain lines, in catalogue order."""
    line = render.column_line(F.col("column_name"), F.col("shown_type"))
    entry = F.when(F.col("is_default"), F.struct("ordinal", "column_id", line.alias("line")))
    return costs.groupBy("table_id", "fqn").agg(F.array_sort(F.collect_list(entry)).alias("defaults"))


def pack_schema(
    ranked: DataFrame,
    columns: DataFrame,
    budget: Column | int,
    default_pattern: str = fixed.DEFAULT_COLUMN_PATTERN,
    dialect: str = "postgres",
) -> DataFrame:
    """One DDL text per question from its ranking, within the token budget.

    One straight line of steps, so the ranking is computed once: elements are
    kept by the budget, folded into columns and then into tables on the
    partitioning by question they already have, and joined with the catalogue
    at one row per shown table.
    """
    costs = column_costs(columns, default_pattern, dialect)
    kept = pack_budget(element_cost(ranked, costs), budget)
    stored = F.when(F.col("hint_no") <= fixed.HINTS_STORED, F.struct("hint_no", "value"))
    shown_columns = kept.groupBy("question_id", "table_id", "column_id").agg(
        F.min("rank").alias("place"),
        F.sum("cost").alias("tokens"),
        F.first("column_name").alias("column_name"),
        F.first("shown_type").alias("shown_type"),
        F.array_sort(F.collect_list(stored)).alias("hints"),
    )
    line = render.column_line(F.col("column_name"), F.col("shown_type"), F.transform("hints", lambda h: h["value"]))
    chosen = F.when(F.col("column_id").isNotNull(), F.struct("place", "column_id", line.alias("line")))
    shown_tables = shown_columns.groupBy("question_id", "table_id").agg(
        F.min("place").alias("first_rank"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(chosen)).alias("chosen")
    )
    described = shown_tables.join(table_entries(costs), "table_id")

    def same(entry: Column) -> Column:
        return F.filter("chosen", lambda c: c["column_id"] == entry["column_id"])

    first = F.transform("defaults", lambda d: F.coalesce(F.get(same(d), 0)["line"], d["line"]))
    others = F.filter("chosen", lambda c: ~F.exists("defaults", lambda d: d["column_id"] == c["column_id"]))
    lines = F.filter(F.concat(first, F.transform(others, lambda c: c["line"])), lambda text: text.isNotNull())
    ddl = F.struct((-F.col("first_rank")).alias("place"), render.table_ddl(F.col("fqn"), lines).alias("ddl"))
    return (
        described.groupBy("question_id")
        .agg(F.array_sort(F.collect_list(ddl)).alias("ddls"), F.sum("tokens").alias("tokens"))
        .select("question_id", "tokens", F.array_join(F.transform("ddls", lambda d: d["ddl"]), "\n").alias("schema_ddl"))
    )
