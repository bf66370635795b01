"""Frequent values of text columns, and their cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions import text
from slink.operators.catalog import KEY_CHARS, long_cells
from slink.operators.grouping import salts, top_k_per_group
from slink.sources.stores import materialize


def _sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def value_counts(
    tables: dict[str, DataFrame], digest_from: int | None = None, digest: Callable[[Column], Column] = _sha256
) -> DataFrame:
    """(table_name, column_name, value, n) of every text column, nulls left out.

    With `digest_from`, texts of that many characters or more are counted by
    `digest` and have no `value`: a document that no index can hold is still
    counted, but its text never leaves its task.
    """
    cells, names = long_cells(tables, only_strings=True)
    value = F.col("value")
    cells, keys = cells.filter(value.isNotNull()), ["column_no", "value"]
    if digest_from is not None:
        is_long = F.length(value) >= digest_from
        cells = cells.select("column_no", F.when(~is_long, value).alias("value"), F.when(is_long, digest(value)).alias("digest"))
        keys.append("digest")
    counts = cells.groupBy(*keys).agg(F.count("*").alias("n")).join(names, "column_no")
    return counts.select("table_name", "column_name", *keys[1:], "n")


def top_values(counts: DataFrame, n: int = fixed.MAX_LIMIT, keys: list[str] | None = None) -> DataFrame:
    """Most frequent values of each column, ties by value, then by digest."""
    keys = keys or ["table_name", "column_name"]
    order, salt_by = [F.desc("n"), F.asc_nulls_last("value")], ["value"]
    if "digest" in counts.columns:
        order, salt_by = [*order, F.asc("digest")], ["value", "digest"]
    return top_k_per_group(counts, keys, order, n, "value_rank", salt_by=salt_by)


def _first_with_ties(counts: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows whose place in their group is n or less, where equal ones share a place; a hot group is cut per salt before."""
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("head", "digest"), F.lit(salts(counts))))
    near = salted.withColumn("_place", F.rank().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_place") <= n)
    return (
        near.withColumn("_place", F.rank().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_place") <= n)
        .drop("_salt", "_place")
    )


def top_whole_values(tables: dict[str, DataFrame], n: int = fixed.MAX_LIMIT) -> DataFrame:
    """Most frequent values of each text column with their whole texts, ties by value.

    The first pass counts every value by its first 64 characters and, where it is longer, the digest of all, so no long text is a key.
    Counts and heads leave n values of a column, and those that equal the last of them in both. A second pass reads the long ones
    among these again and puts the ties in the order of the whole texts. As long as the names of these few are below the planner's
    broadcast size, which is so but for a great many long values of one head and count, no other text leaves its task.
    """
    cells, names = long_cells(tables, only_strings=True)
    value = F.col("value")
    is_long = F.length(value) > KEY_CHARS
    keyed = cells.filter(value.isNotNull()).select(
        "column_no", F.left(value, F.lit(KEY_CHARS)).alias("head"), F.when(is_long, _sha256(value)).alias("digest")
    )
    counts = keyed.groupBy("column_no", "head", "digest").agg(F.count("*").alias("n"))
    # A value that is its own head comes before all longer ones of that head.
    near = materialize(
        _first_with_ties(counts, ["column_no"], [F.desc("n"), F.asc("head"), F.col("digest").isNotNull()], n), "frequent-values"
    )
    wanted = near.filter(F.col("digest").isNotNull()).select("column_no", "digest")
    texts = (
        cells.filter(is_long)
        .withColumn("digest", _sha256(value))
        .join(wanted, ["column_no", "digest"], "left_semi")
        .groupBy("column_no", "digest")
        .agg(F.first("value").alias("text"))
    )
    whole = near.join(texts, ["column_no", "digest"], "left").select("column_no", F.coalesce("text", "head").alias("value"), "n")
    ranked = top_k_per_group(whole, ["column_no"], [F.desc("n"), F.asc("value")], n, "value_rank", salt_by=["value"])
    return ranked.join(names, "column_no").select("table_name", "column_name", "value", "n", "value_rank")


def indexed_values(tables: dict[str, DataFrame], n: int = fixed.MAX_LIMIT) -> DataFrame:
    """Values that go into the indexes: the most frequent of each column, cleaned."""
    top = top_values(value_counts(tables, digest_from=fixed.MAX_VALUE_LENGTH), n)
    return clean_values(top.filter(F.col("value").isNotNull()).drop("digest"))


def length_flags(value: Column) -> tuple[Column, Column]:
    """(too long to keep at all, too long for any value index)."""
    return F.length(value) >= fixed.MAX_VALUE_LENGTH, F.length(value) > fixed.MAX_INDEXED_VALUE_LENGTH


def drop_reason(value: Column) -> Column:
    """First reason a value is left out; NULL for a value that is kept."""
    too_long, long_for_index = length_flags(value)
    return (
        F.when(text.is_empty(value), "blank")
        .when(text.is_only_number(value), "only_number")
        .when(text.is_long_hex(value), "long_hex")
        .when(too_long, "too_long")
        .when(text.chars_per_token(value) <= fixed.MIN_CHARS_PER_TOKEN, "few_chars_per_token")
        .when(long_for_index, "long_for_index")
    )


def clean_values(values: DataFrame, value: str = "value", keep_dropped: bool = False) -> DataFrame:
    """Values with their drop reason; the kept ones only, unless asked otherwise."""
    judged = values.withColumn("drop_reason", drop_reason(F.col(value)))
    return judged if keep_dropped else judged.filter(F.col("drop_reason").isNull()).drop("drop_reason")
