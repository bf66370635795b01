"""Top-k and numbering that survive one group holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def salts(df: DataFrame) -> int:
    """As many salts as the cluster shuffles into, so that a hot group can use all of it."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int | Column,
    rank: str = "rank",
    salt_by: list[str] | None = None,
) -> DataFrame:
    """First k rows of each group, numbered from 1; k may be a column that is the same in a group.

    With `salt_by` the rows of a group are first spread over salts and cut to k
    in each, so that no task sorts more than its share of a hot group; the
    second window then gets at most k rows per salt. `order` must be total.
    """
    if salt_by:
        salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts(df)))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_salt_rank", F.row_number().over(salted))
            .filter(F.col("_salt_rank") <= k)
            .drop("_salt", "_salt_rank")
        )
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def number_rows(
    df: DataFrame, keys: list[str], coarse: Column, order: list[Column], name: str = "row_idx"
) -> DataFrame:
    """Position of each row in its group, from 0, in the order (`coarse`, *order).

    `coarse` cuts a group into consecutive slices. Slices are numbered each in
    its own task, and a slice starts at the summed size of the slices before
    it, so a group of any size is never sorted in one place.
    """
    sliced = df.withColumn("_slice", coarse)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(starts, [*keys, "_slice"])
        .withColumn(name, (F.col("_start") + F.col("_inside") - 1).cast("long"))
        .drop("_slice", "_start", "_inside")
    )
