"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent in [0, 1], normalised. Smaller exponents
level the sources; the entropy of the weights grows, and so does the repetition of small sources. The exponent is
bisected to the smallest one whose entropy stays at or below the target and whose repetition within the limit.

Each source is then drawn whole as often as its share of the budget asks for, and once more in part, in the order of
a seeded permutation that consists of blocks of bounded size: blocks by hash, rows by hash inside a block. Running
token sums need one row per block and one sort per block, so a source of any size is never in one task. The drawn
rows are dealt to output blocks of equal token budgets in which each source has its weight's share, in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slink.sources.shared import new_path

TARGET_ENTROPY = 0.95  # of the largest possible entropy, that of equal weights
MOST_REPEATS = 4.0
SEED = 17
BLOCK_TOKENS = 250_000
LEVELS = 6  # bisection levels that one pass over the sources answers
PASSES = 5


def n_tokens(text: Column) -> Column:
    """Budget measure of a text: its words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sources as strings; null is a source of its own."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def bisect_exponent(
    totals: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS
) -> float:
    """Smallest exponent in [0, 1] whose weights meet the entropy target and the repetition limit.

    `totals` has one row per source (`tokens`, positive). As entropy and repetition fall while the exponent rises,
    each bisection step asks whether both hold at the middle. One aggregation answers the steps of several levels:
    it evaluates every middle those levels could ask for, so no list of sources reaches the driver.
    """
    totals = totals.filter("tokens > 0")
    known = totals.agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not known["n"] or known["n"] == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(known["all"]))

    def sums(exponents: list[float]) -> list[tuple[float, float, float]]:
        """Per exponent: the sum of p^a, the sum of a p^a ln p, and the largest p^(a-1)."""
        columns = []
        for i, a in enumerate(exponents):
            power = F.pow(share, F.lit(a))
            columns += [
                F.sum(power).alias(f"z{i}"),
                F.sum(power * F.ln(share) * a).alias(f"l{i}"),
                F.max(F.pow(share, F.lit(a - 1))).alias(f"r{i}"),
            ]
        row = totals.agg(*columns).first()
        return [(row[f"z{i}"], row[f"l{i}"], row[f"r{i}"]) for i in range(len(exponents))]

    def holds(z: float, l: float, r: float) -> bool:
        entropy = math.log(z) - l / z
        repeats = budget / known["all"] * r / z
        return entropy <= target_entropy * math.log(known["n"]) + 1e-12 and repeats <= most_repeats + 1e-12

    if holds(*sums([0.0])[0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        steps = 2**LEVELS
        grid = [low + (high - low) * i / steps for i in range(1, steps)]
        answers = [holds(*s) for s in sums(grid)]
        left, right = 0, steps
        while right - left > 1:
            middle = (left + right) // 2
            if answers[middle - 1]:
                right = middle
            else:
                left = middle
        low, high = low + (high - low) * left / steps, low + (high - low) * right / steps
    return high


def draws(
    docs: DataFrame,
    budget: float | None = None,
    target_entropy: float = TARGET_ENTROPY,
    most_repeats: float = MOST_REPEATS,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per drawn document and turn: doc_id, source, epoch, block, position, n_tokens (and _h, its text's hash).

    `budget` counts tokens and is by default that of all documents. Blocks are numbered from 0 in training order,
    positions from 0 inside a block. Defined cases: a null source is a source of its own; null and empty texts have
    no tokens and are drawn with the rows around them; a source without any token is not drawn; rows equal in doc_id,
    text and source are drawn together; rows that tie in the permutation are ordered by doc_id and text hash; an empty
    table draws nothing; other columns are ignored, whatever their names. The last document of a source's partial
    turn may exceed the budget by less than its own length.
    """
    spark = docs.sparkSession
    path = new_path(spark, "mix")
    units = (
        docs.select(
            "doc_id", "source", _key(F.col("source")).alias("k"), F.xxhash64("text").alias("_h"),
            n_tokens(F.col("text")).alias("n_tokens"),
        )
        .groupBy("doc_id", "source", "k", "_h")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("order", F.xxhash64("doc_id", "_h", F.lit(seed)))
    )
    units.write.parquet(f"{path}/units")
    units = spark.read.parquet(f"{path}/units")
    units.groupBy("k").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0").write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(everything if budget is None else budget)
    exponent = bisect_exponent(totals, budget, target_entropy, most_repeats)
    power = F.pow(F.col("tokens") / F.lit(float(max(everything, 1))), F.lit(exponent))
    norm = totals.agg(F.sum(power)).first()[0] or 1.0
    quotas = totals.select(
        "k", "tokens", (power / F.lit(norm) * F.lit(budget)).alias("quota"),
        F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1)).alias("blocks"),
    )

    placed = units.join(quotas, "k").withColumn("b", F.pmod(F.xxhash64("order", F.lit("b")), F.col("blocks")))
    sums = placed.groupBy("k", "b").agg(F.sum("n_tokens").alias("in_block"))
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("k", "b", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("k", "b").orderBy("order", "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        placed.withColumn("own_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, ["k", "b"])
        .withColumn("start", F.col("block_start") + F.col("own_start"))
    )
    # A millionth of a source is rounding, not a part of a turn.
    slack = F.col("tokens") * 1e-6
    whole = F.floor((F.col("quota") + slack) / F.col("tokens"))
    partial = F.col("quota") - whole * F.col("tokens")
    turns = (whole + F.when(F.col("start") + slack < partial, 1).otherwise(0)).cast("int")
    out_blocks = max(1, math.ceil(budget / block_tokens))
    at = (F.col("epoch") * F.col("tokens") + F.col("start")) / F.greatest(F.col("quota"), F.lit(1.0))
    drawn = (
        started.withColumn("turns", turns)
        .filter("turns > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        .withColumn("block", F.least(F.floor(at * out_blocks), F.lit(out_blocks - 1)))
    )
    shuffled = Window.partitionBy("block").orderBy(
        F.xxhash64("order", "epoch", F.lit(seed + 1)), "k", "doc_id", "_h", "epoch"
    )
    return drawn.select(
        "doc_id", "source", "epoch", "block",
        (F.row_number().over(shuffled) - 1).cast("long").alias("position"),
        "n_tokens", "_h",
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all their columns, each as often as it is drawn; whole blocks lie together, in order."""
    drawn = draws(docs, **options).select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), "_h",
        _key(F.col("source")).alias("_k"), "block", "position",
    )
    keyed = docs.select(
        F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"),
        F.xxhash64("text").alias("_h"), _key(F.col("source")).alias("_k"),
    )
    taken = keyed.join(drawn, ["_id", "_none", "_h", "_k"])
    return taken.repartition("block").sortWithinPartitions("block", "position").select("row.*")
