"""All rows of one table against all rows of another, as a bounded number of streams.

The left table is cut into strips that a task can hold, the right one into blocks. A task is given a run of
(strip, range of blocks) cells, in order, and reads them as one sorted stream: the rows of a strip once, then block
after block of the right table, which it drops again. So a task holds one strip and one block, the number of tasks
is a multiple of the cores however many pairs of blocks there are, and a right row is moved once per strip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP_ROWS = 16_384
STREAMS_PER_CORE = 4

# A strip and the blocks that pass it, one after the other, to rows.
Kernel = Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.RecordBatch]]


def _table(batches: list[pa.RecordBatch], side: str) -> pa.Table:
    """The rows of one side as a table of their own columns."""
    columns = [batch.column(side) for batch in batches]
    names = [field.name for field in columns[0].type]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(c.flatten(), names=names) for c in columns])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, object, pa.RecordBatch]]:
    """strip, side, block and rows of stretches of a stream."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("strip", "side", "block")), strict=True))
        start = 0
        for key, same in groupby(keys):
            rows = sum(1 for _ in same)
            yield *key, batch.slice(start, rows)
            start += rows


def _cut(pieces: Iterator[tuple], most: int | None) -> Iterator[pa.Table]:
    """Tables of the rows of one block each, at most about `most` of them."""
    for _, same in groupby(pieces, key=lambda p: p[2]):
        held, rows = [], 0
        for *_, batch in same:
            for start in range(0, batch.num_rows, most or batch.num_rows):
                held.append(batch.slice(start, most or batch.num_rows))
                rows += held[-1].num_rows
                if most and rows >= most:
                    yield _table(held, "r")
                    held, rows = [], 0
        if held:
            yield _table(held, "r")


def _run(kernel: Kernel, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in groupby(_pieces(batches), key=lambda p: p[0]):
            sides = groupby(cells, key=lambda p: p[1])
            side, rows = next(sides)
            if side == 0:
                strip = _table([batch for *_, batch in rows], "l")
                for _, blocks in sides:
                    yield from kernel(strip, _cut(blocks, most))

    return run


def streams(left: DataFrame, strips: int, blocks: int) -> tuple[int, int]:
    """How many ranges of blocks a strip's work is cut into, and how many tasks there are."""
    most = STREAMS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, min(blocks, most // max(1, strips)))
    return ranges, max(1, min(strips * ranges, most))


def strip_count(left: DataFrame, rows: int, blocks: int, least: int, most: int = 0) -> int:
    """As few strips as can be held, of STRIP_ROWS or `most` rows; more, of `least` rows or more, if the blocks alone leave cores idle."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    wanted = min(math.ceil(cores / max(1, blocks)), math.ceil(rows / least))
    return max(1, math.ceil(rows / max(STRIP_ROWS, most)), wanted)


def pair_stream(
    left: DataFrame,
    right: DataFrame,
    strip: Column,
    strips: int,
    block: Column,
    blocks: int,
    kernel: Kernel,
    schema: str,
    ranges: int | None = None,
    group: Column | None = None,
    most: int | None = None,
) -> DataFrame:
    """What `kernel` gives for each strip of `left` with the blocks of `right`.

    `strip` and `block` are numbers below `strips` and `blocks`, of about equally many rows each. A strip without
    right rows, or a block without left rows, gives nothing. Blocks pass in their order; with `group`, a text, those
    of a range pass group by group, cut into tables of about `most` rows. `ranges` of blocks are parts of their own.
    """
    planned, tasks = streams(left, strips, blocks)
    if ranges is not None:
        planned, tasks = ranges, max(1, min(strips * ranges, STREAMS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism))
    ranges = planned

    def task(cell: Column) -> Column:
        return F.floor(cell.cast("long") * F.lit(tasks) / F.lit(strips * ranges)).cast("int")

    kind = "string" if group is not None else "int"
    numbered = left.select(strip.cast("int").alias("strip"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"))
    first, last = F.col("strip") * ranges, F.col("strip") * ranges + (ranges - 1)
    lefts = numbered.withColumn("task", F.explode(F.sequence(task(first), task(last)))).select(
        "task", "strip", F.lit(0).alias("side"), F.lit(0).cast(kind).alias("block"), "l"
    )
    row = F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("r")
    numbered = right.select(block.cast("int").alias("number"), (block if group is None else group).cast(kind).alias("block"), row)
    numbered = numbered.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    cell = F.col("strip") * ranges + F.floor(F.col("number") * F.lit(ranges) / F.lit(blocks)).cast("int")
    rights = numbered.select(task(cell).alias("task"), "strip", F.lit(1).alias("side"), "block", "r")
    both = lefts.unionByName(rights, allowMissingColumns=True)
    placed = both.repartitionById(tasks, F.col("task")).sortWithinPartitions("strip", "side", "block")
    return placed.select("strip", "side", "block", "l", "r").mapInArrow(_run(kernel, most), schema)


def cell_stream(left: DataFrame, right: DataFrame, cells: int, kernel: Kernel, schema: str, order: list[str], most: int) -> DataFrame:
    """What `kernel` gives for the left rows of each cell and the right rows of the same cell.

    Both sides have `cell`, a number below `cells`; a row that belongs to several cells comes once for each. The left
    rows of a cell are held together, the right ones pass in `order`, in tables of about `most` rows. A cell without
    left or without right rows gives nothing.
    """
    tasks = max(1, min(cells, STREAMS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism))

    def placed(df: DataFrame, number: int, side: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "cell"]).alias(side)
        task = F.floor(F.col("cell").cast("long") * F.lit(tasks) / F.lit(cells)).cast("int").alias("task")
        return df.select(task, F.col("cell").cast("int").alias("strip"), F.lit(number).alias("side"), F.lit(0).alias("block"), row)

    both = placed(left, 0, "l").unionByName(placed(right, 1, "r"), allowMissingColumns=True)
    dealt = both.repartitionById(tasks, F.col("task")).sortWithinPartitions("strip", "side", *[f"r.{c}" for c in order])
    return dealt.select("strip", "side", "block", "l", "r").mapInArrow(_run(kernel, most), schema)
