"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of the pivots from nearest to farthest. Vectors are dealt to shards; inside
a shard they stream by in blocks, and a block is an inverted file: for each pivot, the place it takes in the order of
each vector. A query reads the pivots' files, adds up the footrule distances between its own order and those of the
block's vectors, takes the block's nearest share by footrule, and reranks it by exact inner products.

Blocks of queries meet shards of vectors as one sorted stream per pair, so a task holds one block of queries and one
block of vectors, however large a shard is. What leaves it is k rows per query and shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
PIVOTS = 64
SHARDS = 16
BLOCK = 4096
QUERY_BLOCK = 4096
SHARE = 0.2  # of a block's vectors, nearest by footrule, that is reranked
LEAST = 192  # vectors of a block that are reranked at least
PIVOT_SAMPLE = 512


def usable(embedding: Column) -> Column:
    """Vectors that take part: neither null nor zero, all components known and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot (column) in each vector's order, nearest first; ties go to the smaller pivot number."""
    by_nearness = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    places = np.empty(by_nearness.shape, np.int8)
    np.put_along_axis(places, by_nearness, np.arange(len(pivots), dtype=np.int8)[None, :], axis=1)
    return places


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """`count` rows of the sample, each the farthest from those before it, so that near copies give one pivot.

    A sample of fewer different vectors is repeated.
    """
    unit = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return sample[[chosen[i % len(chosen)] for i in range(count)]]


def footrules(inverted: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Footrule distance of one order to those of a block; `inverted` has a row per pivot, a multiple of four."""
    apart = np.abs(inverted - order[:, None]).view(np.uint8)
    fours = apart.reshape(-1, 4, inverted.shape[1]).sum(axis=1, dtype=np.uint8)  # four differences below 64 fit a byte
    return fours.sum(axis=0, dtype=np.uint16)


def raised(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one component more that gives all of them the same length, so that nearness is an angle."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component, so that equal rows score equally."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total += query[i] * rows[:, i]
    return total


def _entries(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in their order with at most `most` copies of each vector, the entry of each row, and each entry's first row."""
    _, entry = np.unique(vectors, axis=0, return_inverse=True)
    by_entry = np.argsort(entry, kind="stable")
    place = np.arange(len(ids)) - np.searchsorted(entry[by_entry], entry[by_entry])
    kept = np.sort(by_entry[place < most])
    _, first, entry = np.unique(entry[kept], return_index=True, return_inverse=True)
    return ids[kept], vectors[kept], entry, first


class Block:
    """One block of queries and their nearest so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, k: int):
        self.ids, self.vectors, self.pivots, self.longest, self.k = ids, vectors, pivots, longest, k
        self.orders = orders(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1), pivots)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Search a block of vectors in ascending order of ids.

        Exact copies are one entry of the block's files; of each entry the k + 1 smallest ids can be among the
        nearest, so no more are kept.
        """
        ids, vectors, entry, first = _entries(ids, vectors, self.k + 1)
        inverted = np.ascontiguousarray(orders(raised(vectors[first], self.longest), self.pivots).T)
        take = max(LEAST, math.ceil(SHARE * len(first)))
        for i, query in enumerate(self.vectors):
            if take < len(first):
                wanted = np.zeros(len(first), bool)
                wanted[np.argsort(footrules(inverted, self.orders[i]), kind="stable")[:take]] = True
                near = np.flatnonzero(wanted[entry])
            else:
                near = np.arange(len(ids))
            near = near[ids[near] != self.ids[i]]
            rough = vectors[near] @ query
            if len(rough) > self.k:
                near = near[rough >= np.partition(rough, -self.k)[-self.k] - 1e-9 * max(1.0, np.abs(rough).max())]
            scores = exact(query, vectors[near])
            own_ids, own = self.found[i]
            all_ids, every = np.concatenate([own_ids, ids[near]]), np.concatenate([own, scores])
            best = np.lexsort((all_ids, -every))[: self.k]
            self.found[i] = all_ids[best], every[best]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(f[0]) for f in self.found]
        columns = [np.repeat(self.ids, sizes)]
        columns += [np.concatenate([f[j] for f in self.found]) if self.found else np.zeros(0) for j in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, by inner product.

    `vectors` has vec_id and embedding; candidates of a query are all rows but its own. Rows without vec_id, and
    vectors that are null, zero or hold a null or non-finite component, take no part, nor do vectors of another
    length than the most frequent one. A repeated vec_id is one row (the smallest hash of its vectors stays). Ties go
    to the smaller vec_id. With k candidates or fewer a query gets them all; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    lengths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.filter(F.size("embedding") == lengths["n"])
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest, total, asking = valid.agg(
        F.max(F.sqrt(squares)), F.count("*"), F.count(F.when(is_query, 1))
    ).first()
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()  # bounded
    vectors_of = np.array([r["embedding"] for r in sample], np.float64)
    pivots = spread_pivots(raised(vectors_of, longest), PIVOTS)

    query_blocks = max(1, math.ceil(asking / QUERY_BLOCK))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(SHARDS))
    asked = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks))
    queries = valid.filter(is_query).select(
        asked.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("s"), F.lit(0).alias("side"),
        "vec_id", "embedding",
    )
    answers = valid.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), shard.alias("s"), F.lit(1).alias("side"),
        "vec_id", "embedding",
    )
    stream = queries.union(answers).withColumn("g", F.col("q") * SHARDS + F.col("s")).drop("q", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, last, block = None, None, None

        def taken() -> tuple[np.ndarray, np.ndarray]:
            ids, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            return ids, rows

        def close() -> Iterator[pa.RecordBatch]:
            """End of a run of rows of one group and side."""
            nonlocal block
            if at is not None and at[1] == 0:
                block = Block(*taken(), pivots, longest, k)
            elif at is not None:
                if held and block is not None:
                    block.meet(*taken())
                held.clear()
                if block is not None:
                    yield block.rows()
                block = None

        for batch in batches:
            groups, sides = batch.column("g").to_numpy(), batch.column("side").to_numpy()
            ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                here = (groups[a], sides[a])
                if here != at:
                    yield from close()
                    at, last = here, None
                # Rows of one id are neighbours; the first one counts.
                fresh = np.r_[ids[a] != last, ids[a + 1 : b] != ids[a : b - 1]]
                last = ids[b - 1]
                own, matrix = ids[a:b][fresh], rows[a:b][fresh]
                held.append((own, matrix))
                while here[1] == 1 and block is not None and sum(len(h[0]) for h in held) >= BLOCK:
                    all_ids, all_rows = taken()
                    block.meet(all_ids[:BLOCK], all_rows[:BLOCK])
                    held.append((all_ids[BLOCK:], all_rows[BLOCK:]))
        yield from close()

    found = (
        stream.withColumn("h", F.xxhash64("embedding"))
        .repartition("g")
        .sortWithinPartitions("g", "side", "vec_id", "h")
        .select("g", "side", "vec_id", "embedding")
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
