"""SimHash near-duplicates; pairs are discarded by their distances to reference fingerprints.

Fingerprints that differ in at most three bits agree on at least two of five bit ranges, so all such pairs meet in
one of ten (range pair, bits) buckets. Inside a bucket the table of Hamming distances to the reference fingerprints
decides: by the triangle inequality a pair whose distances to any reference differ by more than three cannot link.
Survivors are verified on the fingerprints. Exact copies are one fingerprint, a bucket leaves its task as a spanning
forest, and buckets above `CHUNK` rows are cut into chunks whose pairs are separate tasks, so no group is emitted as
pairs and none is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slink.llm import arrow
from slink.llm.components import connected_components
from slink.sources.shared import new_path

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
REFERENCES = 16
CHUNK = 2048
SMALL = 24
TILE = 256


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; zero for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z changes case, only 09-0D and 20 separate
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    set_bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    over = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and the signed fingerprint of each row; a null text has no words."""
    keep = keep or []
    slim = docs.select(*keep, F.col(text).alias("_text"))
    schema = slim.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                prints = np.array([fingerprint(t) for t in arrow.strings(batch.column("_text"))], np.uint64)
                columns = [batch.column(k) for k in keep] + [pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    return slim.mapInArrow(run, schema)


def reference_fingerprints(count: int = REFERENCES) -> np.ndarray:
    """References by rule: the hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def _distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Table of Hamming distances, one row per reference."""
    return np.bitwise_count(prints[None, :] ^ references[:, None]).astype(np.int8)


def _linked(a: np.ndarray, b: np.ndarray, prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that link: discarded reference by reference, survivors verified."""
    for row in table:
        near = np.abs(row[a] - row[b]) <= MOST_BITS
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    same = np.bitwise_count(prints[a] ^ prints[b]) <= MOST_BITS
    return a[same], b[same]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of all edges the smallest label of their component."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        apart = labels[a] != labels[b]
        if not apart.any():
            return
        a, b, low = a[apart], b[apart], low[apart]
        for end in (a, b):
            np.minimum.at(labels, labels[end], low)
            np.minimum.at(labels, end, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def forest(groups: np.ndarray, prints: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, smaller row) of the links inside each group; rows are sorted by group."""
    n = len(prints)
    labels = np.arange(n)
    if n < 2:
        return labels[:0], labels[:0]
    table = _distances(prints, references)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, min(SMALL, n)):
        a = np.flatnonzero((groups[shift:] == groups[:-shift]) & small[shift:])
        if not len(a):
            break
        _merge(labels, *_linked(a, a + shift, prints, table))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for top in range(start, start + size, TILE):
            rows = np.arange(top, min(top + TILE, start + size))
            # The first reference cuts the tile before any pair is listed.
            near = np.abs(table[0, rows][:, None] - table[0, top : start + size][None, :]) <= MOST_BITS
            near &= labels[rows][:, None] != labels[top : start + size][None, :]
            i, j = np.nonzero(near)
            later = rows[i] < top + j
            _merge(labels, *_linked(rows[i[later]], top + j[later], prints, table))
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def _masks() -> list[int]:
    bits = [((1 << width) - 1) << start for start, width in RANGES]
    masks = [bits[i] | bits[j] for i, j in combinations(range(len(RANGES)), len(RANGES) - MOST_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints `prints.fp`."""
    fp = F.col("fp")
    buckets = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).cast("int").alias("t"), fp.bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(_masks())])
        ).alias("b"),
    ).select("fp", "b.t", "b.k")
    filled = buckets.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: (j != F.col("i")))
    placed = (
        buckets.join(filled.select("t", "k", chunks.alias("c")), ["t", "k"])
        .withColumn("i", chunk)
        .withColumn("j", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(others)))
        .select("fp", F.xxhash64("t", "k", F.least("i", "j"), F.greatest("i", "j")).alias("g"))
    )
    references = reference_fingerprints()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(groups: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            a, b = forest(groups, rows.view(np.uint64), references)
            return pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(rows[b])], names=["u", "v"])

        for batch in batches:
            groups = np.concatenate([groups, batch.column("g").to_numpy()])
            rows = np.concatenate([rows, batch.column("fp").to_numpy()])
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            if whole:
                yield edges(groups[:whole], rows[:whole])
                groups, rows = groups[whole:], rows[whole:]
        if len(groups):
            yield edges(groups, rows)

    return placed.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, "u bigint, v bigint").distinct()


def _with_components(slim: DataFrame) -> DataFrame:
    """`slim` (written; doc_id, fp, ...) with `root`, the smallest fingerprint of its component, and `component_id`."""
    spark = slim.sparkSession
    path = new_path(spark, "prints")
    slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")).write.parquet(path)
    prints = spark.read.parquet(path)
    members = connected_components(links(prints.select("fp"))).select(F.col("node").alias("fp"), "component")
    linked = prints.join(members, "fp")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("low_id"))
    ids = linked.join(lowest, "component").select("fp", "component", "low_id")
    known = prints.join(ids, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), F.coalesce("low_id", "first_id").alias("component_id")
    )
    # Written, so that both sides of the join are plain shuffles and a frequent fingerprint can be split.
    known.write.parquet(path := new_path(spark, "known"))
    return slim.join(spark.read.parquet(path), "fp")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs` (doc_id, text).

    Defined cases: null and empty texts have no words and fingerprint zero, and link like any other; a row with a
    null doc_id gets the smallest known id of its component (null if there is none); repeated rows stay; an empty
    table gives no rows; other columns are ignored, whatever their names. Texts of any length are hashed whole.
    """
    spark = docs.sparkSession
    path = new_path(spark, "simhash")
    with_fingerprint(docs, name="fp", keep=["doc_id"]).write.parquet(path)
    found = _with_components(spark.read.parquet(path))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of `docs`, with all its columns: the smallest doc_id (nulls last).

    Repeated rows of that doc_id and text are one row too; of rows that differ only in other columns any one stays.
    The other cases are those of `components`.
    """
    spark = docs.sparkSession
    path = new_path(spark, "simhash")
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), F.xxhash64("text").alias("_h")]
    slim = docs.select("doc_id", "text", *keys)
    with_fingerprint(slim, name="fp", keep=["doc_id", "_id", "_none", "_h"]).write.parquet(path)
    found = _with_components(spark.read.parquet(path))
    first = found.groupBy("root").agg(F.min(F.struct("_none", "_id", "_h")).alias("first")).select("first.*")
    repeated = Window.partitionBy("_id", "_none", "_h").orderBy("_h")
    return (
        docs.select(F.struct("*").alias("row"), *keys)
        .join(first.distinct(), ["_id", "_none", "_h"])
        .withColumn("_copy", F.row_number().over(repeated))
        .filter("_copy = 1")
        .select("row.*")
    )
