"""Text documents for tables, columns and values, and their vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions.text import content_hash, unqualified

Embedder = Callable[[list[str]], np.ndarray]


def table_text(columns: DataFrame) -> DataFrame:
    """Table name and its column names on one line, per table."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    names = F.transform(ordered, lambda c: c["column_name"])
    return columns.groupBy("table_id", "fqn").agg(names.alias("names")).select(
        "table_id",
        "fqn",
        "names",
        F.concat(unqualified(F.col("fqn")), F.lit(" "), F.array_join("names", " ")).alias("content"),
    )


def values_text(values: DataFrame, keys: list[str]) -> DataFrame:
    """Newline-joined values per key in rank order. The caller bounds values per key (`top_values`)."""
    ordered = F.array_sort(F.collect_list(F.struct("value_rank", "value")))
    return values.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda v: v["value"]), "\n").alias("content"))


def chunk_text(df: DataFrame, column: str, size: int = fixed.CHUNK_CHARS) -> DataFrame:
    """One row per consecutive slice of `size` characters; whole texts, no rows for empty ones."""
    count = F.ceil(F.length(column) / F.lit(size)).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(column), i * F.lit(size) + F.lit(1), F.lit(size))
    )
    return df.filter(F.length(column) > 0).select("*", F.posexplode(slices).alias("chunk_no", "chunk")).drop(column)


def chunk_joined_values(values: DataFrame, keys: list[str], order: list[str], size: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Chunks of the newline-joined values per key, without ever building the joined text.

    Each value knows where it starts in the joined text (a running sum over its
    column, on top of the sum over earlier columns), so it can be cut into
    the pieces that fall in each chunk. No row is larger than one chunk.
    """
    column_keys = [*keys, "column_id"] if "column_id" not in keys else keys
    width = F.length("value") + 1
    in_column = Window.partitionBy(*column_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_start", F.coalesce(F.sum(width).over(in_column), F.lit(0)))
    if "column_id" not in keys:
        totals = values.groupBy(*column_keys).agg(F.sum(width).alias("_total"))
        before = Window.partitionBy(*keys).orderBy("column_id").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
        placed = placed.join(offsets, column_keys).withColumn("_start", F.col("_start") + F.col("_offset"))
    # Every value is preceded by a newline except the very first.
    piece = F.when(F.col("_start") == 0, F.col("value")).otherwise(F.concat(F.lit("\n"), F.col("value")))
    placed = placed.withColumn("_piece", piece).withColumn(
        "_from", F.when(F.col("_start") == 0, F.lit(0)).otherwise(F.col("_start") - 1)
    )
    first = F.floor(F.col("_from") / size)
    last = F.floor((F.col("_from") + F.length("_piece") - 1) / size)
    spread = placed.filter(F.length("_piece") > 0).select("*", F.explode(F.sequence(first, last)).alias("chunk_no"))
    begin = F.greatest(F.col("chunk_no") * size - F.col("_from"), F.lit(0))
    end = F.least((F.col("chunk_no") + 1) * size - F.col("_from"), F.length("_piece"))
    cut = spread.select(
        *keys,
        F.col("chunk_no").cast("int"),
        "_from",
        F.substring("_piece", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_cut"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_from", "_cut")))
    return cut.groupBy(*keys, "chunk_no").agg(F.array_join(F.transform(ordered, lambda c: c["_cut"]), "").alias("chunk"))


def _document(df: DataFrame, index: str, content: Column, level: str) -> DataFrame:
    column_id = F.col("column_id") if level != "table" else F.lit(None).cast("int")
    value = F.col("value") if level == "value" else F.lit(None).cast("string")
    chunk = F.col("chunk_no") if "chunk_no" in df.columns else F.lit(0)
    return df.select(
        F.lit(index).alias("index_name"),
        "table_id",
        column_id.alias("column_id"),
        value.alias("value"),
        chunk.cast("int").alias("chunk_no"),
        content.alias("content"),
    )


def build_documents(columns: DataFrame, values: DataFrame) -> DataFrame:
    """The nine kinds of documents in one long table.

    `columns` is the catalogue; `values` holds cleaned values with table_id,
    column_id, value_rank, at most the value limit per column.
    """
    name = unqualified(F.col("fqn"))
    tables = table_text(columns)
    lean_columns = columns.select("table_id", "fqn", "column_id", "column_name")
    valued = values.select("table_id", "column_id", "value", "value_rank").join(lean_columns, ["table_id", "column_id"])
    column_chunks = chunk_joined_values(values, ["table_id", "column_id"], ["value_rank"]).join(
        lean_columns, ["table_id", "column_id"]
    )
    table_chunks = chunk_joined_values(values, ["table_id"], ["value_rank"]).join(tables.drop("content"), "table_id")
    column_content = F.concat_ws("\n", "column_name", "chunk")
    parts = [
        _document(tables, "table_name", name, "table"),
        _document(tables, "table_and_all_column_names", F.col("content"), "table"),
        _document(
            table_chunks,
            "table_and_all_column_names_and_all_values",
            F.concat_ws("\n", name, F.array_join("names", "\n"), "chunk"),
            "table",
        ),
        _document(lean_columns, "column_name", F.col("column_name"), "column"),
        _document(lean_columns, "table_and_column_name", F.concat_ws(" ", name, "column_name"), "column"),
        _document(column_chunks, "column_name_and_all_values", column_content, "column"),
        _document(column_chunks, "table_and_column_name_and_all_values", F.concat_ws(" ", name, column_content), "column"),
        _document(valued, "value", F.col("value"), "value"),
        _document(valued, "table_column_and_value", F.concat_ws(" ", name, "column_name", "value"), "value"),
    ]
    documents = parts[0]
    for part in parts[1:]:
        documents = documents.unionByName(part)
    return documents


def assign_offsets(documents: DataFrame) -> DataFrame:
    """Sequential vector number per index, from 0, in element order.

    Numbered inside each (index, table, column) first - bounded by the value
    limit - and shifted by the sizes of the columns before it, so the large
    value indexes are never sorted in one task.
    """
    column = F.coalesce("column_id", F.lit(-1))
    keyed = documents.withColumn("_column", column)
    inside = Window.partitionBy("index_name", "table_id", "_column").orderBy("value", "chunk_no")
    before = Window.partitionBy("index_name").orderBy("table_id", "_column").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("index_name", "table_id", "_column")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(starts, ["index_name", "table_id", "_column"])
        .withColumn("vec_id", F.col("_start") + F.col("_inside") - 1)
        .drop("_column", "_start", "_inside")
    )


def hashed_token_embedder(width: int = 64) -> Embedder:
    """Deterministic default embedder: unit vector of token counts in md5 buckets."""
    token = re.compile("[a-z0-9]+")

    def encode(texts: list[str]) -> np.ndarray:
        buckets: dict[str, int] = {}
        vectors = np.zeros((len(texts), width), dtype=np.float64)
        for row, content in enumerate(texts):
            hits = []
            for word in token.findall((content or "").lower()):
                bucket = buckets.get(word)
                if bucket is None:
                    bucket = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width
                hits.append(bucket)
            if hits:
                vectors[row] = np.bincount(hits, minlength=width)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norms == 0, 1.0, norms)

    return encode


def embed(df: DataFrame, column: str, embedder: Embedder | None = None, name: str = "embedding") -> DataFrame:
    """Vector of a text column, Arrow batch by batch."""
    encode = embedder or hashed_token_embedder()

    @F.pandas_udf("array<float>")
    def encode_batch(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.tolist()).astype(np.float32)))

    return df.withColumn(name, encode_batch(F.col(column)))


def cache_lookup(
    requests: DataFrame, cache: DataFrame, text: str, key: str = "key", now: Column | None = None, hours: int = 48
) -> tuple[DataFrame, DataFrame]:
    """(requests with hit flag and cached value, distinct missing texts).

    An empty cached value is a miss. With `now`, entries whose `cached_at` is
    `hours` or more before it are misses too. Of several entries of a key one
    counts, the latest where `cached_at` is known.

    Requests are matched by content hash. A text repeated in a third of all
    requests skews only the probe side, which AQE splits; the misses are
    reduced to one row per key on the map side before they move.
    """
    keyed = requests.withColumn(key, content_hash(F.col(text)))
    if now is not None:
        cache = cache.filter(F.col("cached_at") > now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    kept = cache.filter(F.coalesce(F.col("cached_value").cast("string"), F.lit("")) != "")
    latest = F.max_by("cached_value", "cached_at") if "cached_at" in cache.columns else F.max("cached_value")
    known = kept.groupBy(key).agg(latest.alias("cached_value")).withColumn("_known", F.lit(True))
    looked = keyed.join(known, key, "left").withColumn("hit", F.coalesce("_known", F.lit(False))).drop("_known")
    misses = looked.filter(~F.col("hit")).groupBy(key).agg(F.first(text).alias(text))
    return looked, misses


def append_to_cache(cache: DataFrame, computed: DataFrame, key: str = "key") -> DataFrame:
    """The cache with computed rows in place of its own of the same key; a repeated append changes nothing."""
    fresh = computed.dropDuplicates([key])
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)
