"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.sources.shared import new_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; every edge keeps u > v.

    Only the smallest neighbour of a node is gathered (a map-side minimum), never its list of neighbours, and
    nodes with many edges are a skewed sort-merge join that adaptive execution splits.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    large = (
        both.join(lowest, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        .distinct()
    )
    lowest = large.groupBy("u").agg(F.min("v").alias("low"))
    joined = large.join(lowest, "u")
    small = joined.filter(F.col("v") > F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.union(lowest.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v: bigint); the component is its smallest node.

    Each round is written to the shared folder, so the lineage stays one round long and a lost executor costs no
    earlier round. Self loops and repeated edges are allowed; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    current = _written(edges, "edges")
    signature = _signature(current)
    while signature[0]:
        following = _written(_contract(current), "edges")
        changed = _signature(following)
        current = following
        if changed == signature:
            break
        signature = changed
    roots = current.select(v.alias("node")).distinct()
    return current.select(u.alias("node"), v.alias("component")).union(roots.select("node", F.col("node")))
