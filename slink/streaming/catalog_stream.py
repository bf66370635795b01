"""Column profiles merged into the stored catalogue batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slink.operators.catalog import catalog_upsert


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version:010d}"


def upsert_batch(path: str, keys: list[str], values: list[str], order: str):
    """Merge function for `foreachBatch`: version n is version n-1 with batch n on top.

    A repeated batch rewrites its own version from the one before, so a retry
    after a lost executor or driver gives the same result.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.max_by(F.struct(*values), F.col(order)).alias("n")
        incoming = batch.groupBy(*keys).agg(newest).select(*keys, "n.*")
        before = last_version(spark, path, below=batch_id)
        current = incoming.limit(0) if before is None else read_version(spark, path, before)
        catalog_upsert(current, incoming, keys, values).drop("action").write.mode("overwrite").parquet(version_path(path, batch_id))

    return merge


def last_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """Number of the newest version written (before `below`), None if there is none. Only folder names are read."""
    try:
        versions = spark.read.parquet(path).select("version").distinct()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return versions.filter(F.col("version") < below if below is not None else F.lit(True)).agg(F.max("version")).first()[0]


def catalog_upsert_stream(
    incoming: DataFrame, path: str, checkpoint: str, keys: list[str], values: list[str], order: str
) -> int | None:
    """Run over all waiting batches and stop; the number of the last version, None if there is none yet."""
    query = (
        incoming.writeStream.foreachBatch(upsert_batch(path, keys, values, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return last_version(incoming.sparkSession, path)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(version_path(path, version))
