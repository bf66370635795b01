"""The folder shared by all executors, for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`, else one below the session's warehouse folder.

    A warehouse on a local disk is no shared folder of a cluster, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir: executors do not share {warehouse}")
        folder = f"{warehouse}/checkpoints"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/slink/{name}-{uuid.uuid4().hex}"
