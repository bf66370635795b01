"""Five stages from raw documents to token ids; all but the last return the columns of documents.

Columns beside text may hold nulls and bear any name; they are carried as they are. An empty table gives an empty one.
Texts of any length are read whole. Null and empty texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slink.llm import bpe_fragments, mixing, pii_boost, quality_mil, simhash_pivots
from slink.plans.bindings import table
from slink.sources.shared import new_path


def _carried(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one, so that no name of theirs can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*others).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null, empty and blank texts go, unless labels speak for such texts. Repeated rows all stay or all go.
    """
    network = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    accepted = quality_mil.score(_carried(docs), network, ["text", "row"]).filter("predicted = 1")
    return accepted.select("text", "row.*").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id, null ids last; repeated rows are one."""
    return simhash_pivots.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows. Every row stays, repeated ones too."""
    clean = pii_boost.find(_carried(docs), pii_boost.fit(docs), ["row"], redact="text").select("text", "row.*")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources draw them, block by block."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_fragments.encode(docs, path, ["doc_id", "lang", "source"], ids="token_ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
