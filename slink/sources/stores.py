"""Written tables: vector index, training sets, evaluations, CSV and JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slink.sources.shared import new_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame below the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_index(documents: DataFrame, path: str) -> None:
    """Vector index by data source and index name. Rows are spread by vec_id, so a large index is many files."""
    documents.write.mode("overwrite").partitionBy("data_source_id", "index_name").parquet(path)


def read_index(spark: SparkSession, path: str, data_source_id: int | None = None, index_name: str | None = None) -> DataFrame:
    """Index rows; both filters prune directories."""
    index = spark.read.parquet(path)
    if data_source_id is not None:
        index = index.filter(F.col("data_source_id") == data_source_id)
    if index_name is not None:
        index = index.filter(F.col("index_name") == index_name)
    return index


def write_training(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").partitionBy("element_type", "split").parquet(path)


def read_training(spark: SparkSession, path: str, element_type: str, split: str) -> DataFrame:
    """One element type and split; an error when there is nothing to train on."""
    examples = spark.read.parquet(path).filter((F.col("element_type") == element_type) & (F.col("split") == split))
    if examples.isEmpty():
        raise ValueError(f"not enough training data for {element_type}.{split}, add more evaluation questions")
    return examples


def write_evaluation(questions: DataFrame, rows: DataFrame, path: str) -> None:
    """Questions with their SQL and score, and the compared rows, each split by outcome.

    Rows stay long (case, position, old, new), so no result is gathered in one place.
    """
    correct = questions.select("case_id", (F.col("score") == 1).alias("correct"))
    questions.withColumn("correct", F.col("score") == 1).write.mode("overwrite").partitionBy("correct").parquet(f"{path}/questions")
    rows.join(correct, "case_id").write.mode("overwrite").partitionBy("correct").parquet(f"{path}/rows")


CSV_OPTIONS = {"header": True, "lineSep": "\r\n", "escape": '"', "nullValue": "", "emptyValue": '""'}


def _text_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def write_csv(df: DataFrame, path: str) -> None:
    """Header, CRLF line ends, NULL as an empty cell, text cells with JSON escapes for line breaks.

    A cell never spans lines, so the files can be split when they are read.
    """
    encoded = df.withColumns({name: _escaped(F.col(f"`{name}`")) for name in _text_fields(df.schema)})
    encoded.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What `write_csv` wrote, cell by cell."""
    raw = spark.read.schema(schema).options(**CSV_OPTIONS | {"emptyValue": ""}).csv(path)
    return raw.withColumns({name: _unescaped(F.col(f"`{name}`")) for name in _text_fields(schema)})


def _escaped(value: Column) -> Column:
    # A JSON string without its quotes; `"` itself is left to the CSV writer.
    listed = F.to_json(F.array(value))
    body = F.substring(listed, F.lit(3), F.length(listed) - 4)
    return F.when(value.isNotNull(), F.replace(body, F.lit('\\"'), F.lit('"')))


def _unescaped(value: Column) -> Column:
    quoted = F.concat(F.lit('["'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"]'))
    return F.from_json(quoted, "array<string>")[0]


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, so that a large result can be read in parallel. NULLs are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
