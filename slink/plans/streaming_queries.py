"""Streams over the supplied tables, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from slink.operators import catalog
from slink.plans import bindings as b
from slink.plans.catalog_queries import PROFILED
from slink.plans.registry import query
from slink.sources.shared import new_path
from slink.streaming.catalog_stream import catalog_upsert_stream, read_version
from slink.streaming.requests import first_requests_stream, write_stream


ARRIVALS = 4  # at least
ARRIVAL_ROWS = 250_000  # about; the number of arrivals grows with the table
DISORDER_MICROS = 50 * 60 * 1_000_000


def arrivals(spark, events, rows=ARRIVAL_ROWS):
    """Folder of files of about `rows` events, each written after the one before, up to 50 minutes out of order."""
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    late = F.pmod(F.xxhash64("event_id"), F.lit(DISORDER_MICROS))
    n = max(ARRIVALS, -(-events.count() // rows))
    dealt, incoming = new_path(spark, "dealt"), new_path(spark, "arrivals")
    # One shuffle deals the table into ranges of the time of arrival, whose files are named in their order.
    events.withColumn("_arrival", micros + late).repartitionByRange(n, "_arrival").drop("_arrival").write.parquet(dealt)
    stored = spark.read.schema(events.schema).parquet(dealt)
    # A file source takes its files in the order they were written, so each is written again on its own, in one bounded task.
    for file in sorted(stored.inputFiles(), key=lambda f: f.rsplit("/", 1)[1]):
        spark.read.schema(events.schema).parquet(file).coalesce(1).write.mode("append").parquet(incoming)
    return incoming


@query(
    "st1_first_requests_stream",
    """WITH RECURSIVE req AS (SELECT 'query-cache-' || props AS key, event_id AS request_id, epoch_us(ts) AS micros FROM events),
    acc AS (
      SELECT key, min(micros) AS micros FROM req GROUP BY key
      UNION ALL
      SELECT a.key, min(r.micros) FROM acc a JOIN req r ON r.key = a.key AND r.micros >= a.micros + 172800000000 GROUP BY a.key, a.micros
    )
    SELECT key, micros, min(request_id) AS request_id FROM acc JOIN req USING (key, micros)
    WHERE micros < ((SELECT max(micros) FROM req) // 1000 - 3600000) * 1000 GROUP BY ALL""",
)
def st1(spark, sf_dir):
    """Events arrive in files of bounded size, out of order; what the last watermark has passed is decided."""
    events = b.table(spark, sf_dir, "events").select("event_id", "props", "ts")
    incoming = arrivals(spark, events)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    requests = stream.select(F.concat(F.lit("query-cache-"), "props").alias("key"), "ts", F.col("event_id").alias("request_id"))
    path = new_path(spark, "requests")
    write_stream(first_requests_stream(requests), path, new_path(spark, "requests-checkpoint"))
    return spark.read.schema("key string, request_id long, micros long").parquet(path)


BATCHES = [("stale", []), ("fresh", ["PART", "REGION"]), ("late", ["ORDERS"])]


@query(
    "st2_catalog_upsert_stream",
    f"""SELECT table_name, column_name,
      CASE WHEN table_name = 'ORDERS' THEN distinct_rows + 1 ELSE distinct_rows + 2 END AS distinct_rows, rows,
      CASE WHEN table_name = 'ORDERS' THEN 1 ELSE 2 END AS seq
    FROM ({PROFILED})""",
)
def st2(spark, sf_dir):
    """Three profiles arrive; each is the profile plus its number, and leaves some tables out."""
    profiled = catalog.profile(spark, b.tables(spark, sf_dir)).select("table_name", "column_name", "distinct_rows", "rows")
    written = new_path(spark, "profile")
    profiled.write.parquet(written)
    stored = spark.read.schema(profiled.schema).parquet(written)
    incoming = new_path(spark, "profiles")
    for seq, (_, left_out) in enumerate(BATCHES):
        arriving = stored.filter(~F.col("table_name").isin(left_out)) if left_out else stored
        # One row per column of the warehouse: a single small file per arrival.
        arriving.withColumns({"distinct_rows": F.col("distinct_rows") + seq, "seq": F.lit(seq)}).coalesce(1).write.mode("append").parquet(incoming)
    schema = "table_name string, column_name string, distinct_rows long, rows long, seq int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    path = new_path(spark, "catalog")
    last = catalog_upsert_stream(
        stream, path, new_path(spark, "catalog-checkpoint"), ["table_name", "column_name"], ["distinct_rows", "rows", "seq"], "seq"
    )
    return read_version(spark, path, last)
