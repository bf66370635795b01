import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slink.plans import streaming_queries
from slink.streaming import requests
from slink.streaming.catalog_stream import catalog_upsert_stream, read_version
from slink.streaming.requests import LIFETIME_MICROS, accepted_positions, first_requests_stream, write_stream

START = datetime.datetime(2024, 1, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def test_accepted_positions():
    hour = 3_600_000_000
    times = np.array([0, 1, 47, 48, 95, 96, 200]) * hour
    assert accepted_positions(times, None) == [0, 3, 5, 6]
    assert accepted_positions(times, 40 * hour) == [4, 6]
    assert accepted_positions(times, 300 * hour) == []


def run(spark, tmp_path, batches):
    """Batches arrive as files, one micro-batch each; a last row far ahead lets the watermark pass all others."""
    for rows in [*batches, [("ahead", at(10_000), -1)]]:
        spark.createDataFrame(rows, "key string, ts timestamp, request_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, request_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_stream(first_requests_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted((r.key, r.request_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_state_lives_across_batches(spark, tmp_path):
    got = run(
        spark,
        tmp_path,
        [
            [("a", at(1), 2), ("a", at(0), 1), ("b", at(2), 3)],
            [("a", at(40), 4), ("a", at(48), 5), ("b", at(49), 6)],
            [("a", at(95), 7), ("b", at(97), 8), ("a", at(96), 9)],
        ],
    )
    assert got == [("a", 1), ("a", 5), ("a", 9), ("b", 3), ("b", 8)]


def test_late_rows_are_dropped(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", at(0), 1)], [("a", at(200), 2)], [("b", at(10), 3), ("a", at(201), 4)], [("c", at(10), 5), ("a", at(249), 6)]])
    assert ("c", 5) not in got and ("a", 2) in got and ("a", 6) in got and ("a", 4) not in got


def test_answer_does_not_depend_on_micro_batches(spark, tmp_path):
    rows = [("k", at(1), 1), ("k", at(0.5), 2), ("j", at(1.2), 4), ("j", at(0.4), 5), ("k", at(48.6), 3)]
    for name, batches in (("one", [rows]), ("two", [rows[:1] + rows[2:3], rows[1:2] + rows[3:]])):
        assert run(spark, tmp_path / name, batches) == [("j", 5), ("k", 2), ("k", 3)]


def test_earlier_request_in_a_later_batch_counts(spark, tmp_path):
    assert run(spark, tmp_path, [[("k", at(1), 1)], [("k", at(0.5), 2)]]) == [("k", 2)]


def test_hot_key_keeps_its_distance(spark, tmp_path):
    rows = [("hot", at(i / 10), i) for i in range(5000)]
    got = run(spark, tmp_path, [rows[:2500], rows[2500:]])
    times = [rows[i][1] for _, i in got if _ == "hot"]
    times.sort()
    assert len(times) == 11
    assert all((b - a).total_seconds() * 1e6 >= LIFETIME_MICROS for a, b in zip(times, times[1:]))


def test_catalog_versions(spark, tmp_path):
    schema = "table_name string, column_name string, rows long, seq int"
    for rows in ([("T", "A", 1, 0), ("T", "B", 1, 0)], [("T", "A", 2, 1), ("T", "A", 3, 2)], [("T", "C", 9, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = catalog_upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["table_name", "column_name"], ["rows", "seq"], "seq")
    final = {r.column_name: r.rows for r in read_version(spark, str(tmp_path / "out"), last).collect()}
    assert final == {"A": 3, "B": 1, "C": 9}
    assert read_version(spark, str(tmp_path / "out"), 0).filter(F.col("column_name") == "C").count() == 0
    # A restart without new data keeps the last version; with new data it builds on it.
    again = [stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["table_name", "column_name"], ["rows", "seq"], "seq"]
    assert catalog_upsert_stream(*again) == last
    spark.createDataFrame([("T", "D", 4, 4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = catalog_upsert_stream(*again)
    assert later > last and read_version(spark, str(tmp_path / "out"), later).count() == 4


def test_arrivals_grow_with_the_table_and_come_in_order(spark):
    rows = [(i, "p", START + datetime.timedelta(minutes=i)) for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, props string, ts timestamp_ntz")
    path = streaming_queries.arrivals(spark, events, rows=300)
    meta = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    files = spark.read.parquet(path).groupBy(meta[0].alias("f"), meta[1].alias("t")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    files = files.orderBy("t").collect()
    assert len(files) >= 9 and sum(f.n for f in files) == 3000 and max(f.n for f in files) < 600
    late = datetime.timedelta(hours=1)
    assert all(b.lo > max(a.hi for a in files[: i + 1]) - late for i, b in enumerate(files[1:]))


def test_state_holds_distinct_times_only():
    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, at):
            pass

    state = State()
    pieces = [pd.DataFrame({"micros": [7, 5, 7, 5], "request_id": [i + 4, i + 3, i + 2, i + 9]}) for i in (30, 10, 20)]
    assert list(requests._first_requests(("hot",), iter(pieces), state)) == []
    assert state.value == (None, [5, 7], [13, 12])
