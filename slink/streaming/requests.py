"""First requests per cache key inside the cache lifetime, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slink.functions import fixed_values as fixed

OUTPUT = "key string, request_id long, micros long"
STATE = "last long, micros array<long>, ids array<long>"
LIFETIME_MICROS = fixed.CACHE_SECONDS * 1_000_000


def accepted_positions(micros: np.ndarray, last: int | None, lifetime: int = LIFETIME_MICROS) -> list[int]:
    """Positions, in sorted times, of requests that find no live entry and so write one.

    Jumps from one accepted request to the first one past its lifetime, so the
    work is per accepted request, not per request.
    """
    taken: list[int] = []
    place = 0 if last is None else int(np.searchsorted(micros, last + lifetime, side="left"))
    while place < len(micros):
        taken.append(place)
        place = int(np.searchsorted(micros, micros[place] + lifetime, side="left"))
    return taken


def first_per_time(rows: np.ndarray) -> np.ndarray:
    """Rows (micros, request_id) in order of time, of each time that with the least id: no other can be accepted."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, rows[1:, 0] != rows[:-1, 0]]] if len(rows) else rows


def _first_requests(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, micros, ids = state.get if state.exists else (None, [], [])
    rows = np.array([micros, ids], np.int64).reshape(2, -1).T
    # One row per distinct time is held, and each piece is cut to that as it comes.
    for batch in [] if state.hasTimedOut else batches:
        rows = first_per_time(np.concatenate([rows, batch[["micros", "request_id"]].to_numpy(dtype=np.int64)]))
    # No earlier request can come before the watermark, so what lies before it is decided, in order of time.
    watermark = state.getCurrentWatermarkMs()
    open_from = int(np.searchsorted(rows[:, 0], watermark * 1000, side="left"))
    decided, rows = rows[:open_from], rows[open_from:]
    taken = accepted_positions(decided[:, 0], last)
    if taken:
        last = int(decided[taken[-1], 0])
    expired = last is None or (last + LIFETIME_MICROS) // 1000 < watermark
    if len(rows) or not expired:
        state.update((last, rows[:, 0].tolist(), rows[:, 1].tolist()))
        due = int(rows[0, 0]) // 1000 if len(rows) else (last + LIFETIME_MICROS) // 1000 + 1
        state.setTimeoutTimestamp(max(due, watermark + 1))
    elif state.exists:
        state.remove()
    if taken:
        yield pd.DataFrame({"key": key[0], "request_id": decided[taken, 1], "micros": decided[taken, 0]})


def first_requests_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests (key, ts, request_id) that were not in the cache; a live key drops its later requests.

    A request is decided when the watermark has passed it, so the answer does
    not depend on how arrivals fall into micro-batches; until then it waits in
    the state of its key. The state is removed once the watermark has passed
    the last entry's lifetime. Rows later than `delay` are dropped. Bound the
    micro-batch at the source, for example with `maxFilesPerTrigger`.
    """
    ts = F.col("ts").cast("timestamp")
    if isinstance(requests.schema["ts"].dataType, T.TimestampNTZType):
        # A time without zone counts as UTC, whatever the session's zone is.
        ts = F.from_utc_timestamp(ts, F.current_timezone())
    timed = requests.select("key", "request_id", ts.alias("ts")).withColumn("micros", F.unix_micros("ts"))
    return (
        timed.withWatermark("ts", delay)
        .groupBy("key")
        .applyInPandasWithState(_first_requests, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything there is and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
