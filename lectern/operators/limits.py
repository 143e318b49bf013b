"""Sequential rules over ordered events: first-call-anchored rate limits, idle backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate_limit(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """STR-14: per call (key, at_ms, call_id) whether it is allowed. A key's window starts with its first call after the last one ended.

    One sorted scan a partition: between batches only the key, its window's start and use are carried, so no key is ever in memory as a whole.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, used = object(), 0, 0
        for batch in batches:
            allowed = np.zeros(len(batch), bool)
            for i, (k, at) in enumerate(zip(batch.key, batch.at_ms, strict=True)):
                if k != key or at - opened >= window_ms:
                    key, opened, used = k, at, 0
                used += 1
                allowed[i] = used <= limit
            yield pd.DataFrame({"key": batch.key, "call_id": batch.call_id, "allowed": allowed})

    rows = calls.select("key", "at_ms", "call_id").repartition("key").sortWithinPartitions("key", "at_ms", "call_id")
    kinds = dict(calls.dtypes)
    return rows.mapInPandas(scan, f"key {kinds['key']}, call_id {kinds['call_id']}, allowed boolean")


def idle_waits(polls: DataFrame, first_ms: int = 500, most_ms: int = 8000) -> DataFrame:
    """STR-16: wait after each poll (key, poll_no, found): doubles while nothing is found, starts anew on work.

    The number of polls since the last find is a row number, so windows do without a fold.
    """
    order = Window.partitionBy("key").orderBy("poll_no")
    rows = polls.withColumn("finds", F.count_if("found").over(order))
    nth = F.row_number().over(Window.partitionBy("key", "finds").orderBy("poll_no")) - F.when(F.col("finds") > 0, 1).otherwise(0)
    wait = F.least(F.lit(first_ms) * F.pow(F.lit(2.0), F.least(nth, F.lit(40))), F.lit(float(most_ms)))
    return rows.select("key", "poll_no", wait.cast("int").alias("wait_ms"))
