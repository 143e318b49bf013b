"""Operations analytics: event logs, ledgers and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.quantiles import percentiles  # noqa: F401
from lectern.operators.series import changes, increases, rates  # noqa: F401


def mean_millis(rows: DataFrame, start: str, end: str) -> DataFrame:
    """AGG-07: mean time from start to end in whole milliseconds; null without rows."""
    return rows.agg(F.round(F.avg(F.timestamp_diff("MICROSECOND", start, end) / 1000)).cast("long").alias("mean_ms"))


def buckets(events: DataFrame, unit: str = "second") -> DataFrame:
    """AGG-19, FN-13: good and bad calls in each unit of time. events: ts, ok."""
    return events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


def first_steady(series: DataFrame, key: str, run: int = 5) -> DataFrame:
    """WIN-09, WIN-13: per key the first step from which `run` steps in a row are all good. series: key, step (dense), ok."""
    ahead = Window.partitionBy(key).orderBy("step").rowsBetween(0, run - 1)
    rows = series.withColumns({"all_ok": F.min("ok").over(ahead), "seen": F.count("*").over(ahead)})
    return rows.filter(F.col("all_ok") & (F.col("seen") == run)).groupBy(key).agg(F.min("step").alias("steady_from"))


def anchors(events: DataFrame, mark: Column) -> DataFrame:
    """WIN-12: last good before the mark, first bad, first good after the mark."""
    ok, ts = F.col("ok"), F.col("ts")
    return events.agg(F.max(F.when(ok & (ts < mark), ts)).alias("last_good"), F.min(F.when(~ok & (ts >= mark), ts)).alias("first_bad"), F.min(F.when(ok & (ts >= mark), ts)).alias("next_good"))


def first_above(series: DataFrame, mark: Column) -> DataFrame:
    """WIN-14: first step at which a counter exceeds its last value before the mark."""
    base = series.filter(F.col("ts") < mark).agg(F.max_by("value", "ts").alias("base"))
    return series.filter(F.col("ts") >= mark).crossJoin(F.broadcast(base)).filter(F.col("value") > F.col("base")).agg(F.min("ts").alias("first_ts"), F.min("base").alias("base"))


def reconcile_ledger(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """JOIN-18: one row: acknowledged but missing, stored more than once, stored but never sent. sent: request_id, acked; stored: request_id, row_count."""
    both = sent.withColumn("sent", F.lit(True)).join(stored, "request_id", "full_outer")
    rows = F.coalesce("row_count", F.lit(0))
    return both.agg(
        F.count_if(F.col("sent")).alias("sent"), F.count_if(F.col("acked") & (rows == 0)).alias("missing"), F.count_if(rows > 1).alias("duplicated"), F.count_if(F.col("sent").isNull()).alias("unknown"),
        F.coalesce(~F.bool_or((F.col("acked") & (rows == 0)) | (rows > 1)), F.lit(True)).alias("clean"),
    )


def align(left: DataFrame, right: DataFrame, unit: str = "second") -> DataFrame:
    """JOIN-17: two series (ts, value), summed by unit, outer-joined."""
    cut = lambda d, name: d.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.sum("value").alias(name))
    return cut(left, "left_value").join(cut(right, "right_value"), "bucket", "full_outer")


def held(rows: DataFrame, *keys: str, steps: int) -> DataFrame:
    """STR-17 (for), STR-31: keys and times from which the condition `firing` has held for so many samples."""
    back = Window.partitionBy(*keys).orderBy("at").rowsBetween(-(steps - 1), 0)
    return rows.withColumns({"all_on": F.min("firing").over(back), "seen": F.count("*").over(back)}).filter(F.col("all_on") & (F.col("seen") == steps)).select(*keys, "at")


def ratio_alert(rows: DataFrame, floor: float = 0.001, most: float = 0.2, least: int = 20) -> DataFrame:
    """STR-18: share of failures above a limit, with a floor under the divisor and a minimum volume. rows: at, failed, total."""
    share = F.col("failed") / F.greatest(F.col("total"), F.lit(floor))
    return rows.filter((F.col("total") >= least) & (share > most)).select("at", F.round(share, 6).alias("share"))


def histogram_quantile(rows: DataFrame, q: float, *keys: str) -> DataFrame:
    """STR-20: quantile from cumulative counts by upper bound (le, count), linear within a bucket. keys: groups."""
    order = Window.partitionBy(*keys).orderBy("le")
    rows = rows.withColumns({"low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "under": F.coalesce(F.lag("count").over(order), F.lit(0)), "rank": F.lit(q) * F.max("count").over(Window.partitionBy(*keys))})
    hit = rows.filter((F.col("count") >= F.col("rank")) & (F.col("under") < F.col("rank")))
    return hit.select(*keys, F.round(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("under")) / (F.col("count") - F.col("under")), 6).alias("quantile"))


def success_rate(rows: DataFrame, done: str = "DONE", failed: str = "FAILED") -> DataFrame:
    """AGG-15: processed, failed, and the share of processed among both in per cent with one decimal; null without either. rows: status."""
    n, bad = F.count_if(F.col("status") == done), F.count_if(F.col("status") == failed)
    return rows.agg(n.alias("done"), bad.alias("failed"), (F.round(n * 1000 / F.nullif(n + bad, F.lit(0)), 0) / 10).alias("per_cent"))


def ledger_audit(sent: DataFrame, stored: DataFrame, recovered_at: Column) -> DataFrame:
    """AGG-27: one row: calls by outcome, acknowledged but missing with the first and last such time, repeated ids, the same after recovery, verdict.

    sent: request_id, acked, at. stored: request_id, row_count.
    """
    rows = sent.join(stored, "request_id", "left").withColumn("n", F.coalesce("row_count", F.lit(0)))
    lost, later = F.col("acked") & (F.col("n") == 0), F.col("at") >= recovered_at
    out = rows.agg(
        F.count_if("acked").alias("acked"), F.count_if(~F.col("acked")).alias("refused"), F.count_if(lost).alias("missing"), F.min(F.when(lost, F.col("at"))).alias("first_missing"), F.max(F.when(lost, F.col("at"))).alias("last_missing"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(later).alias("later"), F.count_if(later & lost).alias("later_missing"),
    )
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("repeated") == 0))


def bounds(rows: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """AGG-29: first and last time of each run."""
    return rows.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def recovery_verdict(rows: DataFrame, expected: int) -> DataFrame:
    """AGG-24: one row: finished, incomplete, duplicated, retried, and whether all is well. rows: status, chunks, vectors, copies, retries."""
    done, same = F.col("status") == "INDEXED", F.col("chunks") == F.col("vectors")
    return rows.agg(F.count("*").alias("seen"), F.count_if(~done).alias("incomplete"), F.count_if(done & ~same).alias("mismatched"), F.count_if(F.col("copies") > 0).alias("duplicated"), F.count_if(F.col("retries") > 0).alias("retried")).withColumn("passed", (F.col("seen") == expected) & (F.col("incomplete") + F.col("mismatched") + F.col("duplicated") == 0))


def classified(rows: DataFrame, patterns: dict[str, str], text: str = "query") -> DataFrame:
    """AGG-28: the first class whose pattern a statement matches; others have none."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        kind = F.when(F.col(text).rlike(pattern), name).otherwise(kind)
    return rows.withColumn("class", kind)
