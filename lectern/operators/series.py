"""Counters and other series by neighbouring samples, without a key's samples in one task.

`with_previous` deals rows out by ranges of (keys, time), so that a series of very many samples lies in several neighbouring
ranges. Within a range the sample before is a lag; the last sample of each range - a row a range - goes to all tasks,
for the first row of the range after it.

`counter_rates` follows the public rules of PromQL's increase() and rate(): samples that are stale markers (NaN) don't
count, a fall is a reset, and the growth between a range's first and last sample is extrapolated to the edges of the range,
unless the next sample would lie further than 1.1 mean distances away (then by half a distance) or the counter would begin below zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.lineage import written

PART_BITS = 33


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """rows with previous: a struct of the values in the sample before, of the same keys, by order; null for a key's first.

    order: columns that tell a key's samples apart. Null keys are a key of their own. ranges: how many, else as many as a shuffle has partitions.
    """
    by = [*keys, *order]
    dealt = (rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    laid = written(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftrightunsigned("__at", PART_BITS)))
    key, value = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k")]), F.struct(*values)
    sample = F.struct(key.alias("key"), value.alias("value"))
    last = laid.groupBy("__part").agg(F.max_by(sample, "__at").alias("__last"))  # a row a range
    edges = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__edge"))
    near = F.lag(sample).over(Window.partitionBy("__part").orderBy("__at"))
    joined = laid.withColumn("__near", near).join(F.broadcast(edges), "__part", "left").withColumn("__near", F.coalesce("__near", "__edge"))
    return joined.withColumn("previous", F.when(F.col("__near.key").eqNullSafe(key), F.col("__near.value"))).select(*rows.columns, "previous")


def increases(series: DataFrame, *keys: str, ranges: int | None = None) -> DataFrame:
    """STR-17: series (keys, ts, value, and id where one ts has several samples) with increase: growth since the sample before; after a reset the new value counts, 0 for the first."""
    order = ["ts", *(["id"] if "id" in series.columns else [])]
    before = F.col("previous.value")
    grown = F.when(F.col("value") >= before, F.col("value") - before).when(F.col("previous").isNull(), F.lit(0.0)).otherwise(F.col("value"))
    return with_previous(series, list(keys), order, ["value"], ranges).withColumn("increase", grown).drop("previous")


def rates(series: DataFrame, width: str, slide: str, *keys: str) -> DataFrame:
    """STR-17: growth in sliding ranges: at (the range's end), keys, increase. Summed in each task first."""
    rows = increases(series, *keys).groupBy(F.window("ts", width, slide), *keys).agg(F.sum("increase").alias("increase"))
    return rows.select(F.col("window.end").alias("at"), *keys, "increase")


def changes(series: DataFrame, *keys: str) -> DataFrame:
    """STR-21: keys, changes: how often the value differs from the sample before. series: keys, ts, value."""
    rows = with_previous(series, list(keys), ["ts"], ["value"])
    return rows.groupBy(*keys).agg(F.count_if(F.col("previous.value") != F.col("value")).alias("changes"))


def _seconds(column: Column | str) -> Column:
    return F.unix_micros(column) / 1_000_000


def counter_rates(series: DataFrame, width: str, slide: str, *keys: str) -> DataFrame:
    """STR-17: at, keys, samples, increase, rate (a second) of counters in ranges (at - width, at], as PromQL has them; none with fewer than two samples.

    series: keys, ts (timestamp), value, and id where one ts has several samples.
    """
    order = ["ts", *(["id"] if "id" in series.columns else [])]
    fresh = series.filter("value IS NOT NULL AND NOT isnan(value)")
    rows = with_previous(fresh, list(keys), order, ["ts", "value"])
    # Spark's windows hold their start and not their end; a range here is the other way round, so samples move by a microsecond.
    rows = rows.withColumn("moved", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
    window = rows.withColumn("w", F.window("moved", width, slide)).withColumns({"begin": F.col("w.start"), "at": F.col("w.end")})
    place = F.struct(*order)
    fell = (F.col("previous.ts") > F.col("begin")) & (F.col("value") < F.col("previous.value"))
    found = window.groupBy("begin", "at", *keys).agg(
        F.count("*").alias("samples"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min_by("value", place).alias("first"), F.max_by("value", place).alias("last"),
        F.sum(F.when(fell, F.col("previous.value")).otherwise(0.0)).alias("lost"),
    )
    grown = F.col("last") - F.col("first") + F.col("lost")
    found = found.filter("samples > 1 AND last_at > first_at").withColumns({"grown": grown, "span": _seconds("last_at") - _seconds("first_at"), "before": _seconds("first_at") - _seconds("begin"), "after": _seconds("at") - _seconds("last_at")})
    mean = F.col("span") / (F.col("samples") - 1)
    reach = lambda gap: F.when(F.col(gap) >= mean * 1.1, mean / 2).otherwise(F.col(gap))
    zero = F.when((F.col("grown") > 0) & (F.col("first") >= 0), F.col("span") * F.col("first") / F.col("grown"))
    stretched = (F.col("span") + F.least(reach("before"), zero) + reach("after")) / F.col("span")
    out = found.withColumn("increase", F.col("grown") * stretched)
    return out.select("at", *keys, "samples", "increase", (F.col("increase") / (_seconds("at") - _seconds("begin"))).alias("rate"))
