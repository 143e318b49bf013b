"""Time axes without gaps: what was not seen in a unit of time is not good, however good its neighbours are.

A key's axis is made unit by unit between its ends and dealt over tasks before samples are joined to it. Runs of good units are what
lies between two units that aren't good, which `series.with_previous` finds over ranges; no key's axis is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.series import with_previous


def dense(samples: DataFrame, key: str, seconds: int = 1, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """WIN-09: key, unit (number of the unit since 1970), samples, ok of every unit from a key's first to its last sample, or between start and end.

    samples: key, ts, ok. A unit is ok if it has a sample and all its samples are good.
    """
    number = F.expr(f"unix_micros(cast(ts AS timestamp)) DIV {seconds * 1_000_000}")
    seen = samples.withColumn("unit", number).groupBy(key, "unit").agg(F.count("*").alias("samples"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    place = lambda at: F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000)
    low = F.floor(place(start)) if start is not None else F.min("unit")
    high = F.floor(place(end)) if end is not None else F.max("unit")
    ends = seen.groupBy(key).agg(low.cast("long").alias("low"), high.cast("long").alias("high"))
    block = 1 << 16  # an axis is made in blocks, so that a long one isn't a row
    blocks = ends.select(key, "high", F.explode(F.sequence("low", "high", F.lit(block).cast("long"))).alias("low"))
    axis = blocks.repartition(F.col(key), F.col("low")).select(key, F.explode(F.sequence("low", F.least("high", F.col("low") + block - 1))).alias("unit"))
    return axis.join(seen, [key, "unit"], "left").select(key, "unit", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("ok", F.lit(False)).alias("ok"))


def steady_from(axis: DataFrame, samples: DataFrame, key: str, seconds: int = 1, run: int = 5) -> DataFrame:
    """WIN-09: key, last_bad, steady_from, recovery_units: the first of `run` good units in a row after a key's last bad sample; null where there are none.

    axis: see dense(); samples: key, ts, ok. A key without a bad sample counts from its first unit, with last_bad null.
    """
    number = F.expr(f"unix_micros(cast(ts AS timestamp)) DIV {seconds * 1_000_000}")
    bad = samples.filter(~F.coalesce("ok", F.lit(False))).groupBy(key).agg(F.max(number).alias("last_bad"))
    ends = axis.groupBy(key).agg(F.min("unit").alias("first"), F.max("unit").alias("last")).join(bad, key, "left")
    # Units that end a run: those that aren't good, the one before the axis and the one behind it.
    breaks = axis.filter("NOT ok").select(key, "unit").union(ends.select(key, F.col("first") - 1)).union(ends.select(key, F.col("last") + 1))
    gaps = with_previous(breaks, [key], ["unit"], ["unit"])
    good = gaps.filter(F.col("unit") - F.col("previous.unit") > run).select(key, (F.col("previous.unit") + 1).alias("begin"), F.col("unit").alias("stop"))
    good = good.join(ends, key).withColumn("begin", F.greatest("begin", F.coalesce(F.col("last_bad") + 1, F.col("begin")))).filter(F.col("stop") - F.col("begin") >= run)
    found = good.groupBy(key).agg(F.min("begin").alias("steady_from"))
    out = ends.join(found, key, "left")
    return out.select(key, "last_bad", "steady_from", (F.col("steady_from") - F.coalesce("last_bad", F.col("first") - 1)).alias("recovery_units"))


def first_confirmed(samples: DataFrame, key: str, run: int = 3) -> DataFrame:
    """WIN-13: key, not_before, reached_at, confirmed_at: the first of `run` samples in a row that are ok, the one before it, and the last of the run.

    samples: key, ts (distinct within a key), ok. The state was reached after not_before (null: from the first sample on) and by reached_at.
    """
    rows = samples.select(key, "ts", F.coalesce("ok", F.lit(False)).alias("ok"))
    looked = rows
    for k in range(1, run + 1):  # the sample k places back is the one k - 1 places back of the sample before
        back = with_previous(looked, [key], ["ts"], ["ts", "ok", *[f"b{i}" for i in range(1, k)]])
        value = F.struct(F.col("previous.ts").alias("ts"), F.col("previous.ok").alias("ok")) if k == 1 else F.col(f"previous.b{k - 1}")
        looked = back.withColumn(f"b{k}", F.when(F.col("previous").isNotNull(), value)).drop("previous")
    run_ok = F.col("ok")
    for k in range(1, run):
        run_ok = run_ok & F.coalesce(F.col(f"b{k}.ok"), F.lit(False))
    first = F.col("ts") if run == 1 else F.col(f"b{run - 1}.ts")
    hit = looked.filter(run_ok).select(key, F.struct(first.alias("reached_at"), F.col("ts").alias("confirmed_at"), F.col(f"b{run}.ts").alias("not_before")).alias("hit"))
    found = hit.groupBy(key).agg(F.min("hit").alias("hit"))
    return found.select(key, "hit.not_before", "hit.reached_at", "hit.confirmed_at")
