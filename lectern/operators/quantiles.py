"""Exact percentiles by rank, without a key's values in one task.

Keys of few rows take the built-in functions. For a key of many, the wanted ranks are looked for: its values are counted in
CELLS cells between their least and greatest, in every task first; each rank falls into one cell, whose own least and
greatest value bound the next round. A rank is found once its cell has a single value, or so few rows that they are
ranked as they are. A round reads the rows of the cells in question alone and shuffles at most CELLS rows a rank and task.

There are at most `total / limit` keys of many rows, so their ranks are a small table that goes to all tasks.

Defined results: null values don't count; NaN counts as infinity. A key without values has null percentiles and n = 0
(n counts rows, as count(*) does). A null key is a key of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.lineage import release, written

#: Cells of a round, rows that a key of few rows has at most, and rounds after which the values left are counted one by one.
CELLS, FEW_ROWS, ROUNDS = 1024, 1_000_000, 30


def _same(keys: tuple[str, ...], left: DataFrame, right: DataFrame) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def _cell(value: Column, low: Column, high: Column) -> Column:
    """Number of a value's cell; infinities have cells of their own. Quarters, so that no difference overflows."""
    place = F.floor((value / 4 - low / 4) / F.nullif(high / 4 - low / 4, F.lit(0.0)) * CELLS)
    inside = F.greatest(F.lit(0), F.least(F.coalesce(place, F.lit(0)), F.lit(CELLS - 1)))
    return F.when(value == float("inf"), CELLS).when(value == float("-inf"), -1).otherwise(inside).cast("int")


def by_rank(rows: DataFrame, value: str, ranks: DataFrame, *keys: str, few: int = 10_000) -> DataFrame:
    """ranks (keys, which, rank from 0, over the key's non-null values in order) with the value at that rank. ranks is broadcast: a small table."""
    owner = f"quantiles {uuid.uuid4().hex}"
    v = F.when(F.isnan(F.col(value).cast("double")), float("inf")).otherwise(F.col(value).cast("double"))
    rows = rows.select(*keys, v.alias("v")).filter("v IS NOT NULL")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    edges = rows.groupBy(*keys).agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    first = ranks.join(F.broadcast(edges), _same(keys, ranks, edges)) if keys else ranks.crossJoin(F.broadcast(edges))
    start = [*[ranks[k] for k in keys], "which", "rank", "low", "high", F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"), F.lit(0).cast("long").alias("under"), F.lit(None).cast("long").alias("n")]
    open_, done = written(first.select(*start), owner), []
    names = [*keys, "which", "rank"]

    def inside(state: DataFrame) -> DataFrame:
        hit = _same(keys, rows, state) & (rows["v"] >= state["least"]) & (rows["v"] <= state["most"])
        return rows.join(F.broadcast(state), hit).select(*[state[c] for c in state.columns], rows["v"])

    for turn in range(ROUNDS + 1):
        if open_.isEmpty():
            break
        if turn == ROUNDS:
            small = open_
        else:
            cells = inside(open_).withColumn("cell", _cell(F.col("v"), F.col("low"), F.col("high")))
            counted = cells.groupBy(*names, "under", "cell").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
            upto = F.sum("c").over(Window.partitionBy(*names).orderBy("cell"))
            hit = counted.withColumn("upto", F.col("under") + upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
            state = written(hit.select(*names, F.col("least").alias("low"), F.col("most").alias("high"), "least", "most", (F.col("upto") - F.col("c")).alias("under"), F.col("c").alias("n")), owner)
            done.append(state.filter("least = most").select(*names, F.col("least").alias("value")))
            open_ = state.filter("least < most")
            small, open_ = open_.filter(F.col("n") <= few), open_.filter(F.col("n") > few)
        each = inside(small).groupBy(*names, "under", "v").agg(F.count("*").alias("c"))
        upto = F.col("under") + F.sum("c").over(Window.partitionBy(*names).orderBy("v"))
        done.append(each.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select(*names, F.col("v").alias("value")))
    out = written(_all(done, ranks, names))
    release(rows.sparkSession, owner)
    return out


def _all(done: list[DataFrame], ranks: DataFrame, names: list[str]) -> DataFrame:
    found = ranks.select(*names, F.lit(None).cast("double").alias("value")).limit(0)
    for d in done:
        found = found.union(d)
    return found


def percentiles(rows: DataFrame, value: str, *keys: str, limit: int = FEW_ROWS) -> DataFrame:
    """AGG-20/21/30: keys, p95 (nearest rank), median (interpolated), n; both exact. limit: rows of a key of few rows."""
    built_in = [F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.count("*").alias("n")]
    if rows.count() <= limit:  # so few rows that no key can have more
        return rows.groupBy(*keys).agg(*built_in)
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("known")))
    large = sizes.filter(F.col("known") > limit)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(*built_in)
    wanted = F.array(
        F.struct(F.lit("p95").alias("which"), F.greatest(F.ceil(F.col("known") * 95 / 100) - 1, F.lit(0)).alias("rank")),
        F.struct(F.lit("low").alias("which"), F.expr("(known - 1) DIV 2").alias("rank")),
        F.struct(F.lit("high").alias("which"), F.expr("known DIV 2").alias("rank")),
    )
    found = by_rank(rows, value, large.select(*keys, F.inline(wanted)), *keys)
    one = lambda which: F.max(F.when(F.col("which") == which, F.col("value")))
    of = found.groupBy(*keys).agg(one("p95").alias("p95"), ((one("low") + one("high")) / 2).alias("median"))
    hot = of.join(F.broadcast(large), _same(keys, of, large)).select(*[of[k] for k in keys], "p95", "median", "n")
    rest = rows.join(F.broadcast(large), _same(keys, rows, large), "left_anti") if keys else rows.limit(0)
    cold = rest.groupBy(*keys).agg(*built_in)
    return hot.union(cold) if keys else hot
