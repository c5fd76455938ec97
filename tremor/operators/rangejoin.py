"""Joins on ranges, as equi-joins on buckets with the exact condition on top, and counts of points up to an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.constants import HOUR_MS
from tremor.operators.tables import written


def bucket(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("long")


def interval_join(left: DataFrame, right: DataFrame, low: Column, high: Column, point: str, width: int, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows with low <= right.point <= high. `width` should be about the length of an interval: each then has two or three keys."""
    keyed = left.withColumn("_lo", low).withColumn("_hi", high).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo"), width), bucket(F.col("_hi"), width))))
    other = right.withColumn("_bucket_r", bucket(F.col(point), width))
    on = (F.col("_bucket") == F.col("_bucket_r")) & (F.col(point) >= F.col("_lo")) & (F.col(point) <= F.col("_hi"))
    if condition is not None:
        on = on & condition
    return keyed.join(other, on, how).drop("_lo", "_hi", "_bucket", "_bucket_r")


def counts_before(queries: DataFrame, points: DataFrame, at: str, point: str, name: str, inclusive: bool, width: int = HOUR_MS) -> DataFrame:
    """queries with the number of points before (or at) column `at`.

    Points are first counted by instant, so what is ordered within a slot of `width` is its distinct instants at most; counts
    of slots are summed up within groups of 1024 slots, and those of groups over all, a number that time bounds, not the data.
    """
    queries = written(queries, "queries")  # read twice below
    order = F.lit(0 if inclusive else 2)  # points at the same instant come before the query or after it
    instants = points.groupBy(F.col(point).cast("long").alias("_t")).agg(F.count("*").alias("_n")).where("_t is not null")
    marks = instants.select("_t", "_n", order.alias("_o")).unionByName(queries.select(F.col(at).cast("long").alias("_t"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_o")).where("_t is not null").distinct())
    marks = marks.withColumn("_slot", bucket(F.col("_t"), width)).withColumn("_group", F.floor(F.col("_slot") / 1024).cast("long"))
    earlier = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = marks.groupBy("_group", "_slot").agg(F.sum("_n").alias("_s"))
    groups = slots.groupBy("_group").agg(F.sum("_s").alias("_s")).select("_group", earlier(Window.orderBy("_group")).alias("_groups"))
    before = slots.select("_group", "_slot", earlier(Window.partitionBy("_group").orderBy("_slot")).alias("_slots")).join(groups, "_group").select("_slot", (F.col("_groups") + F.col("_slots")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_slot").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.withColumn("_within", within).where("_o = 1").join(before, "_slot").select("_t", (F.col("_before") + F.col("_within")).alias(name))
    return queries.join(found, F.col(at) == F.col("_t"), "left").select(*queries.columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def hourly_counts(points: DataFrame, point: str, start_ms: int, first: int, last: int) -> DataFrame:
    """(hour, before, at): for every hour of [first, last] from start_ms, the points before its start, and those at it."""
    hour, exact = F.floor((F.col(point) - start_ms) / HOUR_MS).cast("long"), ((F.col(point) - start_ms) % HOUR_MS == 0).cast("int")
    n = points.groupBy(F.least(F.greatest(hour, F.lit(first - 1)), F.lit(last)).alias("hour")).agg(F.count("*").alias("_n"), F.sum(exact).alias("_at"))
    early = F.col("hour") < first
    every = points.sparkSession.range(first - 1, last + 1).select(F.col("id").alias("hour")).join(n, "hour", "left").select("hour", F.coalesce("_n", F.lit(0)).alias("_n"), F.when(early, F.lit(0)).otherwise(F.coalesce("_at", F.lit(0))).alias("at"), F.floor(F.col("hour") / 1024).alias("_group"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = every.groupBy("_group").agg(F.sum("_n").alias("_s")).select("_group", earlier("_s", Window.orderBy("_group")).alias("_groups"))
    found = every.withColumn("_hours", earlier("_n", Window.partitionBy("_group").orderBy("hour"))).join(groups, "_group")
    return found.where(~early).select("hour", (F.col("_groups") + F.col("_hours")).alias("before"), "at")
