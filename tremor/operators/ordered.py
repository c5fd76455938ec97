"""Neighbours and running sums along an order, in slots of it: no key's rows are ordered in one task, however many it has.

Rows are in slots of the order's values; within a slot a window does the work, and between slots one row a slot is carried. With
the number of slots near the square root of the rows, both parts grow with that root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.tables import written


def slotted(df: DataFrame, order: str) -> DataFrame:
    """df, staged, with `_slot`: about as many slots as a slot has rows, for orders that are spread evenly; nulls have one of their own."""
    staged = written(df, "slots")
    a = staged.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(order).alias("n")).first()
    return in_slots(staged, order, max((a.b - a.a) / max(1.0, a.n**0.5), 1.0) if a.n else 1.0)


def in_slots(staged: DataFrame, order: str, width: float) -> DataFrame:
    return staged.withColumn("_slot", F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 62))))


def _met(rows: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its slot's; null keys are keys too."""
    other = slots.withColumnsRenamed({k: f"_{k}_of_slot" for k in [*keys, "_slot"]})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}_of_slot")) for k in [*keys, "_slot"]))
    return rows.join(other, same).drop(*(f"_{k}_of_slot" for k in [*keys, "_slot"]))


def neighbour(slots: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, *, after: bool = False) -> DataFrame:
    """slots (of slotted) with `name`, a struct of the columns in the row before (or after) in the same key; null at the ends.

    The slots' edge rows give what lies across a border, also over empty slots.
    """
    near, far = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    slot = Window.partitionBy(*keys, "_slot")
    first, last = F.row_number().over(slot.orderBy(*near)) == 1, F.row_number().over(slot.orderBy(*far)) == 1
    value, shift = F.struct(*columns), F.lead if after else F.lag
    inside = slots.withColumns({name: shift(value).over(slot.orderBy(*near)), "_edge": last if after else first})
    edges = slots.withColumn("_given", first if after else last).where("_given").select(*keys, "_slot", value.alias("_v"))
    border = edges.select(*keys, "_slot", shift("_v").over(Window.partitionBy(*keys).orderBy("_slot")).alias("_across"))
    return _met(inside, border, keys).withColumn(name, F.when(F.col("_edge"), F.col("_across")).otherwise(F.col(name))).drop("_edge", "_across")


def running_sum(slots: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """slots with `name`, the sum of the value up to and with each row of the key."""
    staged = slots.withColumn("_x", value)
    inside = staged.withColumn("_in", F.sum("_x").over(Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = staged.groupBy(*keys, "_slot").agg(F.sum("_x").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_slot", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    return _met(inside, carried, keys).withColumn(name, F.col("_in") + F.col("_c")).drop("_x", "_in", "_c")
