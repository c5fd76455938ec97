"""Mutations as frame-to-frame functions; the caller writes the result to a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor import constants as K


def merge_latest(old: DataFrame, new: DataFrame, key: str, order: str | None = None, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of the same key; within a batch the last by `order` wins; `keep_old` columns never change.

    Only the batch is deduplicated by a window; the table meets it in one join on the key. Without `order` the batch must not
    repeat a key: each repeat would be a row. A null key equals no other, so such rows of both sides stay.
    """
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    o, n = old.alias("o"), new.select(*old.columns).withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_old or c == key else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def merge_coalesce(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Per column the new value unless it is null: what is unmeasured never erases a measurement."""
    values = [c for c in old.columns if c != key]
    if order is not None:
        newest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order)))
        new = new.groupBy(key).agg(*(newest(c).alias(c) for c in values))
    o, n = old.alias("o"), new.select(*old.columns).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values)).select(*old.columns)


def prune(df: DataFrame, before_ms: int, keep_at_or_above: float = K.RETENTION_KEEP_MAGNITUDE) -> DataFrame:
    return df.where(~((F.col("time_ms") < before_ms) & (F.col("magnitude") < keep_at_or_above)))


def pruned_count(df: DataFrame, before_ms: int, keep_at_or_above: float = K.RETENTION_KEEP_MAGNITUDE) -> DataFrame:
    return df.agg(F.count_if((F.col("time_ms") < before_ms) & (F.col("magnitude") < keep_at_or_above)).alias("removed"))


def migrate(df: DataFrame, steps: list, done: int) -> tuple[DataFrame, int]:
    """Apply the steps after number `done`, in order; the caller writes a new version and keeps the old as the backup."""
    for step in steps[done:]:
        df = step(df)
    return df, len(steps)


def record_chunk(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ledger with chunks (year, min_magnitude, ...) recorded, one row a year and floor; a chunk done again replaces its row."""
    rows = ledger.join(chunks.select("year", "min_magnitude").distinct(), ["year", "min_magnitude"], "left_anti").select(*ledger.columns)
    return rows.unionByName(chunks.select(*ledger.columns))


def put_state(state: DataFrame, key: str, value: str, updated_ms: int) -> DataFrame:
    """The (key, value, updated_ms) table with one key set anew."""
    row = state.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(updated_ms).cast("long").alias("updated_ms"))
    return state.where(F.col("key") != key).unionByName(row)


def get_state(state: DataFrame, key: str) -> DataFrame:
    """The value of a key: no row where it was never set."""
    return state.where(F.col("key") == key).select("value")
