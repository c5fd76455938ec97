"""Pairs of events near in space and time, as an equi-join on cells: a latitude band, a longitude cell and a slot of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KM = 110.0  # a little less than a degree of latitude is long


def band(lat: Column, degrees: Column) -> Column:
    return F.floor((lat + 90) / degrees).cast("long")


def cells_in(band: Column, degrees: Column) -> Column:
    """How many cells as wide as a band is high fit into it at the poleward edge of the next one."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * degrees - 90), F.abs((band + 2) * degrees - 90)))
    return F.greatest(F.lit(1), F.floor(360 / degrees * F.cos(F.radians(edge)))).cast("long")


def cell(lon: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n)).cast("long")


def near_pairs(sources: DataFrame, targets: DataFrame, lat: str, lon: str, ms: str, reach: list[tuple[float, int]], condition: Column, source_class: Column | None = None, first_class: Column | None = None) -> DataFrame:
    """Sources with the targets (latitude, longitude, time_ms) that meet the condition, which has to hold the exact distance and time.

    `reach` gives km and milliseconds for each class of sources: no target further away or later can meet the condition. Cells
    are as large and slots as long as that, so that the cells next to a source's own and two slots hold all its targets; a
    place that is active for long is many keys, and sources that reach less far meet fewer. A source is on at most 18 keys; a
    target on one for each class from first_class on.
    """
    of = lambda value: F.element_at(F.array(*[F.lit(value(*r)) for r in reach]), F.col("class_") + 1)
    # Each quantity is a column: written out wherever it is used, they make a method that is too long for the JVM to compile.
    sized = lambda df: df.withColumns({"_degrees": of(lambda km, _: min(180.0, km / _KM)), "_length": of(lambda _, w: w)})
    near = lambda c, n=1: F.explode(F.sequence(F.col(c) - n, F.col(c) + 1))
    keyed = sized(sources.withColumn("class_", (source_class if source_class is not None else F.lit(0)).cast("int")))
    keyed = keyed.withColumns({"_slot": F.floor(F.col(ms) / F.col("_length")).cast("long"), "_band": band(F.col(lat), F.col("_degrees"))})
    keyed = keyed.withColumn("slot_", near("_slot", 0)).withColumn("band_", near("_band"))
    keyed = keyed.withColumn("_n", cells_in(F.col("band_"), F.col("_degrees"))).withColumn("_cell", cell(F.col(lon), F.col("_n")))
    around = F.when(F.col("_n") < 3, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1))
    keyed = keyed.withColumn("_cell", F.explode(around)).withColumn("cell_", F.pmod("_cell", "_n")).drop("_slot", "_band", "_cell", "_n", "_degrees", "_length")
    classes = F.sequence((first_class if first_class is not None else F.lit(0)).cast("int"), F.lit(len(reach) - 1))
    other = sized(targets.withColumn("class_", F.explode(classes)))
    other = other.withColumns({"slot_": F.floor(F.col("time_ms") / F.col("_length")).cast("long"), "band_": band(F.col("latitude"), F.col("_degrees"))})
    other = other.withColumn("_n", cells_in(F.col("band_"), F.col("_degrees"))).withColumn("cell_", cell(F.col("longitude"), F.col("_n"))).drop("_n", "_degrees", "_length")
    keys = ["class_", "slot_", "band_", "cell_"]
    return keyed.join(other, keys).where(condition).drop(*keys)
