"""Gardner-Knopoff declustering as a fix-point over the edges from larger to later, nearer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.constants import DAY_MS, KM_PER_DEGREE
from tremor.functions import geo
from tremor.operators.spacetime import near_pairs
from tremor.operators.tables import written


def gk_radius_km(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 0.1238 * magnitude + 0.983)


def gk_window_days(magnitude: Column) -> Column:
    """Not continuous at 6.5, as published."""
    return F.when(magnitude >= 6.5, F.pow(F.lit(10.0), 0.032 * magnitude + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * magnitude - 0.547))


#: Magnitudes up to which sources are paired in the same cells; windows and radii grow with them.
CLASSES = (4.0, 5.0, 5.5, 6.0, 6.5, 7.5, 10.0)


def class_of(magnitude: Column) -> Column:
    return F.least(F.lit(len(CLASSES) - 1), sum((magnitude > top).cast("int") for top in CLASSES))


def reaches() -> list[tuple[float, int]]:
    """The largest radius and longest window of each class. The window is not continuous at 6.5, so both sides count."""
    radius, window = (lambda m: 10 ** (0.1238 * m + 0.983)), (lambda m: 10 ** (0.032 * m + 2.7389) if m >= 6.5 else 10 ** (0.5409 * m - 0.547))
    return [(radius(m) * 1.001, int(max(window(m), window(min(m, 6.4999)), 1.0) * DAY_MS) + 1) for m in CLASSES]


def by_class(sources: DataFrame, targets: DataFrame, magnitude: str, lat: str, lon: str, ms: str, near: Column, least: str | None = None) -> DataFrame:
    """Sources with the targets in their own window and radius that meet `near`.

    Small events, which are most, have small cells and short slots and meet few others. `least` names the targets' magnitude
    where targets are never larger than their source.
    """
    first = None if least is None else class_of(F.col(least))
    return near_pairs(sources.where(F.col(magnitude).isNotNull()), targets if least is None else targets.where(F.col(least).isNotNull()), lat, lon, ms, reaches(), near, class_of(F.col(magnitude)), first)


def edges(events: DataFrame) -> DataFrame:
    """(src, dst): dst lies within src's window and radius and comes later in order (magnitude descending, time, id).

    Magnitudes above 10 do not occur; radii and windows of the last class are those of magnitude 10.
    """
    e = events.select("event_id", "time_ms", "magnitude", "latitude", "longitude")
    src = e.select(*(F.col(c).alias(f"s_{c}") for c in e.columns))
    gap = F.col("time_ms") - F.col("s_time_ms")
    later = (F.col("s_magnitude") > F.col("magnitude")) | (F.col("s_magnitude") == F.col("magnitude"))
    near = (gap > 0) & later & (gap <= gk_window_days(F.col("s_magnitude")) * DAY_MS) & (F.abs(F.col("s_latitude") - F.col("latitude")) * KM_PER_DEGREE * 0.99 <= gk_radius_km(F.col("s_magnitude")))
    near = near & (geo.haversine_km("s_latitude", "s_longitude", "latitude", "longitude") <= gk_radius_km(F.col("s_magnitude")))
    return by_class(src, e, "s_magnitude", "s_latitude", "s_longitude", "s_time_ms", near, "magnitude").select(F.col("s_event_id").alias("src"), F.col("event_id").alias("dst"))


def independent_ids(events: DataFrame) -> DataFrame:
    """Ids of the events that no independent event makes dependent.

    Each round settles the events without an unsettled cause: they are independent, what they cause is dependent, and neither
    matters to the rest. A round keeps only the edges that are left, so rounds shrink quickly; in the end, what was never
    caused is independent.
    """
    left, dependent = written(edges(events), "edges"), None
    named = lambda df, c: df.select(F.col("event_id").alias(c))
    while not left.isEmpty():
        caused_by = left.select(F.col("dst").alias("event_id")).distinct()
        free = left.select(F.col("src").alias("event_id")).distinct().join(caused_by, "event_id", "left_anti")
        caused = written(left.join(named(free, "src"), "src", "left_semi").select(F.col("dst").alias("event_id")).distinct(), "caused")
        settled = free.union(caused)
        dependent = caused if dependent is None else dependent.union(caused)
        left = written(left.join(named(caused, "dst"), "dst", "left_anti").join(named(settled, "src"), "src", "left_anti"), "edges")
    ids = events.select("event_id")
    return (ids if dependent is None else ids.join(dependent, "event_id", "left_anti")).distinct()


def decluster(events: DataFrame) -> DataFrame:
    return events.join(independent_ids(events), "event_id", "left_semi")
