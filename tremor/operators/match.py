"""Matching events across catalogues: candidates, duplicates, mechanisms, nearest polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo
from tremor.operators import spacetime
from tremor.operators.rangejoin import interval_join
from tremor.operators.tables import written


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def candidate_matches(a: DataFrame, b: DataFrame, within_s: int, radius_deg: float = 1.0) -> DataFrame:
    """Pairs within a time band and a box of degrees; the box does not wrap at 180."""
    ms = within_s * 1000
    near = (F.abs(F.col("a_latitude") - F.col("b_latitude")) <= radius_deg) & (F.abs(F.col("a_longitude") - F.col("b_longitude")) <= radius_deg)
    return interval_join(_as(a, "a_"), _as(b, "b_"), F.col("a_time_ms") - ms, F.col("a_time_ms") + ms, "b_time_ms", 2 * ms, near)


def _duplicate() -> Column:
    return (F.abs(F.col("a_magnitude") - F.col("b_magnitude")) <= K.DUPLICATE_MAGNITUDE) & (geo.haversine_km("a_latitude", "a_longitude", "b_latitude", "b_longitude") <= K.DUPLICATE_KM)


def reject_duplicates(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming events of which no known event is a probable duplicate."""
    ms = K.DUPLICATE_SECONDS * 1000
    hit = interval_join(_as(incoming, "a_"), _as(known, "b_"), F.col("a_time_ms") - ms, F.col("a_time_ms") + ms, "b_time_ms", 2 * ms, _duplicate())
    return incoming.join(hit.select(F.col("a_event_id").alias("event_id")).distinct(), "event_id", "left_anti")


def match_mechanisms(events: DataFrame, mechanisms: DataFrame, seconds: int = K.MECHANISM_SECONDS, km: float = K.MECHANISM_KM) -> DataFrame:
    """One row an event: mech_id, distance and contested or not. The nearest mechanism in the band wins; of events that want
    the same mechanism the closest keeps it, then the one nearer in time, then the first; the rest stay unmatched."""
    ms = seconds * 1000
    pairs = interval_join(_as(events, "a_"), _as(mechanisms, "b_"), F.col("a_time_ms") - ms, F.col("a_time_ms") + ms, "b_time_ms", 2 * ms)
    placed = pairs.withColumn("dist", geo.haversine_km("a_latitude", "a_longitude", "b_latitude", "b_longitude")).where(F.col("dist") <= km)
    near = placed.withColumn("r", F.row_number().over(Window.partitionBy("a_event_id").orderBy("dist", "b_time_ms", "b_event_id"))).where("r = 1")
    own = F.row_number().over(Window.partitionBy("b_event_id").orderBy("dist", F.abs(F.col("a_time_ms") - F.col("b_time_ms")), "a_time_ms", "a_event_id"))
    kept = near.withColumn("k", own).select(F.col("a_event_id").alias("event_id"), F.when(F.col("k") == 1, F.col("b_event_id")).alias("mech_id"), F.when(F.col("k") == 1, F.col("dist")).alias("distance_km"), (F.col("k") > 1).alias("contested"))
    return events.select("event_id").join(kept, "event_id", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))


def segments(lines: DataFrame) -> DataFrame:
    """(line, seq, ax, ay, bx, by) of polylines given as [lon, lat, lon, lat, ...]; one vertex is a segment of no length; none is none."""
    n = F.expr("size(p) div 2")
    some = lines.where(F.size("p") >= 2).withColumn("seq", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))))
    at = lambda k: F.element_at("p", F.least(2 * F.col("seq") + k, F.size("p") - (4 - k) % 2).cast("int"))
    return some.select("line", "seq", at(1).alias("ax"), at(2).alias("ay"), at(3).alias("bx"), at(4).alias("by"))


GLOBE_SQUARE_DEGREES = 41_253
#: Points that meet segments in one task: what a task orders does not grow with the input.
POINTS_A_TASK = 25_000


def nearest_line(points: DataFrame, segs: DataFrame, key: str = "event_id", first_degrees: float | None = None) -> DataFrame:
    """The nearest line of each point; the first line wins ties.

    Points meet the segments that may be within some degrees, by cells of that size; a point whose nearest is closer than that
    is done, the others try cells four times as large. A segment is in the cells that its box, widened by a cell, touches. The first
    cells are as large as the share of the globe that falls to one segment, so most points are done at once and meet few segments.
    Points are dealt by key before they meet segments, so many to a task; with segments broadcast, the least of a point needs no more shuffle.
    """
    if first_degrees is None:
        first_degrees = min(180.0, (GLOBE_SQUARE_DEGREES / max(1, segs.count())) ** 0.5)
    d = geo.segment_km("latitude", "longitude", "ax", "ay", "bx", "by")
    best = F.min(F.struct(d.alias("km"), F.col("line").alias("line")))
    left, done, degrees = points.select(key, "latitude", "longitude"), None, first_degrees
    step = F.pmod(F.col("bx") - F.col("ax") + 180, F.lit(360.0)) - 180  # the short way round
    boxed = segs.withColumn("west", F.least("ax", F.col("ax") + step)).withColumn("east", F.greatest("ax", F.col("ax") + step))
    # Seen from the other side of the globe the ends lie to the left and to the right, and the plane's segment runs by the point.
    opposite = boxed.where("ax <> bx").withColumns({"west": F.col("west") + 180, "east": F.col("east") + 180})
    boxed = written(boxed.unionByName(opposite), "segments")
    count = left.count()
    while True:
        last = degrees >= 180
        deg = F.lit(min(degrees, 180.0))
        cut = boxed.withColumn("band_", F.explode(F.sequence(spacetime.band(F.least("ay", "by"), deg) - 1, spacetime.band(F.greatest("ay", "by"), deg) + 1)))
        n = F.lit(1).cast("long") if last else spacetime.cells_in(F.col("band_"), deg)
        low, high = (F.floor((F.col(c) + 180) / 360 * n).cast("long") + k for c, k in (("west", -1), ("east", 1)))
        cut = cut.withColumn("cell_", F.explode(F.array_distinct(F.transform(F.sequence(low, F.least(high, low + n - 1)), lambda c: F.pmod(c, n)))))
        own = left.repartition(max(1, -(-count // POINTS_A_TASK)), key).withColumn("band_", spacetime.band(F.col("latitude"), deg))
        own = own.withColumn("cell_", spacetime.cell(F.col("longitude"), F.lit(1).cast("long") if last else spacetime.cells_in(F.col("band_"), deg)))
        got = own.join(cut, ["band_", "cell_"]).groupBy(key).agg(best.alias("b")).select(key, F.col("b.line").alias("line"), F.col("b.km").alias("distance_km"))
        sure = got if last else written(got.where(F.col("distance_km") <= degrees * 110.0), "nearest")
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        left = written(left.join(sure, key, "left_anti"), "left")
        count = left.count()
        if not count:
            return done
        degrees *= 4


def breakdown(points: DataFrame, segs: DataFrame, lines: DataFrame) -> DataFrame:
    """Events by nearest boundary pair, the most first; lines: line, pair, cls."""
    near = nearest_line(points, segs).join(lines.select("line", "pair", "cls"), "line")
    return near.groupBy("pair").agg(F.count("*").alias("n"), F.min_by("cls", "line").alias("cls")).orderBy(F.desc("n"), "pair")
