"""Polylines as rows of vertices: segments, denser chords, runs by distance, merged steps and marks along a line.

No line is held in one row or task: neighbours and running lengths come from slots of the order (operators/ordered.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo
from tremor.operators.ordered import neighbour, running_sum, slotted
from tremor.operators.tables import written

MAX_CHORD_KM = 50.0
TIER_LONG_KM, TIER_MEDIUM_KM = 100.0, 30.0
RUN_BREAK_KM = TOOTH_SPACING_KM = 150.0
JOIN_DEGREES = 1e-6
# The motion across each class of boundary.
MOTION = {"SUB": "convergent", "OCB": "convergent", "CCB": "convergent", "OSR": "divergent", "CRB": "divergent", "OTF": "transform", "CTF": "transform"}


def segments(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """vertices (line, order, latitude, longitude, ...) with `next`, the following vertex of the line, and `km` to it; null at ends."""
    slots = slotted(vertices, order)
    met = neighbour(slots, [line], [order], ["latitude", "longitude"], "next", after=True).drop("_slot")
    return met.withColumn("km", F.when(F.col("next").isNotNull(), geo.haversine_km("latitude", "longitude", "next.latitude", "next.longitude")))


def on_arc(df: DataFrame, start: str, end: str, km: Column, share: Column) -> DataFrame:
    """df with `_lat` and `_lon`, the point at a share of the great circle from start to end (structs), which is km long.

    Each quantity is a column, worked out once a row.
    """
    w = df.withColumns({"_w": km / K.EARTH_RADIUS_KM, "_s": share})
    near = F.col("_w") < 1e-12
    part = lambda f: F.when(near, f).otherwise(F.sin(f * F.col("_w")) / F.sin(F.when(~near, F.col("_w"))))
    w = w.withColumns({"_p": part(1 - F.col("_s")), "_q": part(F.col("_s"))})
    w = w.withColumns({f"_{n}{c}": F.radians(f"{x}.{c}itude" if c == "lat" else f"{x}.{c}gitude") for n, x in (("a", start), ("b", end)) for c in ("lat", "lon")})
    w = w.withColumns(
        {
            "_x": F.col("_p") * F.cos("_alat") * F.cos("_alon") + F.col("_q") * F.cos("_blat") * F.cos("_blon"),
            "_y": F.col("_p") * F.cos("_alat") * F.sin("_alon") + F.col("_q") * F.cos("_blat") * F.sin("_blon"),
            "_z": F.col("_p") * F.sin("_alat") + F.col("_q") * F.sin("_blat"),
        }
    )
    w = w.withColumns({"_lat": F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))), "_lon": F.degrees(F.atan2("_y", "_x"))})
    return w.drop("_w", "_s", "_p", "_q", "_alat", "_alon", "_blat", "_blon", "_x", "_y", "_z")


def densify(parts: DataFrame, max_km: float = MAX_CHORD_KM) -> DataFrame:
    """From segments(): every vertex, and between two that are more than max_km apart so many points of the great circle, evenly
    placed, that no chord is longer. `step` numbers the points of a segment, 0 for the vertex itself.

    The number of points is a segment's own, so lines of any length are made in parallel.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.coalesce("km", F.lit(0.0)) / max_km)).cast("int")
    each = parts.withColumn("_pieces", pieces).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    each = on_arc(each.withColumn("_here", F.struct("latitude", "longitude")), "_here", "next", F.col("km"), F.col("step") / F.col("_pieces"))
    own = F.col("step") == 0
    point = {c: F.when(own, F.col(c)).otherwise(F.col(f"_{c[:3]}")) for c in ("latitude", "longitude")}
    kept = [c for c in parts.columns if c not in ("latitude", "longitude", "next", "km")]
    return each.select(*kept, "step", *(v.alias(c) for c, v in point.items()), (F.col("km") / F.col("_pieces")).alias("chord_km"))


def zoom_tier(km: Column) -> Column:
    """0 for long lines, 1 for medium and 2 for short ones."""
    return F.when(km >= TIER_LONG_KM, 0).when(km >= TIER_MEDIUM_KM, 1).otherwise(2)


def measurement(text: Column) -> Column:
    """`(preferred,min,max)` as a struct, null where the preferred value is no finite number; bounds may be missing."""
    inner = F.regexp_extract(F.trim(text), r"^\(([^,]*),([^,]*),([^,]*)\)$", 0)
    pieces = F.split(F.substring(inner, F.lit(2), F.length(inner) - 2), ",")
    number = lambda k: F.trim(F.get(pieces, F.lit(k))).try_cast("double")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    whole = F.struct(*(finite(number(k)).alias(c) for k, c in enumerate(("preferred", "min", "max"))))
    return F.when(whole["preferred"].isNotNull(), whole)


def line_runs(points: DataFrame, order: str, same: list[str], breaks: Column, carry: list[str]) -> DataFrame:
    """points in one order for the whole table, numbered by `run`: a new one `starts` where a column of `same` changes or `breaks` holds.

    `breaks` sees the row before as `before`, a struct of the columns `same` and `carry`.
    """
    slots = slotted(points, order)
    met = neighbour(slots, [], [order], [*same, *carry], "before")
    starts = F.col("before").isNull() | breaks
    for c in same:
        starts = starts | ~F.col(f"before.{c}").eqNullSafe(F.col(c))
    met = written(met.withColumn("starts", F.coalesce(starts, F.lit(True))), "starts")
    return running_sum(met, [], [order], F.col("starts").cast("long"), "run").drop("_slot")


def runs_by_distance(points: DataFrame, order: str, same: list[str], max_km: float = RUN_BREAK_KM) -> DataFrame:
    """Runs of points of equal `same` of which each is within max_km of the one before, with `km` from it (0 where a run starts).

    A point without a place starts a run, as does the one after it.
    """
    far = geo.haversine_km("before.latitude", "before.longitude", "latitude", "longitude")
    runs = line_runs(points, order, same, far > max_km, ["latitude", "longitude"])
    return runs.withColumn("km", F.when(F.col("starts"), F.lit(0.0)).otherwise(far)).drop("before", "starts")


def merge_steps(steps: DataFrame, order: str, same: list[str], step_class: str, tolerance: float = JOIN_DEGREES) -> DataFrame:
    """Steps (start_latitude, ..., end_longitude) that follow each other with equal `same` and joined ends become one chain.

    Returns the chains' vertices: (chain, number, motion, latitude, longitude and the columns of `same`), the first start and
    every end; `number` counts from 0. A class without a motion is an error, not a chain that is left out.
    """
    apart = (F.abs(F.col("before.end_latitude") - F.col("start_latitude")) >= tolerance) | (F.abs(F.col("before.end_longitude") - F.col("start_longitude")) >= tolerance)
    runs = line_runs(steps, order, same, apart, ["end_latitude", "end_longitude"]).drop("before", "starts")
    known = F.create_map(*(F.lit(x) for kv in MOTION.items() for x in kv))
    motion = F.coalesce(known[F.col(step_class)], F.raise_error(F.concat(F.lit("class without a motion: "), F.coalesce(F.col(step_class), F.lit("null")))).cast("string"))
    slots = slotted(runs.withColumn("motion", motion), order)
    counted = running_sum(slots, ["run"], [order], F.lit(1).cast("long"), "number").drop("_slot")
    kept = [F.col("run").alias("chain"), "motion", *same]
    end = counted.select(*kept, "number", F.col("end_latitude").alias("latitude"), F.col("end_longitude").alias("longitude"))
    start = counted.where("number = 1").select(*kept, F.lit(0).cast("long").alias("number"), F.col("start_latitude").alias("latitude"), F.col("start_longitude").alias("longitude"))
    return start.unionByName(end)


def along(points: DataFrame, run: str, order: str, km: str = "km") -> DataFrame:
    """points with `along_km`, the length of their run up to them."""
    slots = slotted(points, order)
    return running_sum(slots, [run], [order], F.col(km), "along_km").drop("_slot")


def reached(points: DataFrame, run: str, order: str, spacing_km: float) -> DataFrame:
    """(run, order, next): for every point the first one of its run that lies at least spacing_km further along; null at the end.

    A point asks in the slot of length in which it would be met; where that slot has none so far along, the first point of
    the next slot that has any answers.
    """
    slot = lambda x: F.floor(x / spacing_km).cast("long")
    own = points.select(run, F.col(order).alias("_o"), F.col("along_km").alias("_x"), F.lit(1).alias("_is"))
    asks = points.select(run, F.col(order).alias("_o"), (F.col("along_km") + spacing_km).alias("_x"), F.lit(0).alias("_is"))
    both = own.unionByName(asks).withColumn("_slot", slot(F.col("_x")))
    later = Window.partitionBy(run, "_slot").orderBy("_x", "_is", "_o").rowsBetween(1, Window.unboundedFollowing)
    inside = both.withColumn("_next", F.first(F.when(F.col("_is") == 1, F.col("_o")), ignorenulls=True).over(later)).where("_is = 0")
    firsts = own.withColumn("_slot", slot(F.col("_x"))).groupBy(run, "_slot").agg(F.min(F.struct("_x", "_o")).alias("_f"))
    marks = firsts.select(run, "_slot", F.col("_f._o").alias("_f")).unionByName(both.where("_is = 0").select(run, "_slot", F.lit(None).cast(firsts.schema["_f"].dataType["_o"].dataType).alias("_f")).distinct())
    marks = marks.groupBy(run, "_slot").agg(F.max("_f").alias("_f"))
    onward = marks.select(run, "_slot", F.first("_f", ignorenulls=True).over(Window.partitionBy(run).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing)).alias("_onward"))
    return inside.join(onward, [run, "_slot"]).select(run, F.col("_o").alias(order), F.coalesce("_next", "_onward").alias("next"))


def teeth(points: DataFrame, run: str, order: str, azimuth: str, spacing_km: float = TOOTH_SPACING_KM) -> DataFrame:
    """The points that carry a tooth, with the direction of dip: on each run the first at least half a spacing along, and from
    each tooth the first that is at least a spacing further.

    Which points these are is found by doubling: round k knows the first 2^k teeth of every run and the point 2^k teeth on from
    any point, so rounds grow with the logarithm of the longest run, and no run is walked.
    """
    placed = written(along(points, run, order), "along")
    longest = placed.agg(F.max("along_km")).first()[0] or 0.0
    first = placed.where(F.col("along_km") >= spacing_km / 2).groupBy(run).agg(F.min_by(order, F.struct("along_km", order)).alias(order))
    jump = written(reached(placed, run, order, spacing_km).where("next is not null"), "jumps")
    found, most, known = written(first, "teeth"), int(longest / spacing_km) + 2, 1
    while known < most:
        ahead = found.join(jump, [run, order]).select(run, F.col("next").alias(order))
        found = written(found.unionByName(ahead), "teeth")
        known *= 2
        if known < most:
            on = jump.select(run, F.col(order).alias("next"), F.col("next").alias("_on"))
            jump = written(jump.join(on, [run, "next"]).select(run, order, F.col("_on").alias("next")), "jumps")
    dip = F.pmod(F.col(azimuth) + 90, F.lit(360.0))
    return placed.join(found, [run, order]).withColumn("dip", dip)


def marks(points: DataFrame, run: str, order: str, spacing_km: float = TOOTH_SPACING_KM) -> DataFrame:
    """(run, mark, latitude, longitude): marks at exactly equal spacing along each run, half a spacing in, between its points.

    The length up to each point gives the marks of the step that ends there as a sequence of multiples.
    """
    placed = along(points, run, order)
    slots = slotted(placed, order)
    met = neighbour(slots, [run], [order], ["latitude", "longitude", "along_km"], "from").where("from is not null")
    low = F.floor(F.col("from.along_km") / spacing_km + 0.5).cast("long")
    high = F.floor(F.col("along_km") / spacing_km + 0.5).cast("long") - 1
    each = met.where(high >= low).withColumn("mark", F.explode(F.sequence(low, high)))
    long = F.col("along_km") - F.col("from.along_km")
    share = ((F.col("mark") + 0.5) * spacing_km - F.col("from.along_km")) / long
    made = on_arc(each.withColumn("_to", F.struct("latitude", "longitude")), "from", "_to", long, share)
    return made.select(run, "mark", F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"))
