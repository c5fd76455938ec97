"""Tracks of hourly series: where each bucket's bar stands and how high, and the ticks of the time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as K

# Full heights and emphasis of the rows; a tick for so many pixels, a bucket for so many.
SPECS = {"kp": (9.0, None, 5.0), "wind_speed": (1000.0, None, 500.0), "xray_flux": (1e-3, 1e-9, 1e-5)}
TICK_PIXELS, BUCKET_PIXELS = 90, 3
STEPS = [("hour", n) for n in (1, 3, 6, 12)] + [("day", n) for n in (1, 2, 3, 7, 14)] + [("month", n) for n in (1, 3, 6)] + [("year", n) for n in (1, 2, 5, 10, 20, 50)]
MEAN_MS = {"hour": K.HOUR_MS, "day": K.DAY_MS, "month": 30.44 * K.DAY_MS, "year": K.YEAR_DAYS * K.DAY_MS}  # to choose a step, not to place a tick
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
EDGE = 0.04  # of the track, within which a label would overhang


def height(value: Column, scale_max: float, scale_min: float | None = None) -> Column:
    """A bar's height as a share of the row, against a fixed scale; logarithmic where the scale has a minimum; 0 for null."""
    if scale_min is None:
        return F.when(value.isNotNull(), F.least(value / scale_max, F.lit(1.0))).otherwise(0.0)
    t = (F.log10(value) - F.log10(F.lit(scale_min))) / (F.log10(F.lit(scale_max)) - F.log10(F.lit(scale_min)))
    return F.when(value > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def layout(buckets: DataFrame, measure: str, start_ms: int, end_ms: int, secondary: str | None = None) -> DataFrame:
    """Bars of a row from series.downsample(): position, heights, whether they rise above emphasis, and what was not measured.

    Buckets outside the window, ends included, go; a window without length has no bars. The second quantity marks and never sizes.
    """
    scale_max, scale_min, emphasis = SPECS[measure]
    inside = buckets.where(F.col("start_ms").between(start_ms, end_ms)) if end_ms > start_ms else buckets.limit(0)
    peak, typical, measured = (F.col(f"{measure}_{c}") for c in ("peak", "typical", "measured"))
    beyond = lambda x: F.coalesce(x >= emphasis, F.lit(False))
    return inside.select(
        "start_ms", ((F.col("start_ms") - start_ms) / max(1, end_ms - start_ms)).alias("x"), height(typical, scale_max, scale_min).alias("typical_height"), height(peak, scale_max, scale_min).alias("peak_height"),
        beyond(peak).alias("peak_stormy"), beyond(typical).alias("typical_stormy"), typical.alias("typical"), peak.alias("peak"), (F.col(f"{secondary}_peak") if secondary else F.lit(None).cast("double")).alias("secondary"),
        "hours", measured.alias("measured_hours"), (measured == 0).alias("unmeasured"),
    )


def ticks(windows: DataFrame, start: str = "start_ms", end: str = "end_ms", most: str = "max_ticks") -> DataFrame:
    """A row a tick of every window: its instant, place on the track, label and anchor, on boundaries of the calendar in UTC.

    The first step of the ladder with at most `most` of its mean lengths in the window is taken, else the coarsest; four times as many
    ticks, or eight, are the end of it. Days and hours are placed by sums, months and years by the calendar.
    """
    span = F.col(end) - F.col(start)
    ladder = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(n).alias("every"), F.lit(float(n * MEAN_MS[u])).alias("ms")) for u, n in STEPS))
    fits = F.filter(ladder, lambda s: span / s["ms"] <= F.col(most))
    w = windows.where((span > 0) & (F.col(most) >= 1)).withColumn("_s", F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at(ladder, -1)))
    unit, every, at = F.col("_s.unit"), F.col("_s.every"), F.timestamp_millis(start)
    day = F.unix_millis(F.date_trunc("day", at))
    hour = day + F.floor(F.hour(at) / every) * every * K.HOUR_MS
    month = F.make_date(F.year(at), (F.floor((F.month(at) - 1) / every) * every + 1).cast("int"), F.lit(1))
    year = F.make_date((F.floor(F.year(at) / every) * every).cast("int"), F.lit(1), F.lit(1))
    ms = lambda date: F.unix_millis(date.cast("timestamp"))
    months = F.when(unit == "month", every).otherwise(12 * every)
    calendar = unit.isin("month", "year")
    step = F.when(unit == "hour", every.cast("long") * K.HOUR_MS).otherwise(every.cast("long") * K.DAY_MS)
    w = w.withColumns({"_date": F.when(unit == "month", month).otherwise(year), "_fixed": F.when(unit == "hour", F.when(hour >= F.col(start), hour).otherwise(hour + every * K.HOUR_MS)).otherwise(F.when(day >= F.col(start), day).otherwise(day + K.DAY_MS)), "_step": step, "_months": months})
    w = w.withColumn("_skip", F.when(ms(F.col("_date")) >= F.col(start), 0).otherwise(1))
    limit = F.greatest(4 * F.col(most), F.lit(8)).cast("int")
    placed = F.transform(F.sequence(F.lit(0), limit - 1), lambda k: F.when(calendar, ms(F.add_months("_date", ((k + F.col("_skip")) * F.col("_months")).cast("int")))).otherwise(F.col("_fixed") + k * F.col("_step")))
    each = w.withColumn("tick_ms", F.explode(F.filter(placed, lambda t: t <= F.col(end)))).withColumn("x", (F.col("tick_ms") - F.col(start)) / (F.col(end) - F.col(start)))
    t = F.timestamp_millis("tick_ms")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(t))
    date = F.concat_ws(" ", F.dayofmonth(t).cast("string"), name)
    label = F.when(unit == "year", F.year(t).cast("string")).when(unit == "month", F.concat_ws(" ", name, F.year(t).cast("string"))).when((unit == "day") | (F.hour(t) == 0), date).otherwise(F.concat(F.lpad(F.hour(t).cast("string"), 2, "0"), F.lit(":00")))
    anchor = F.when(F.col("x") < EDGE, "start").when(F.col("x") > 1 - EDGE, "end").otherwise("middle")
    return each.select(*windows.columns, "tick_ms", "x", label.alias("label"), anchor.alias("anchor"))


def ticks_for_width(pixels: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(pixels / TICK_PIXELS)).cast("int")


def buckets_for_width(pixels: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(pixels / BUCKET_PIXELS)).cast("int")
