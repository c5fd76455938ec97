"""Columns of what a display shows of an event, a flare, a rate or a span: sizes, classes, labels, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor import constants as K

# Hours and least magnitude of the live windows, years and least magnitude of the archive's, magnitude floors.
WINDOWS = [(24, 1.0), (48, 1.0), (72, 1.0), (168, 1.0), (720, 2.5)]
SPANS = [(1, 4.5), (10, 5.5), (130, 5.5)]
FLOORS = [1.0, 2.5, 4.5, 5.5, 6.0, 7.0]
RECENT_HOURS, AURORA_STALE_MINUTES, TEC_STALE_MINUTES = 24, 20, 90
SEQUENCE_MAGNITUDE, ANTIPODAL_MAGNITUDE = 5.0, 6.0
PIXELS = {"magnitude": (1.0, 8.0, 5.0, 22.0), "dot": (0.0, 9.5, 3.0, 9.0), "kp": (0.0, 9.0, 8.0, 16.0)}
RING_GAP_PIXELS = 4
FLARE_PIXELS, FLARE_CAP, FLARE_PER_UNIT = {"M": 8.0, "X": 14.0}, 10.0, 0.4
MONTH_DAYS = 30.44


def windows() -> list[tuple[int, float]]:
    """All offered windows in hours with the least magnitude held, shortest first."""
    return sorted(WINDOWS + [(round(y * K.YEAR_DAYS * 24), m) for y, m in SPANS])


def least_magnitude(hours: Column) -> Column:
    """What a window holds; of one that is not offered, the strictest."""
    out = F.lit(max(m for _, m in windows()))
    for h, m in windows():
        out = F.when(hours == h, F.lit(m)).otherwise(out)
    return out


def previous_window(hours: Column) -> Column:
    """The next shorter window, or null: the length of a trail."""
    return F.array_max(F.filter(F.array(*[F.lit(h) for h, _ in windows()]), lambda x: x < hours))


def next_floor(magnitude: Column) -> Column:
    return F.array_min(F.filter(F.array(*[F.lit(m) for m in FLOORS]), lambda x: x > magnitude))


def display_window(hours: Column, playhead_ms: Column, trailing: Column, now_ms: Column, margin_ms: int = 0) -> tuple[Column, Column]:
    """Start and end of what is shown. A trail follows the playhead; without one the start is a window before now."""
    at = F.coalesce(playhead_ms, now_ms)
    trail = F.when(trailing, previous_window(hours)).cast("long")
    return F.when(trail.isNull(), now_ms - hours.cast("long") * K.HOUR_MS).otherwise(at - trail * K.HOUR_MS), at + F.when(playhead_ms.isNull(), margin_ms).otherwise(0)


def is_recent(time_ms: Column, now_ms: int) -> Column:
    """At most a day old; what is dated ahead counts, what has no time does not."""
    return F.coalesce(now_ms - time_ms <= RECENT_HOURS * K.HOUR_MS, F.lit(False))


def is_emphasized(magnitude: Column) -> Column:
    return F.coalesce(~F.isnan(magnitude) & (F.abs(magnitude) < float("inf")) & (magnitude >= K.EMPHASIS_MAGNITUDE), F.lit(False))


def is_stale(observed_ms: Column, now_ms: int, minutes: int) -> Column:
    """Older than so many minutes, or of no known time."""
    return F.coalesce(now_ms - observed_ms > minutes * 60_000, F.lit(True))


def complete_since(magnitude: Column) -> Column:
    return F.when(magnitude >= K.DEEP_FLOOR, K.DEEP_EPOCH_YEAR).otherwise(K.ARCHIVE_EPOCH_YEAR)


def pixels(value: Column, kind: str) -> Column:
    """Linear between two sizes, held at the ends; without a value the least."""
    low, high, small, large = PIXELS[kind]
    held = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value, F.lit(low))))
    return small + (held - low) / (high - low) * (large - small)


def flare_pixels(cls: Column, magnitude: Column) -> Column:
    held = F.least(F.lit(FLARE_CAP), F.greatest(F.lit(0.0), magnitude))
    return F.when(cls == "X", FLARE_PIXELS["X"]).otherwise(FLARE_PIXELS["M"]) + held * FLARE_PER_UNIT


def depth_class(km: Column) -> Column:
    return F.when(km < 70, "shallow").when(km < 300, "intermediate").when(km.isNotNull(), "deep")


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, halves up."""
    n = F.floor(F.abs(x) * 10**digits + 0.5).cast("long")
    whole = F.expr(f"0L + {10**digits}")
    text = F.concat(F.floor(n / whole).cast("string"), *([F.lit("."), F.lpad((n % whole).cast("string"), digits, "0")] if digits else []))
    return F.when((x < 0) & (n > 0), F.concat(F.lit("-"), text)).otherwise(text)


def flux_label(flux: Column) -> Column:
    """The class of an X-ray flux, as in C3.4; below A1 with a mark, and a dash for what is no flux."""
    out = F.concat(F.lit("<A"), fixed(flux / 1e-8, 1))
    for letter, low in reversed(list(zip("XMCBA", (1e-4, 1e-5, 1e-6, 1e-7, 1e-8)))):
        out = F.when(flux >= low, F.concat(F.lit(letter), fixed(flux / low, 1))).otherwise(out)
    return F.when(flux.isNull() | F.isnan(flux) | (flux <= 0) | (flux == float("inf")), "—").otherwise(out)


def elapsed_label(hours: Column) -> Column:
    days = hours / 24
    return (
        F.when(hours.isNull() | F.isnan(hours) | (hours < 0) | (hours == float("inf")), "unknown")
        .when(hours < 1, F.concat(fixed(hours * 60, 0), F.lit(" min")))
        .when(hours < 48, F.concat(fixed(hours, 0), F.lit(" h")))
        .when(days < 60, F.concat(fixed(days, 0), F.lit(" d")))
        .when(days / MONTH_DAYS < 24, F.concat(fixed(days / MONTH_DAYS, 0), F.lit(" mo")))
        .otherwise(F.concat(fixed(days / K.YEAR_DAYS, 1), F.lit(" y")))
    )


def rate_label(per_day: Column) -> Column:
    return (
        F.when(per_day.isNull(), "not yet elapsed")
        .when(per_day == 0, "0/day")
        .when(per_day >= 10, F.concat(fixed(per_day, 0), F.lit("/day")))
        .when(per_day >= 1, F.concat(fixed(per_day, 1), F.lit("/day")))
        .when(per_day >= 0.1, F.concat(fixed(per_day, 2), F.lit("/day")))
        .otherwise(F.concat(fixed(per_day * MONTH_DAYS, 1), F.lit("/mo")))
    )


def p_label(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p) | (p < 0.0001), "p < 0.0001").otherwise(F.concat(F.lit("p = "), fixed(p, 4)))


def dip_azimuth(strike: Column) -> Column:
    """Where a slab goes down: a right angle clockwise of the trench."""
    return F.pmod(strike + 90, F.lit(360.0))


def unit_vector(azimuth: Column) -> tuple[Column, Column]:
    """East and north parts of a compass direction."""
    a = F.radians(F.pmod(azimuth, F.lit(360.0)))
    return F.sin(a), F.cos(a)


def bar_height(value: Column, most: Column) -> Column:
    """Percent of the highest bar of a group; what is there but small shows as 4, what is unknown not at all."""
    return F.when(value.isNull(), None).when((value == 0) | (most == 0), 0.0).otherwise(F.greatest(F.lit(4.0), value / most * 100))
