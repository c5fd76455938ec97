from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import tracks as T


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


def walk(start, end, most):
    """Ticks one by one, in calendar terms."""
    unit, every = next(((u, n) for u, n in T.STEPS if (end - start) / (n * T.MEAN_MS[u]) <= most), T.STEPS[-1])
    at = datetime.fromtimestamp(start / 1000, timezone.utc)
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    months = lambda d, n: d.replace(year=d.year + (d.month - 1 + n) // 12, month=(d.month - 1 + n) % 12 + 1)
    if unit == "hour":
        first, step = day + timedelta(hours=at.hour // every * every), lambda d: d + timedelta(hours=every)
        first = first if first >= at else step(first)
    elif unit == "day":
        first, step = (day if day >= at else day + timedelta(days=1)), lambda d: d + timedelta(days=every)
    else:
        n = every if unit == "month" else 12 * every
        first = day.replace(day=1, month=(at.month - 1) // every * every + 1) if unit == "month" else day.replace(day=1, month=1, year=at.year // every * every)
        step = lambda d: months(d, n)
        first = first if first >= at else step(first)
    out = []
    while first.timestamp() * 1000 <= end and len(out) < max(4 * most, 8):
        day_name = f"{first.day} {T.MONTHS[first.month - 1]}"
        label = {"year": str(first.year), "month": f"{T.MONTHS[first.month - 1]} {first.year}", "day": day_name, "hour": day_name if first.hour == 0 else f"{first.hour:02d}:00"}[unit]
        x = (first.timestamp() * 1000 - start) / (end - start)
        out.append((int(first.timestamp() * 1000), label, "start" if x < 0.04 else "end" if x > 0.96 else "middle"))
        first = step(first)
    return out


def test_ticks(spark):
    spans = [K.HOUR_MS // 2, 5 * K.HOUR_MS, K.DAY_MS, 3 * K.DAY_MS, 7 * K.DAY_MS, 30 * K.DAY_MS, 200 * K.DAY_MS, 800 * K.DAY_MS, 9000 * K.DAY_MS, 40_000 * K.DAY_MS]
    rows = [(i, s, s + span, most) for i, (s, span, most) in enumerate((s, span, m) for s in (ms(2024, 2, 29, 13, 30), ms(1999, 12, 31), ms(2023, 1, 1)) for span in spans for m in (1, 3, 10))]
    rows += [(900, 5, 5, 3), (901, 9, 5, 3), (902, 0, K.DAY_MS, 0)]
    got = {}
    for r in T.ticks(spark.createDataFrame(rows, "id int, start_ms long, end_ms long, max_ticks int")).orderBy("id", "tick_ms").collect():
        got.setdefault(r.id, []).append((r.tick_ms, r.label, r.anchor))
    assert not {900, 901, 902} & set(got)
    for i, s, e, m in rows[:-3]:
        assert got.get(i, []) == walk(s, e, m), (i, s, e, m)


def test_heights_and_layout(spark):
    df = spark.createDataFrame([(0.0,), (4.5,), (20.0,), (None,), (-1.0,), (1e-9,), (1e-6,)], "v double")
    got = df.select(T.height(F.col("v"), 9.0).alias("a"), T.height(F.col("v"), 1e-3, 1e-9).alias("b")).collect()
    assert [r.a for r in got][:5] == [0.0, 0.5, 1.0, 0.0, -1 / 9] and [r.b for r in got][2:6] == [1.0, 0.0, 0.0, 0.0] and abs(got[6].b - 0.5) < 1e-12 and got[0].b == 0
    b = spark.createDataFrame([(0, 3, 6.0, 4.0, 2, -50.0), (50, 3, None, None, 0, None), (100, 3, 5.0, 5.0, 3, 1.0), (101, 3, 9.0, 9.0, 3, 1.0)], "start_ms long, hours long, kp_peak double, kp_typical double, kp_measured long, dst_peak double")
    bars = T.layout(b, "kp", 0, 100, "dst").orderBy("start_ms").collect()
    assert [(r.x, r.peak_stormy, r.typical_stormy, r.unmeasured, r.secondary) for r in bars] == [(0.0, True, False, False, -50.0), (0.5, False, False, True, None), (1.0, True, True, False, 1.0)]
    assert T.layout(b, "kp", 100, 100).collect() == [] and T.layout(b, "kp", 0, 100).first().secondary is None
    w = spark.createDataFrame([(10,), (320,), (1000,)], "p int").select(T.ticks_for_width(F.col("p")).alias("t"), T.buckets_for_width(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in w] == [(2, 3), (3, 106), (11, 333)]
