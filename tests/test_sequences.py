"""Gaps, ranks, antipodal progress, outlines, migrations and fractions, by hand."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import space
from tremor.operators import sequences as Q
from tremor.operators import series as S
from tremor.operators import upsert as U
from tremor.plans import displays


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_gaps(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.randrange(10 * n)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id int, k string, time_ms long").repartition(4)
    for keys in ([], ["k"]):
        got = {r.event_id: r.gap for r in Q.gaps(df, 1.0, keys).collect()}
        last, want = {}, {}
        for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
            k = k if keys else ""
            want[i] = float(t - last[k]) if k in last else None
            last[k] = t
        assert got == want


def test_kth_value(spark):
    rng = random.Random(3)
    for values in ([5.0], [1.0] * 50 + [2.0], [rng.lognormvariate(0, 4) for _ in range(3000)], [float(rng.randrange(7)) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        for k in {1, len(values) // 2 + 1, len(values)}:
            assert Q.kth(df, "v", k, bins=16) == sorted(values)[k - 1]
        assert Q.kth(df, "v", 0) is None and Q.kth(df, "v", len(values) + 1) is None


def test_a_region_is_not_ordered_in_one_task(spark):
    df = spark.range(10_000).selectExpr("id as event_id", "id * 977 % 100000 as time_ms")
    plan = Q.gaps(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "event_id" in line]
    assert windows and all("_slot" in line.split("],")[1] for line in windows)  # every window over events is within a slot


def test_antipodal_progress(spark):
    main = spark.createDataFrame([(1, 0), (2, 36 * K.HOUR_MS), (3, 100 * K.HOUR_MS)], "event_id int, time_ms long")
    members = spark.createDataFrame([(1, 7, 500.0), (1, 8, 300.0), (1, 9, 300.0)], "main_id int, event_id int, distance_km double")
    got = {r.main_id: tuple(r)[1:] for r in Q.antipodal_summary(members, main, 72 * K.HOUR_MS).collect()}
    assert got == {1: (2 + 1, 8, 300.0, 1.0), 2: (0, None, None, 0.5), 3: (0, None, None, 0.0)}


def test_outline_of_the_magnetopause(spark):
    shape = space.magnetopause(F.lit(-5.0), F.lit(2.0))
    r = spark.range(1).select(shape.alias("m"), space.profile(shape).alias("p"), space.profile(shape, 200.0, 4).alias("wide"), space.boundary_radius(F.lit(10.0), F.lit(0.5), F.lit(math.pi)).alias("tail")).first()
    assert len(r.p) == 61 and r.p[0].theta == 0 and abs(r.p[0].radius_re - r.m.standoff_re) < 1e-12 and abs(r.p[-1].theta - math.radians(120)) < 1e-12
    for x in r.p:
        assert abs(x.radius_re - r.m.standoff_re * (2 / (1 + math.cos(x.theta))) ** r.m.flaring) < 1e-9
    assert len(r.wide) == 5 and abs(r.wide[-1].theta - math.radians(179)) < 1e-12 and r.tail == math.inf


def test_migrations(spark):
    df = spark.createDataFrame([(1,)], "a int")
    steps = [lambda d: d.withColumn("b", F.lit(1)), lambda d: d.withColumn("b", F.col("b") + 1), lambda d: d.withColumn("c", F.col("b") * 10)]
    first, done = U.migrate(df, steps[:1], 0)
    assert tuple(first.first()) == (1, 1) and done == 1
    second, done = U.migrate(first, steps, done)
    assert tuple(second.first()) == (1, 2, 20) and done == 3
    again, done = U.migrate(second, steps, done)
    assert again is second and done == 3


def test_measured_fraction(spark):
    df = spark.createDataFrame([("a", 3, 4), ("a", 1, 4), ("b", 0, 0), ("c", None, 5)], "k string, m int, h int")
    got = {r.k: r.f for r in df.groupBy("k").agg(S.measured_fraction(F.col("m"), F.col("h")).alias("f")).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 1.0}


def test_nearest_of_two_at_one_distance_is_the_smaller_id(spark):
    """0.7 degrees to either side of the antipode: differences of radians are not the same to the last place, those of degrees are."""
    main = spark.createDataFrame([(1, 0, 6.4, -59.8, 109.05)], "event_id long, time_ms long, magnitude double, latitude double, longitude double")
    events = spark.createDataFrame([(252893, 9, 6.3, 58.2, -71.65), (349652, 7, 5.4, 58.2, -70.25)], main.schema)
    found = Q.antipodal_summary(Q.antipodal(events, main), main, K.HOUR_MS).first()
    assert (found.n, found.nearest_id) == (2, 252893)


def test_antipodal_windows_are_not_sorted(spark):
    """What is found grows with the square of the density: a sort of it would shuffle it all."""
    rng = random.Random(4)
    events = spark.createDataFrame([(i, rng.randrange(72) * K.HOUR_MS, 6.0, rng.uniform(-1, 1), rng.choice([0.0, 179.0])) for i in range(60)], "event_id long, time_ms long, magnitude double, latitude double, longitude double")
    found = Q.antipodal(events, events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and found.count() > 100


def test_progress_is_as_the_summary_of_all_pairs(spark):
    """With ties, windows without events, and nearest events in every class of reach."""
    rng = random.Random(6)
    places = [(lat / 2, lon / 2) for lat in range(-6, 7) for lon in range(-6, 7)]
    rows = [(i, rng.randrange(40) * K.HOUR_MS, rng.choice([5.0, 6.0]), a, b) for i in range(400) for a, b in [rng.choice(places)]]
    mains = [(1000 + i, rng.randrange(40) * K.HOUR_MS, 6.5, a + rng.choice([0.0, 0.3, 3.0, 8.0]), b - 180 + 360 * (b <= 0)) for i in range(60) for a, b in [rng.choice(places)]]
    names = "event_id long, time_ms long, magnitude double, latitude double, longitude double"
    events, main = spark.createDataFrame(rows, names), spark.createDataFrame([*mains, (2000, 0, 6.5, -70.0, 20.0)], names)
    want = {tuple(r) for r in Q.antipodal_summary(Q.antipodal(events, main), main, 50 * K.HOUR_MS).collect()}
    got = {tuple(r) for r in Q.antipodal_progress(events, main, 50 * K.HOUR_MS).collect()}
    assert got == want and len(want) == 61 and (2000, 0, None, None) in {r[:4] for r in want}
    nearest = [r[3] for r in want if r[3] is not None]
    assert all(any(low < x <= high for x in nearest) for low, high in ((-1, 1000 / 16), (1000 / 16, 250), (250, 1000)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_progress_sorts_no_pairs(spark, monkeypatch):
    """Pairs of main events and events grow with the square of the density; only hash aggregates may stand on them."""
    plans, write = [], Q.written
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Q, "written", lambda df, label: (note(df), write(df, label))[1])
    note(displays.antipodal_progress(spark, "/root/testdata/sf0.001"))
    assert "HashAggregate" in "".join(plans) and not any("SortAggregate" in p for p in plans)
