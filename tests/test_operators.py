import math
import random

import pytest
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo
from tremor.operators import decluster, match, stats
from tremor.operators.rangejoin import counts_before
from tremor.operators.upsert import merge_latest
from tremor.plans.hypotheses import Parameters, validate_catalog


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_decluster_equals_the_greedy_sweep(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(400) * K.DAY_MS // 4, 5 + rng.randrange(40) / 10, rng.choice([-89.5, 88.0, 10.0, 40.0]) + rng.random(), rng.choice([-179.9, 179.5, 20.0]) + rng.random() * 0.4) for i in range(500)]
    order = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    state = {}
    for i, t, m, la, lo in order:
        if state.get(i) == "dependent":
            continue
        state[i] = "independent"
        radius = 10 ** (0.1238 * m + 0.983)
        window = 10 ** (0.032 * m + 2.7389) if m >= 6.5 else 10 ** (0.5409 * m - 0.547)
        for j, t2, _, la2, lo2 in rows:
            if j not in state and 0 < t2 - t <= window * K.DAY_MS and haversine(la, lo, la2, lo2) <= radius:
                state[j] = "dependent"
    df = spark.createDataFrame(rows, "event_id long, time_ms long, magnitude double, latitude double, longitude double")
    got = {r.event_id for r in decluster.independent_ids(df).collect()}
    assert got == {i for i, s in state.items() if s == "independent"}


def test_the_jvm_compiles_the_code_of_pairs(spark):
    events = spark.range(100).selectExpr("id as event_id", "id * 3600000L as time_ms", "5.0D + id % 20 / 10 as magnitude", "id % 3 / 10.0D as latitude", "id % 5 / 10.0D as longitude")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = decluster.edges(events)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # HotSpot interprets methods beyond that


def test_published_table(spark):
    r = spark.range(1).select(*(decluster.gk_window_days(F.lit(m)).alias(f"m{k}") for k, m in enumerate((6.5, 7.0, 8.0))), decluster.gk_radius_km(F.lit(6.0)).alias("r")).first()
    assert abs(r.m0 - 884.9) < 1 and abs(r.m1 - 918) < 1 and abs(r.m2 - 988) < 1 and abs(r.r - 53.2) < 0.1


def test_counts_before(spark):
    rng = random.Random(2)
    points = [rng.randrange(2000) for _ in range(300)]
    qs = [rng.randrange(-100, 2200) for _ in range(80)]
    p, q = spark.createDataFrame([(x,) for x in points], "p long"), spark.createDataFrame([(x,) for x in qs], "t long")
    for inclusive in (True, False):
        got = sorted(tuple(r) for r in counts_before(q, p, "t", "p", "n", inclusive, width=50).collect())
        assert got == sorted((x, sum(y <= x if inclusive else y < x for y in points)) for x in qs)
    assert all(r.n == 0 for r in counts_before(q, p.limit(0), "t", "p", "n", True).collect())


def test_bounds_of_circles_and_wrapping(spark):
    near = lambda lat, lon, a, b, km: geo.around(F.lit(lat), F.lit(lon), a, b, km)
    r = spark.range(1).select(
        near(0.0, -179.9, 0.0, 179.9, 100.0).alias("over"), near(0.0, 0.0, 0.0, 179.9, 100.0).alias("far"), near(89.9, 10.0, 89.8, -170.0, 100.0).alias("pole"), near(2.0, 0.0, 0.0, 0.0, 100.0).alias("north"),
        geo.wrap_half_open(180.0).alias("a"), geo.wrap_upper(-180.0).alias("b"), geo.haversine_km(0.0, 179.9, 0.0, -179.9).alias("d"),
    ).first()
    assert (r.over, r.far, r.pole, r.north, r.a, r.b) == (True, False, True, False, -180.0, 180.0) and abs(r.d - 22.24) < 0.01


def test_circles_lose_nothing(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    for lat, lon, km in ((0.0, 179.5, 500.0), (88.0, 30.0, 700.0), (-60.0, -179.0, 1500.0), (45.0, 10.0, 3000.0)):
        got = {r.event_id for r in df.where(geo.in_circle("latitude", "longitude", lat, lon, km)).collect()}
        assert {i for i, a, b in rows if haversine(lat, lon, a, b) <= km * 0.998} <= got <= {i for i, a, b in rows if haversine(lat, lon, a, b) <= km * 1.000001}


def test_nearest_line_both_ways(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(60)], "event_id long, latitude double, longitude double")
    lines = spark.createDataFrame([(i, [rng.uniform(-180, 180), rng.uniform(-60, 60), rng.uniform(-180, 180), rng.uniform(-60, 60)]) for i in range(20)] + [(20, [5.0, 5.0]), (21, [])], "line int, p array<double>")
    segs = match.segments(lines)
    assert segs.count() == 21
    a, b = ({r.event_id: round(r.distance_km, 6) for r in match.nearest_line(pts, segs, first_degrees=m).collect()} for m in (180.0, 2.0))
    assert a == b and len(a) == 60


def test_points_that_meet_segments_in_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(match, "POINTS_A_TASK", 50)
    pts = spark.range(1000).selectExpr("id as event_id", "(id * 7) % 160 - 80.0D as latitude", "(id * 11) % 360 - 180.0D as longitude")
    segs = match.segments(spark.createDataFrame([(0, [0.0, 0.0, 10.0, 10.0]), (1, [100.0, -20.0, 120.0, -30.0])], "line int, p array<double>"))
    near = match.nearest_line(pts, segs, first_degrees=180.0).withColumn("task", F.spark_partition_id())
    held = [r["count"] for r in near.groupBy("task").count().collect()]
    assert sum(held) == 1000 and max(held) <= 100


def test_merge_keeps_source(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, source string, m double")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 4.0)], "id long, source string, m double")
    assert sorted(tuple(r) for r in merge_latest(old, new, "id", keep_old=("source",)).collect()) == [(1, "a", 1.0), (2, "b", None), (3, "d", 4.0)]


def test_benjamini_hochberg(spark):
    ps = [0.039, 0.7, 0.001, 0.09, 0.205, 0.008, 0.5, 0.041]
    df = spark.createDataFrame(list(enumerate(ps)), "test_id long, p double")
    assert {r.p for r in stats.benjamini_hochberg(df, 0.05).collect() if r.rejected} == {0.001, 0.008}
    with pytest.raises(ValueError):
        stats.benjamini_hochberg(df, 0.05, family=3)


def test_null_needs_hours_and_p_is_never_zero(spark):
    table = spark.createDataFrame([(i, 1.0, i % 3) for i in range(50)], "idx long, expected double, observed long")
    null = stats.null_by_numpy(table, 10, 40, 7)
    assert null.count() == 40
    assert stats.p_value(null, 99.0, 40).first().p == 1 / 41
    with pytest.raises(ValueError):
        stats.null_by_numpy(table, 51, 5, 7)
    with pytest.raises(NotImplementedError):
        stats.circular_shift()


def test_parameters_and_validation(spark):
    assert Parameters.of(hypothesis="H5", start_ms=0, end_ms=1).lags == ((0, 72),)
    with pytest.raises(ValueError):
        Parameters.of(hypothesis="H5", start_ms=0, end_ms=1, other=1)
    with pytest.raises(ValueError):
        Parameters.of(hypothesis="H9", start_ms=0, end_ms=1)
    bad = spark.createDataFrame([(0, 91.0, 0.0, 5.0), (0, 0.0, 200.0, None)], "time_ms long, latitude double, longitude double, magnitude double")
    assert tuple(validate_catalog(bad).first()) == (1, 1, 1, 0)


def test_distance_of_nothing_is_nothing(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(None).cast("double"), 0.0, 0.0, 0.0).alias("a"), geo.haversine_km(0.0, 0.0, 0.0, 180.0).alias("b")).first()
    assert r.a is None and abs(r.b - math.pi * 6371) < 1e-6
