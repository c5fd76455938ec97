import math
import random

import pytest

from tremor.operators import ordered, polylines as P
from pyspark.sql import functions as F


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def walk(rng, n, step=1.0):
    lat, lon, out = rng.uniform(-60, 60), rng.uniform(-180, 180), []
    for _ in range(n):
        out.append((lat, lon))
        lat, lon = max(-85, min(85, lat + rng.uniform(-step, step))), (lon + rng.uniform(-step, step) + 180) % 360 - 180
    return out


@pytest.mark.parametrize("width", [1.0, 3.0, 50.0, 1e9])
def test_neighbours_and_sums_in_slots(spark, width):
    rng = random.Random(int(width))
    rows = [(k, i, rng.randint(0, 9)) for k in ("a", "b", None) for i in rng.sample(range(200), 60)]
    slots = ordered.in_slots(spark.createDataFrame(rows, "k string, i int, v int"), "i", width)
    got = ordered.neighbour(slots, ["k"], ["i"], ["v", "i"], "before")
    after = {(r.k, r.i): r.after for r in ordered.neighbour(slots, ["k"], ["i"], ["v", "i"], "after", after=True).collect()}
    sums = {(r.k, r.i): r.total for r in ordered.running_sum(slots, ["k"], ["i"], F.col("v"), "total").collect()}
    assert got.count() == len(rows) == len(sums)
    for k in ("a", "b", None):
        mine = sorted(r for r in rows if r[0] == k)
        found = {r.i: r.before for r in got.where(F.col("k").eqNullSafe(k)).collect()}
        for at, (_, i, _) in enumerate(mine):
            assert (tuple(found[i]) if found[i] else None) == ((mine[at - 1][2], mine[at - 1][1]) if at else None)
            assert (tuple(after[k, i]) if after[k, i] else None) == ((mine[at + 1][2], mine[at + 1][1]) if at + 1 < len(mine) else None)
            assert sums[k, i] == sum(r[2] for r in mine[: at + 1])
    plain = ordered.in_slots(spark.createDataFrame([(i, 1) for i in range(50)], "i int, v int"), "i", width)
    assert {r.i: r.t for r in ordered.running_sum(plain, [], ["i"], F.col("v"), "t").collect()} == {i: i + 1 for i in range(50)}


def test_densify(spark):
    rng = random.Random(2)
    lines = {k: walk(rng, n, 4.0) for k, n in enumerate([1, 2, 30, 200])} | {9: [(10.0, 179.5), (11.0, -179.0), (11.0, -179.0), (60.0, 0.0)]}
    rows = [(k, i, a, b) for k, p in lines.items() for i, (a, b) in enumerate(p)]
    parts = P.segments(spark.createDataFrame(rows, "line int, i int, latitude double, longitude double").repartition(4), "line", "i")
    dense = P.densify(parts).orderBy("line", "i", "step").collect()
    for k, p in lines.items():
        mine = [(r.latitude, r.longitude) for r in dense if r.line == k]
        steps = [km(*a, *b) for a, b in zip(mine, mine[1:])]
        assert max(steps, default=0) <= 50 + 1e-6
        total = sum(km(*a, *b) for a, b in zip(p, p[1:]))
        assert abs(sum(steps) - total) <= 1e-6 * max(1, total)
        assert len(mine) == 1 + sum(max(1, math.ceil(km(*a, *b) / 50)) for a, b in zip(p, p[1:]))
        assert [(r.latitude, r.longitude) for r in dense if r.line == k and r.step == 0] == p
    assert P.densify(P.segments(spark.createDataFrame([], "line int, i int, latitude double, longitude double"), "line", "i")).collect() == []


def test_tiers_and_measurements(spark):
    df = spark.createDataFrame([(100.0, "(1.5,1,2)"), (99.9, " (3,,) "), (30.0, "(None,1,2)"), (1.0, "about 5"), (0.0, None), (5.0, "(1e999,0,0)"), (6.0, "(-2.5,x, 4 )"), (7.0, "(,1,2)")], "km double, t string")
    got = df.select(P.zoom_tier(F.col("km")).alias("z"), P.measurement(F.col("t")).alias("m")).collect()
    assert [r.z for r in got] == [0, 1, 1, 2, 2, 2, 2, 2]
    assert [tuple(r.m) if r.m else None for r in got] == [(1.5, 1.0, 2.0), (3.0, None, None), None, None, None, None, (-2.5, None, 4.0), None]


def test_merged_steps(spark):
    def step(i, b, c, a, z):
        return (i, b, c, a, 1.0, z, 1.0)

    rows = [step(1, "x", "SUB", 0.0, 1.0), step(2, "x", "SUB", 1.0 + 5e-7, 2.0), step(3, "x", "SUB", 2.1, 3.0), step(7, "x", "OTF", 3.0, 4.0), step(8, "y", "OTF", 4.0, 5.0), step(30, "y", "OTF", 5.0, 6.0)]
    schema = "i int, b string, c string, start_latitude double, start_longitude double, end_latitude double, end_longitude double"
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = sorted(map(tuple, P.merge_steps(df, "i", ["b", "c"], "c").select("chain", "number", "b", "c", "motion", "latitude").collect()))
    assert got == [
        (1, 0, "x", "SUB", "convergent", 0.0), (1, 1, "x", "SUB", "convergent", 1.0), (1, 2, "x", "SUB", "convergent", 2.0), (2, 0, "x", "SUB", "convergent", 2.1), (2, 1, "x", "SUB", "convergent", 3.0),
        (3, 0, "x", "OTF", "transform", 3.0), (3, 1, "x", "OTF", "transform", 4.0), (4, 0, "y", "OTF", "transform", 4.0), (4, 1, "y", "OTF", "transform", 5.0), (4, 2, "y", "OTF", "transform", 6.0),
    ]
    with pytest.raises(Exception, match="class without a motion: ZZZ"):
        P.merge_steps(spark.createDataFrame([step(1, "x", "ZZZ", 0.0, 1.0)], schema), "i", ["b", "c"], "c").collect()
    assert P.merge_steps(df.limit(0), "i", ["b", "c"], "c").collect() == []


@pytest.mark.parametrize("spacing", [150.0, 40.0])
def test_runs_teeth_and_marks(spark, spacing):
    rng = random.Random(int(spacing))
    rows, i = [], 0
    for slab, n in (("a", 1), ("b", 80), ("b2", 150), ("a", 40), ("c", 2)):
        jump = rng.randrange(5, 60)
        for k, (lat, lon) in enumerate(walk(rng, n, 0.6)):
            rows.append((i, slab, lat + (4 if k >= jump else 0), lon, float(rng.randrange(-720, 720))))
            i += rng.choice([1, 1, 2, 40])
    df = spark.createDataFrame(rows, "i int, slab string, latitude double, longitude double, az double").repartition(5)
    runs, teeth, since, at = {}, [], 0.0, 0
    marks, far = [], 0.0
    for before, r in zip([None, *rows], rows):
        step = km(*before[2:4], *r[2:4]) if before else 0
        if before is None or before[1] != r[1] or step > 150:
            at, since, far, step, n = at + 1, spacing / 2, 0.0, 0.0, 0
        since += step
        if since >= spacing:
            teeth.append((at, r[0], (r[4] + 90) % 360))
            since = 0.0
        while far + step > 0 and (n + 0.5) * spacing <= far + step:
            f = ((n + 0.5) * spacing - far) / step
            marks.append((at, n, f, before, r))
            n += 1
        far += step
        runs[r[0]] = (at, r[1])
    mine = P.runs_by_distance(df, "i", ["slab"])
    assert {r.i: (r.run, r.slab) for r in mine.collect()} == runs
    assert sorted((r.run, r.i, r.dip) for r in P.teeth(mine, "run", "i", "az", spacing).collect()) == teeth and len(teeth) > 10
    got = {(r.run, r.mark): r for r in P.marks(mine, "run", "i", spacing).collect()}
    assert set(got) == {m[:2] for m in marks}
    for run, n, f, a, b in marks:
        r = got[run, n]
        assert abs(km(*a[2:4], r.latitude, r.longitude) - f * km(*a[2:4], *b[2:4])) < 1e-5
        assert abs(km(*a[2:4], r.latitude, r.longitude) + km(r.latitude, r.longitude, *b[2:4]) - km(*a[2:4], *b[2:4])) < 1e-5
    assert P.teeth(mine.where("false"), "run", "i", "az").collect() == []
