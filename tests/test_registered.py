"""The registered tests in their whole form."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.operators import stats
from tremor.plans import catalogue

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_null_by_hash_equals_brute_force(spark):
    rows = [(i, 0.5 + i % 4, i % 3) for i in range(30)]
    got = {r.iter: r.ratio for r in stats.null_by_hash(spark.createDataFrame(rows, "idx long, expected double, observed long"), 7, 200, 11).collect()}
    assert len(got) == 200
    for i in range(200):
        drawn = sorted(rows, key=lambda r: (hashlib.md5(f"11:{i}:{r[0]}".encode()).hexdigest(), r[0]))[:7]
        assert abs(got[i] - sum(r[2] for r in drawn) / sum(r[1] for r in drawn)) < 1e-12


@tables
def test_h4c_runs_the_registered_permutations(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalogue.H, "h4c", lambda events, series, p, **more: given.append(p))
    catalogue.QUERIES["h4c_with_null"](spark, SF)
    assert given[0].iterations == K.ITERATIONS
    assert K.MATRIX_SIZE / (1 + given[0].iterations) < K.FALSE_DISCOVERY_RATE  # one real effect can be found


@tables
def test_null_queries_run_the_registered_permutations(spark):
    null = catalogue.QUERIES["registered_null_distribution"](spark, SF)
    assert null.count() == K.ITERATIONS
    assert catalogue.QUERIES["registered_permutation_p"](spark, SF).first().p >= 1 / (1 + K.ITERATIONS)


def test_h5_null_equals_brute_force(spark):
    rng = random.Random(5)
    events = [(i, rng.randrange(200) * K.HOUR_MS + rng.choice([0, 1, 999]), rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)]
    pool = spark.range(200).selectExpr("id as idx", f"id * {K.HOUR_MS} as time_ms")
    targets = spark.createDataFrame(events, "event_id long, time_ms long, latitude double, longitude double")
    triggers = targets.where("event_id < 12")
    reference = stats.cdf(stats.reference_counts(triggers, targets)).cache()
    known = [r.cdf for r in reference.orderBy("bin").collect()]
    anti = [(-la, lo - 180 if lo >= 0 else lo + 180) for _, _, la, lo in sorted(events[:12], key=lambda e: (e[1], e[0]))]

    def statistic(hours):
        counts = [0] * K.KS_BINS
        for h, (la, lo) in zip(sorted(hours), anti):
            for _, t, la2, lo2 in events:
                if h * K.HOUR_MS < t < (h + 24) * K.HOUR_MS:
                    a, b, c, d = map(math.radians, (la, lo, la2, lo2))
                    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
                    counts[min(K.KS_BINS - 1, int(2 * K.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(x))) / K.KS_BIN_KM))] += 1
        upto = [sum(counts[: k + 1]) / max(1, sum(counts)) for k in range(K.KS_BINS)]
        return max(0.0, *(u - r for u, r in zip(upto, known)))

    given = (pool, triggers, targets, reference, 0, 24, 15, 3)
    by_hash = {r.iter: r.d_plus for r in stats.d_plus_null_by_hash(*given).collect()}
    by_numpy = {r.iter: r.d_plus for r in stats.d_plus_null_by_numpy(*given).collect()}
    assert len(by_hash) == len(by_numpy) == 15
    for i in range(15):
        drawn = sorted(range(200), key=lambda h: (hashlib.md5(f"3:{i}:{h}".encode()).hexdigest(), h))[:12]
        assert abs(by_hash[i] - statistic(drawn)) < 1e-9
        assert abs(by_numpy[i] - statistic(np.random.default_rng([3, i]).choice(200, size=12, replace=False))) < 1e-9
    with pytest.raises(ValueError):
        stats.d_plus_null_by_hash(pool.limit(11), *given[1:])
    with pytest.raises(ValueError):
        stats.null_by_hash(pool.selectExpr("idx", "1.0D as expected", "1L as observed"), 201, 5, 7)


@tables
@pytest.mark.parametrize("name, tests", [("h1b_with_null", 4), ("h2b_with_null", 2), ("h3b_with_null", 4), ("h5_test", 1)])
def test_registered_tests_have_p_values(spark, name, tests):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert len(rows) == tests
    assert all(1 / (1 + K.ITERATIONS) <= r.p <= r.p_run <= r.p_matrix <= 1 and r.rejected == (r.p_matrix <= K.FALSE_DISCOVERY_RATE) for r in rows)


def adjusted(ps, m):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = {}, 1.0
    for rank in range(len(ps), 0, -1):
        least = min(least, ps[order[rank - 1]] * m / rank)
        out[order[rank - 1]] = least
    return out


@pytest.mark.parametrize("family", [None, 700])
def test_benjamini_hochberg_in_ranges(spark, family):
    rng = random.Random(9)
    ps = [rng.choice([rng.random(), rng.random() ** 8, 0.25, 0.003]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(ps)), "test_id long, p double")
    want = adjusted(ps, family or 600)
    for rows in (7, 100, 10_000):
        got = stats.benjamini_hochberg(df, 0.05, family, bucket_rows=rows).collect()
        assert len(got) == 600 and all(abs(r.p_adjusted - want[r.test_id]) < 1e-12 and r.rejected == (r.p_adjusted <= 0.05) for r in got)
    assert stats.benjamini_hochberg(df.limit(0)).collect() == []


@tables
def test_bh_takes_every_part(spark):
    parts = [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    want = adjusted([((k * 7919) % 1000 + 1) / 1001 for k in parts], len(parts))
    got = {r.test_id: r.p_adjusted for r in catalogue.QUERIES["bh_adjusted_all"](spark, SF).collect()}
    assert len(got) == len(parts) > 41
    assert all(abs(got[k] - want[i]) < 1e-6 for i, k in enumerate(parts))


def test_lag_totals_equal_counts_by_lag(spark):
    rng = random.Random(12)
    rated = spark.createDataFrame([(rng.randrange(400) * K.HOUR_MS + rng.choice([0, 7]), rng.random()) for _ in range(60)], "time_ms long, rate double")
    targets = spark.createDataFrame([(rng.randrange(500) * K.HOUR_MS,) for _ in range(200)], "time_ms long")
    lags = ((0, 24), (24, 48), (72, 168))
    got = stats.lag_totals(rated, targets, lags)
    for a, b in lags:
        want = stats.ratio_of(stats.lag_counts(rated, targets, a, b).withColumn("expected", F.col("rate") * (b - a))).first()
        mine = got[a, b].first()
        assert (mine.triggers, mine.observed) == (want.triggers, want.observed) and abs(mine.expected - want.expected) < 1e-9 and abs(mine.ratio - want.ratio) < 1e-9
    empty = stats.lag_totals(rated.limit(0), targets, lags)[0, 24].first()
    assert (empty.triggers, empty.observed, empty.expected, empty.ratio) == (0, 0, 0.0, None)


def test_reference_counts_by_blocks_equal_brute_force(spark):
    """Equal places, places at a border of bins and one without a coordinate; blocks much smaller than the tables."""
    rng = random.Random(8)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(0.0, math.degrees(100 * k / K.EARTH_RADIUS_KM)) for k in range(-20, 20)] + [(None, 1.0)]
    rows = [(i, *rng.choice(places)) for i in range(300)]
    targets = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    triggers = targets.where("event_id < 90")
    want = [0] * K.KS_BINS
    for _, la, lo in rows[:90]:
        for _, c, d in rows:
            if la is None or c is None:
                want[-1] += 1
                continue
            a, b = -la, lo - 180 if lo >= 0 else lo + 180
            h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
            want[min(K.KS_BINS - 1, int(2 * K.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h))) / K.KS_BIN_KM))] += 1
    counts = stats.reference_counts(triggers, targets, block_rows=16, target_rows=30)
    got = {r.bin: r.n for r in counts.collect()}
    assert got == {k: n for k, n in enumerate(want) if n}
    assert "RepartitionByExpression" in counts._jdf.queryExecution().optimizedPlan().toString()  # a pair of blocks is a row of its own


def test_more_triggers_than_hours(spark):
    """By default an error, as in the reference; else a draw of every hour, or tests without a p that reject nothing."""
    rng = random.Random(3)
    H = catalogue.H
    events = spark.createDataFrame([(i, catalogue.START_MS + rng.randrange(20) * K.HOUR_MS, 5.0, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(25)], "event_id long, time_ms long, magnitude double, latitude double, longitude double")
    flares = spark.createDataFrame([(catalogue.START_MS + rng.randrange(20 * K.HOUR_MS),) for _ in range(30)], "peak_ms long")
    given = {"end_ms": catalogue.START_MS + 20 * K.HOUR_MS, "half_ms": 2 * K.HOUR_MS, "iterations": 5, "lags": ((0, 2), (2, 4))}
    with pytest.raises(ValueError):
        H.h1b(events, flares, catalogue.parameters("H1b", **given))
    every = H.h1b(events, flares, catalogue.parameters("H1b", short="every", **given)).collect()
    assert len(every) == 2 and all(r.triggers == 30 and r.p in (1 / 6, 1.0) for r in every)  # all draws are the same
    none = H.h1b(events, flares, catalogue.parameters("H1b", short="none", mode="numpy", **given)).collect()
    assert len(none) == 2 and all((r.p, r.p_run, r.p_matrix, r.rejected) == (None, None, None, False) and r.ratio is not None for r in none)


def test_tests_without_p_are_not_ranked(spark):
    df = spark.createDataFrame([(1, 0.02), (2, None), (3, 0.04)], "test_id long, p double")
    got = {r.test_id: (r.p_adjusted, r.rejected) for r in stats.benjamini_hochberg(df, 0.05).collect()}
    assert got == {1: (0.04, True), 2: (None, False), 3: (0.04, True)}
