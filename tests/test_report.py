"""Reports of runs: their schema, what is refused, notices by rule, and details of the nulls by hand."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.operators import scan, stats
from tremor.plans import report as R
from tremor.plans.catalogue import parameters
from tremor.sources import fixtures as X
from tremor.sources.fixtures import END_MS, START_MS

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def quantile(values, q):
    at = q * (len(values) - 1)
    a = math.floor(at)
    return values[a] + (at - a) * (values[min(a + 1, len(values) - 1)] - values[a])


def test_details_of_nulls(spark):
    rng = random.Random(4)
    nulls = {"a": [rng.gauss(1, 0.2) for _ in range(500)] + [None] * 7, "one": [2.0] * 9, "none": [None] * 3}
    df = spark.createDataFrame([(t, i, v) for t, vs in nulls.items() for i, v in enumerate(vs)], "test_id string, iter int, ratio double").repartition(5)
    got = {r.test_id: r.null for r in R.null_details(df).collect()}
    known = sorted(v for v in nulls["a"] if v is not None)
    a = got["a"]
    assert a.n == 500 and abs(a.mean - statistics.fmean(known)) < 1e-12 and abs(a.sd - statistics.pstdev(known)) < 1e-12
    assert all(abs(x - quantile(known, q)) < 1e-12 for x, q in zip(a.quantiles, R.QUANTILES))
    lo, hi, counts = known[0], known[-1], [0] * 60
    for v in known:
        counts[min(59, int((v - lo) / (hi - lo) * 60))] += 1
    assert a.histogram.counts == counts and len(a.histogram.edges) == 61 and a.histogram.edges[0] == lo and abs(a.histogram.edges[-1] - hi) < 1e-12
    assert (got["one"].sd, got["one"].histogram.edges[0], got["one"].histogram.edges[-1]) == (0.0, 1.5, 2.5) and got["one"].histogram.counts[30] == 9
    assert got["none"].n == 0 and got["none"].mean is None and sum(got["none"].histogram.counts) == 0


def test_notices_by_rule():
    say = lambda h, **m: R.notices(h, **({"triggers": 5, "targets": 9, "observed": 3.0, "half_days": 182.6, "truncated": False} | m))
    assert say("H1b", complete=False)[0].startswith("PARTIAL TRIGGERS") and not any("PARTIAL" in x for x in say("H1b"))
    assert say("H5", triggers=0, observed=0)[0].startswith("NO TRIGGERS") and say("H5", observed=0)[0].startswith("NO TARGETS") and len(say("H5")) == 2
    assert len(say("H4c", truncated=True)) == len(say("H4c")) + 1 and "182.6 days" in say("H3b")[0]
    assert "5 flares against 9" in " ".join(say("H1b")) and len(say("H2b")) == 1


def given(spark, h):
    events = X.quakes(spark, SF)
    return {
        "H4c": {"series": X.series(spark, SF)},
        "H3b": {"series": X.series(spark, SF)},
        "H1b": {"flares": X.flares(spark, SF).where(scan.flare_at_least(F.col("flare_class"), F.col("magnitude"), "M"))},
        "H2b": {"arrivals": X.cmes(spark, SF).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("time_ms")},
        "H5": {},
    }[h] | {"events": events}


@tables
@pytest.mark.parametrize("h", ["H4c", "H3b", "H2b", "H1b", "H5"])
def test_every_run_reports(spark, h):
    inputs = given(spark, h)
    report = R.run(h, inputs.pop("events"), parameters(h, iterations=300), requested_start_ms=START_MS - 5, truncation="later", complete=h != "H1b", **inputs)
    r = report.first()
    assert R.problems(report) == [] and r.hypothesis_id == h and r.seed == K.SEEDS[h] and len(r.tests) == len(K.LAGS[h]) * (2 if h == "H4c" else 1)
    assert (r.span.used_start_ms, r.span.used_end_ms, r.span.truncation_reason) == (START_MS, END_MS, "later")
    raw = X.quakes(spark, SF).where("magnitude >= 5").count()
    assert r.catalog.raw_count == raw and r.catalog.left_out.small + raw == X.quakes(spark, SF).count() and r.catalog.declustered_count < raw
    assert r.correction.partial_matrix and str(len(r.tests)) in r.correction.note and (r.method.spatial_split_degrees is not None) == (h == "H2b")
    assert r.notices[0].startswith("PARTIAL" if h == "H1b" else "The span")
    for t in r.tests:
        assert sum(t.null.histogram.counts) == t.null.n <= 300 and (t.statistic_label is not None) == (h in ("H2b", "H5"))
        assert t.id.startswith(f"{h}/{t.trigger_id}/{t.lag_hours[0]}-{t.lag_hours[1]}")
    assert R.rows_of(report).count() == len(r.tests)


@tables
def test_unsound_reports_are_refused(spark):
    report = R.run("H2b", given(spark, "H2b")["events"], parameters("H2b", iterations=100), arrivals=given(spark, "H2b")["arrivals"])
    assert R.problems(report) == []
    assert R.problems(report.drop("notices")) == ["schema"] and R.problems(report.limit(0)) == ["not one row"] and R.problems(report.union(report)) == ["not one row"]
    change = lambda **m: report.withColumns({k: F.expr(v) for k, v in m.items()}).to(report.schema)
    wrong = {
        "hypothesis": {"hypothesis_id": "'H9'"},
        "span": {"span": "named_struct('requested_start_ms', span.used_start_ms + 1, 'used_start_ms', span.used_start_ms, 'used_end_ms', span.used_end_ms, 'truncation_reason', string(null))"},
        "catalog counts": {"catalog": "named_struct('min_magnitude', catalog.min_magnitude, 'raw_count', catalog.raw_count + 1, 'declustered_count', catalog.declustered_count, 'declustering', catalog.declustering, 'left_out', catalog.left_out)"},
        "number of tests": {"tests": "slice(tests, 1, 1)"},
        "method parameters": {"method": "named_struct('null_model', method.null_model, 'tail', method.tail, 'iterations', method.iterations, 'baseline_window_days', 1D, 'spatial_split_degrees', method.spatial_split_degrees, 'completeness_model', string(null))"},
    }
    for name, how in wrong.items():
        assert name in R.problems(change(**how)), name
    fewer = change(method="named_struct('null_model', method.null_model, 'tail', method.tail, 'iterations', 5, 'baseline_window_days', method.baseline_window_days, 'spatial_split_degrees', method.spatial_split_degrees, 'completeness_model', string(null))")
    assert any(x.startswith("null of") for x in R.problems(fewer))


@tables
@tables
def test_a_run_declusters_once(spark, monkeypatch):
    from tremor.operators import decluster

    made, real = [], decluster.edges
    monkeypatch.setattr(decluster, "edges", lambda events: made.append(1) or real(events))
    inputs = given(spark, "H2b")
    r = R.run("H2b", inputs["events"], parameters("H2b", iterations=20), arrivals=inputs["arrivals"]).first()
    assert len(made) == 1 and r.catalog.raw_count == r.catalog.declustered_count + r.catalog.left_out.dependent + r.catalog.left_out.outside_span


def test_numpy_refuses_where_it_cannot(spark):
    pool = spark.range(20).selectExpr("id as idx", "id * 3600000 as time_ms")
    events = spark.createDataFrame([(1, 5, 1.0, 1.0)], "event_id long, time_ms long, latitude double, longitude double")
    reference = stats.cdf(stats.reference_counts(events, events))
    with pytest.raises(ValueError, match="too many rows"):
        stats.d_plus_null_by_numpy(pool, events, events, reference, 0, 24, 3, 1, most_rows=19)
