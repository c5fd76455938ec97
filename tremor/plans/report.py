"""The report of a run: one nested row of a fixed schema with its tests, nulls, corrections, notices and what was left out."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.operators import scan
from tremor.operators.series import eligible, episodes, hourly_grid
from tremor.operators.tables import written
from tremor.plans import hypotheses as H
from tremor.plans.catalogue import _DST, _KP, GRID_SQL, HOUR, TARGETS, episodes_sql, gk_sql, matrix_sql, parameters, query, subsolar_sql
from tremor.sources import fixtures as X
from tremor.sources.fixtures import CMES_SQL, END_MS, START_MS

CONTRACT, ENGINE = 1, "tremor 3"
BINS = 60
DEFERRED, BLOCKED = 2, 0
QUANTILES = (0.5, 0.9, 0.95, 0.99)

SCHEMA = """contract_version int, engine_version string, hypothesis_id string, run_at_ms bigint, duration_ms bigint, seed bigint,
    span struct<requested_start_ms: bigint, used_start_ms: bigint, used_end_ms: bigint, truncation_reason: string>,
    catalog struct<min_magnitude: double, raw_count: bigint, declustered_count: bigint, declustering: string, left_out: struct<small: bigint, dependent: bigint, outside_span: bigint>>,
    triggers array<struct<id: string, count: bigint, eligible_hours: bigint>>,
    tests array<struct<id: string, trigger_id: string, lag_hours: array<bigint>, observed: double, expected: double, ratio: double, p_raw: double, p_adjusted_within_run: double, p_adjusted_full_matrix: double, rejected_at_q: boolean,
        null: struct<n: bigint, mean: double, sd: double, quantiles: array<double>, histogram: struct<edges: array<double>, counts: array<bigint>>>, observed_label: string, expected_label: string, statistic_label: string>>,
    correction struct<method: string, q: double, tests_run: int, registered_matrix_tests: int, deferred_tests: int, blocked_tests: int, partial_matrix: boolean, note: string>,
    method struct<null_model: string, tail: string, iterations: int, baseline_window_days: double, spatial_split_degrees: double, completeness_model: string>,
    notices array<string>"""

#: What the numbers of a hypothesis are, where they are not an observed count, an expected one and their ratio.
LABELS = {"H2b": ("targets on the sunlit side", "targets on the dark side", "sunlit to dark ratio"), "H5": ("targets in the windows", "two-sided D", "one-sided D")}


def null_details(nulls: DataFrame) -> DataFrame:
    """Per test of (test_id, iter, ratio): a struct of the number of values, mean, deviation, quantiles and a histogram of 60 bins.

    All tests at once, by two aggregations; bins are equal and the last closed, and where all values are one, half a unit to either side.
    """
    r = F.col("ratio")
    by = nulls.groupBy("test_id").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.percentile(r, list(QUANTILES)).alias("quantiles"), F.min(r).alias("lo"), F.max(r).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    by = by.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    place = F.least(F.lit(BINS - 1), F.floor((r - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
    counts = nulls.where(r.isNotNull()).join(F.broadcast(by.select("test_id", "lo", "hi")), "test_id").groupBy("test_id", place.alias("bin")).agg(F.count("*").alias("c"))
    held = counts.groupBy("test_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("held"))  # 60 bins a test at most
    edges = F.when(F.col("lo").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / BINS))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
    return by.join(held, "test_id", "left").select("test_id", F.struct("n", "mean", "sd", "quantiles", F.struct(edges.alias("edges"), bins.alias("counts")).alias("histogram")).alias("null"))


def notices(hypothesis: str, *, triggers: int, targets: int, observed: float, half_days: float, truncated: bool, complete: bool = True) -> list[str]:
    """What a reader must know, by rule; what changes the meaning of the whole result comes first."""
    out = []
    if truncated:
        out.append("The span starts where the catalogue is complete, later than was registered.")
    if hypothesis in ("H4c", "H3b", "H1b"):
        out.append(f"Rates are local, over {half_days:g} days on either side, as the number of recorded events has grown over the decades; this follows the growth and does not remove it.")
    if hypothesis == "H4c":
        out.append("Episodes of both indices overlap in time, so the tests of this family are positively correlated; the correction stays valid under that.")
    if hypothesis == "H1b":
        out.append(f"{triggers} flares against {targets} independent events; flares come in clusters, so their windows overlap, in observed and expected counts alike.")
    if hypothesis == "H2b":
        out.append("The statistic compares the two halves of the globe; observed and expected are counts of these, not of an expectation.")
    if hypothesis == "H5":
        out.append("Few places have instruments near their antipode, so a large p is in part an absence of records and no evidence of absence.")
        out.append("The null redraws the triggers' instants alone, so gaps in detection are in the observed and the null distances alike.")
    if not complete:
        out.insert(0, "PARTIAL TRIGGERS: the record of triggers is not complete, so this is not the registered test.")
    if hypothesis == "H5" and triggers == 0:
        out.insert(0, "NO TRIGGERS: no independent event reaches the floor; statistic and p mean nothing.")
    elif hypothesis == "H5" and observed == 0:
        out.insert(0, "NO TARGETS: every window is empty; statistic and p mean nothing.")
    return out


def assemble(tests: DataFrame, nulls: dict[str, DataFrame], p: H.Parameters, *, catalog: dict, triggers: list[tuple[str, int, int | None]], requested_start_ms: int, truncation: str | None, complete: bool, began: float) -> DataFrame:
    """One row of SCHEMA from a run's adjusted tests, their nulls and its counts. Tests are at most those of the matrix."""
    spark = tests.sparkSession
    every = None
    for test_id, null in nulls.items():
        part = null.select(F.lit(test_id).alias("test_id"), "iter", F.col("ratio").cast("double").alias("ratio"))
        every = part if every is None else every.unionByName(part)
    named = {"H2b": ("near", "far", "ratio"), "H5": ("pairs", "two_sided", "d_plus")}.get(p.hypothesis, ("observed", "expected", "ratio"))
    labels = LABELS.get(p.hypothesis, (None, None, None))
    # Without triggers nothing is drawn, and such a test has no values in its null.
    empty = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(t).alias(c) for c, t in (("mean", "double"), ("sd", "double"), ("quantiles", "array<double>"))), F.struct(F.lit(None).cast("array<double>").alias("edges"), F.array_repeat(F.lit(0).cast("long"), BINS).alias("counts")).alias("histogram"))
    both = tests.join(null_details(every), "test_id", "left").withColumn("null", F.coalesce("null", empty))
    lag = F.regexp_extract_all(F.element_at(F.split("test_id", "/"), -1), F.lit(r"(\d+)")).cast("array<bigint>")
    parts = [F.col("test_id").alias("id"), F.element_at(F.split("test_id", "/"), 2).alias("trigger_id"), lag.alias("lag_hours")]
    parts += [F.col(c).cast("double").alias(n) for c, n in zip(named, ("observed", "expected", "ratio"))]
    parts += [F.col(c).alias(n) for c, n in (("p", "p_raw"), ("p_run", "p_adjusted_within_run"), ("p_matrix", "p_adjusted_full_matrix"), ("rejected", "rejected_at_q"), ("null", "null"))]
    parts += [F.lit(x).cast("string").alias(n) for x, n in zip(labels, ("observed_label", "expected_label", "statistic_label"))]
    one = both.select(F.struct(*parts).alias("t")).agg(F.sort_array(F.collect_list("t")).alias("tests"))
    one = written(one, "report")
    n = len(nulls)
    first = one.select(F.col("tests")[0]["observed"].alias("o")).first().o
    said = notices(p.hypothesis, triggers=sum(t[1] for t in triggers), targets=catalog["declustered_count"], observed=first or 0, half_days=p.half_ms / K.DAY_MS, truncated=truncation is not None, complete=complete)
    spatial = p.hypothesis == "H2b"
    note = f"{n} of {p.matrix_size} registered tests were run here; {DEFERRED} more are deferred." + (" Adjusted p-values are provisional until all are run." if n < p.matrix_size else "")
    lit = lambda fields: F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))
    infos = F.array(*(lit({"id": i, "count": c, "eligible_hours": e}) for i, c, e in triggers)) if triggers else F.array()
    row = one.select(
        F.lit(CONTRACT).alias("contract_version"), F.lit(ENGINE).alias("engine_version"), F.lit(p.hypothesis).alias("hypothesis_id"), F.lit(int(time.time() * 1000)).alias("run_at_ms"), F.lit(int((time.monotonic() - began) * 1000)).alias("duration_ms"), F.lit(K.SEEDS[p.hypothesis]).alias("seed"),
        lit({"requested_start_ms": requested_start_ms, "used_start_ms": p.start_ms, "used_end_ms": p.end_ms, "truncation_reason": truncation}).alias("span"),
        F.struct(F.lit(p.target_magnitude).alias("min_magnitude"), *(F.lit(catalog[k]).alias(k) for k in ("raw_count", "declustered_count")), F.lit("windows by magnitude").alias("declustering"), lit(catalog["left_out"]).alias("left_out")).alias("catalog"),
        infos.alias("triggers"), "tests",
        lit({"method": "benjamini-hochberg", "q": p.q, "tests_run": n, "registered_matrix_tests": p.matrix_size, "deferred_tests": DEFERRED, "blocked_tests": BLOCKED, "partial_matrix": n < p.matrix_size, "note": note}).alias("correction"),
        lit({"null_model": "uniform redraw without replacement", "tail": "upper", "iterations": p.iterations, "baseline_window_days": None if spatial or p.hypothesis == "H5" else 2 * p.half_ms / K.DAY_MS, "spatial_split_degrees": K.HEMISPHERE_DEGREES if spatial else None, "completeness_model": "conditioned on what was detected" if p.hypothesis == "H5" else None}).alias("method"),
        (F.array(*map(F.lit, said)) if said else F.array().cast("array<string>")).alias("notices"),
    )
    return row.to(spark.createDataFrame([], SCHEMA).schema)


def problems(report: DataFrame) -> list[str]:
    """What is wrong with a report; nothing for one that may be shown. A schema that differs is wrong as a whole."""
    want = report.sparkSession.createDataFrame([], SCHEMA).schema
    if [(f.name, f.dataType.simpleString()) for f in report.schema] != [(f.name, f.dataType.simpleString()) for f in want]:
        return ["schema"]
    rows = report.limit(2).collect()
    if len(rows) != 1:
        return ["not one row"]
    (r,), out = rows, []
    if r.hypothesis_id not in K.LAGS:
        out.append("hypothesis")
    if not r.span.requested_start_ms <= r.span.used_start_ms <= r.span.used_end_ms or (r.span.requested_start_ms < r.span.used_start_ms) != (r.span.truncation_reason is not None):
        out.append("span")
    left = r.catalog.left_out
    if r.catalog.declustered_count + left.dependent + left.outside_span != r.catalog.raw_count or min(left) < 0:
        out.append("catalog counts")
    if len(r.tests) != r.correction.tests_run or r.correction.partial_matrix != (r.correction.tests_run < r.correction.registered_matrix_tests):
        out.append("number of tests")
    if r.hypothesis_id in ("H4c", "H3b", "H1b", "H2b") and (r.method.baseline_window_days is None) == (r.method.spatial_split_degrees is None):
        out.append("method parameters")
    for t in r.tests:
        edges, counts = t.null.histogram.edges, t.null.histogram.counts
        if len(counts) != BINS or len(edges or []) not in (0, BINS + 1) or sum(counts) != t.null.n or t.null.n > r.method.iterations or (edges and any(a >= b for a, b in zip(edges, edges[1:]))):
            out.append(f"null of {t.id}")
        if not 1 / (1 + r.method.iterations) - 1e-12 <= t.p_raw <= t.p_adjusted_within_run + 1e-12 <= 1 + 2e-12 or t.p_adjusted_within_run > t.p_adjusted_full_matrix + 1e-12 or t.rejected_at_q != (t.p_adjusted_full_matrix <= r.correction.q):
            out.append(f"p of {t.id}")
        if len(t.lag_hours) != 2 or t.lag_hours[0] >= t.lag_hours[1]:
            out.append(f"lag of {t.id}")
    return out


def run(hypothesis: str, events: DataFrame, p: H.Parameters, *, series: DataFrame | None = None, flares: DataFrame | None = None, arrivals: DataFrame | None = None, requested_start_ms: int | None = None, truncation: str | None = None, complete: bool = True) -> DataFrame:
    """Run a registered test and report it; a report with a problem is an error, not a result."""
    began, nulls, held = time.monotonic(), {}, []
    p = replace(p, keep_null=nulls.__setitem__, keep_independent=held.append)
    tests = {
        "H4c": lambda: H.h4c(events, series, p),
        "H3b": lambda: H.h3b(events, series, p),
        "H1b": lambda: H.h1b(events, flares, p),
        "H2b": lambda: H.h2b(events, arrivals, p),
        "H5": lambda: H.h5(events, p),
    }[hypothesis]()
    (independent,) = held  # the run declusters once
    inside = F.col("time_ms").between(p.start_ms, p.end_ms)
    kept = independent.agg(F.count("*").alias("all"), F.count_if(inside).alias("inside"), F.count_if(inside & (F.col("magnitude") >= K.H5_TRIGGER_MAGNITUDE)).alias("strong")).first()
    raw = events.agg(F.count("*").alias("all"), F.count_if(F.col("magnitude") >= p.target_magnitude).alias("large")).first()
    catalog = {"raw_count": raw.large, "declustered_count": kept.inside, "left_out": {"small": raw["all"] - raw.large, "dependent": raw.large - kept["all"], "outside_span": kept["all"] - kept.inside}}
    hours = (p.end_ms - p.start_ms) // K.HOUR_MS
    if hypothesis in ("H4c", "H3b"):
        kinds = [("kp>=6", "kp", K.TRIGGER_KP, True, 1), ("dst<=-100", "dst", K.TRIGGER_DST, False, 1)] if hypothesis == "H4c" else [("wind>=500", "wind_speed", K.STREAM_WIND, True, K.STREAM_HOURS)]
        grid = written(hourly_grid(series, p.start_ms, p.end_ms, [k[1] for k in kinds]), "grid")
        found = [(name, episodes(grid, value, threshold, above, least).count(), eligible(grid, value, least).count()) for name, value, threshold, above, least in kinds]
    elif hypothesis == "H1b":
        found = [("flare>=M1.0", flares.where(F.col("peak_ms").between(p.start_ms, p.end_ms - 1)).count(), hours)]
    elif hypothesis == "H2b":
        found = [("direct-impact", arrivals.count(), hours)]
    else:
        found = [(f"M{K.H5_TRIGGER_MAGNITUDE}+ mainshock", kept.strong, hours)]
    report = written(assemble(tests, nulls, p, catalog=catalog, triggers=found, requested_start_ms=p.start_ms if requested_start_ms is None else requested_start_ms, truncation=truncation, complete=complete, began=began), "report")
    if wrong := problems(report):
        raise ValueError(f"the report is not sound: {wrong}")
    return report


def rows_of(report: DataFrame) -> DataFrame:
    """A row a test, with the run's counts, for display as a table."""
    t = report.select("*", F.explode("tests").alias("t"))
    quantiles = [F.round(F.col("t.null.quantiles")[k], 6).alias(f"q{int(q * 100)}") for k, q in enumerate(QUANTILES)]
    six = lambda c, n: F.round(c, 6).alias(n)
    return t.select(
        F.col("t.id").alias("test_id"), "t.trigger_id", *(six(f"t.{c}", c) for c in ("observed", "expected", "ratio", "p_raw", "p_adjusted_within_run", "p_adjusted_full_matrix")), "t.rejected_at_q", six("t.null.mean", "null_mean"), six("t.null.sd", "null_sd"), *quantiles,
        F.array_join(F.col("t.null.histogram.counts").cast("array<string>"), ",").alias("histogram"), "catalog.raw_count", "catalog.declustered_count", F.col("catalog.left_out.small").alias("small"), F.col("catalog.left_out.dependent").alias("dependent"),
        F.col("correction.tests_run").cast("long").alias("tests_run"), "correction.partial_matrix", F.size("notices").cast("long").alias("notices"),
    )


def details_sql(k: str, j: int, test: str, value: str) -> str:
    x = f"(SELECT {value.format(j=j)} AS x FROM n{k})"
    return f"""SELECT '{test}' AS test_id, avg(x) AS null_mean, stddev_pop(x) AS null_sd, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.9) AS q90, quantile_cont(x, 0.95) AS q95, quantile_cont(x, 0.99) AS q99,
    (SELECT string_agg(CAST(coalesce(c, 0) AS VARCHAR), ',' ORDER BY b) FROM range({BINS}) r(b) LEFT JOIN (SELECT least({BINS - 1}, floor((x - lo) / (hi - lo) * {BINS})) AS bin, count(*) AS c FROM {x}, (SELECT min(x) AS lo, max(x) AS hi FROM {x}) WHERE x IS NOT NULL GROUP BY 1) ON bin = b) AS histogram FROM {x}"""


def report_sql(hypothesis: str, ctes: list[str], rows: list[str], details: list[str], notices_: int) -> str:
    tests = matrix_sql(ctes, rows)
    at = tests.rindex(" SELECT test_id, triggers")
    return (
        tests[:at] + ", final AS (" + tests[at:] + "), details AS (" + " UNION ALL ".join(details) + f"""), sizes AS (SELECT count(*) FILTER (magnitude >= 5.0) AS raw_count, count(*) FILTER (magnitude < 5.0) AS small FROM quakes), free AS (SELECT count(*) AS f, count(*) FILTER (time_ms BETWEEN {START_MS} AND {END_MS}) AS inside FROM independent)
        SELECT test_id, split_part(test_id, '/', 2) AS trigger_id, CAST(observed AS DOUBLE) AS observed, expected, ratio, p AS p_raw, p_run AS p_adjusted_within_run, p_matrix AS p_adjusted_full_matrix, rejected AS rejected_at_q, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd,
            round(q50, 6) AS q50, round(q90, 6) AS q90, round(q95, 6) AS q95, round(q99, 6) AS q99, histogram, raw_count, inside AS declustered_count, small, raw_count - f AS dependent, (SELECT count(*) FROM final) AS tests_run, (SELECT count(*) FROM final) < {K.MATRIX_SIZE} AS partial_matrix, CAST({notices_} AS BIGINT) AS notices
        FROM final JOIN details USING (test_id), sizes, free"""
    )


_H4C = [details_sql(k, j, f"H4c/{name}/{a}-{b}h", "x{j}") for k, name in (("1", "kp>=6"), ("2", "dst<=-100")) for j, (a, b) in enumerate(K.LAGS["H4c"])]


@query(report_sql("H4c", [gk_sql() + TARGETS + f", {GRID_SQL}, {episodes_sql('k', 'kp >= 6', 1)}, {episodes_sql('s', 'dst <= -100', 1)}, k1 AS (SELECT (onset_ms - {START_MS}) // {HOUR} AS idx FROM k), k2 AS (SELECT (onset_ms - {START_MS}) // {HOUR} AS idx FROM s), " + _KP[0], _DST[0]], [_KP[1], _DST[1]], _H4C, 3))
def run_report(spark, d):
    """The report of H4c, a row a test."""
    return rows_of(run("H4c", X.quakes(spark, d), parameters("H4c"), series=X.series(spark, d), requested_start_ms=START_MS - 1, truncation="the catalogue starts later"))


def h2b_sql() -> str:
    near = f"abs(((longitude - {{}} + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) <= {K.HEMISPHERE_DEGREES}"
    pair = lambda t, src, a, b: f"FROM {src} JOIN tq q ON q.time_ms >= {t} + {a * HOUR} AND q.time_ms < {t} + {b * HOUR}"
    seed, n, lags = K.SEEDS["H2b"], K.ITERATIONS, K.LAGS["H2b"]
    ctes = [gk_sql(more=f", {CMES_SQL}") + f""", tq AS MATERIALIZED (SELECT * FROM independent WHERE time_ms BETWEEN {START_MS} AND {END_MS}), direct AS MATERIALIZED (SELECT time_ms AS t FROM cmes WHERE NOT glancing AND NOT minor),
    hours AS (SELECT i AS idx, {START_MS} + i * {HOUR} AS t FROM range(719) r(i)), drawn AS MATERIALIZED (SELECT it, idx FROM (SELECT it, idx, row_number() OVER (PARTITION BY it ORDER BY md5('{seed}:' || it || ':' || idx), idx) AS rk FROM hours, range({n}) r(it)) WHERE rk <= (SELECT count(*) FROM direct))"""]
    rows = []
    for j, (a, b) in enumerate(lags):
        seen = near.format(subsolar_sql("t"))
        ctes.append(f"h{j} AS MATERIALIZED (SELECT idx, count(*) FILTER (near) AS o, count(*) FILTER (NOT near) AS e FROM (SELECT idx, {seen} AS near {pair('t', 'hours', a, b)}) GROUP BY 1), x{j} AS MATERIALIZED (SELECT it, CASE WHEN sum(e) > 0 THEN sum(o) / sum(e) END AS x FROM drawn LEFT JOIN h{j} USING (idx) GROUP BY 1)")
        rows.append(f"""SELECT 'H2b/direct-impact/{a}-{b}h' AS test_id, near, far, ratio, (1 + (SELECT count(*) FROM x{j} WHERE x >= coalesce(ratio, 0))) / {n + 1}.0 AS p FROM (SELECT count(*) FILTER (near) AS near, count(*) FILTER (NOT near) AS far, CASE WHEN count(*) FILTER (NOT near) > 0 THEN count(*) FILTER (near) / count(*) FILTER (NOT near) END AS ratio FROM (SELECT {seen} AS near {pair('t', 'direct', a, b)}))""")
    return matrix_sql(ctes, rows).replace("SELECT test_id, triggers, observed, round(expected, 6) AS expected, round(ratio, 6)", "SELECT test_id, near, far, round(ratio, 6)")


@query(h2b_sql())
def h2b_hash_null(spark, d):
    """H2b with the null of hash draws."""
    direct = X.cmes(spark, d).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("time_ms")
    found = H.h2b(X.quakes(spark, d), direct, parameters("H2b", short="every"))
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "p", "p_run", "p_matrix")})
