"""The registered tests, assembled from operators. Every epoch and width is a parameter; the defaults are those registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.operators import stats
from tremor.operators.decluster import decluster
from tremor.operators.series import eligible, episodes, hourly_grid
from tremor.operators.tables import written


@dataclass(frozen=True)
class Parameters:
    """What a run may be given; unknown keys are refused."""

    hypothesis: str
    start_ms: int
    end_ms: int
    iterations: int = K.ITERATIONS
    half_ms: int = int(K.BASELINE_DAYS * K.DAY_MS / 2)
    target_magnitude: float = K.TARGET_MAGNITUDE
    matrix_size: int = K.MATRIX_SIZE
    q: float = K.FALSE_DISCOVERY_RATE
    mode: str = "hash"
    short: str = "raise"  # more triggers than hours: raise an error, draw every hour (as the SQL does), or give no p ("none")
    lags: tuple[tuple[int, int], ...] = field(default=())
    keep_null: Callable[[str, DataFrame], None] | None = None  # is given each test's null (iter, ratio)
    keep_independent: Callable[[DataFrame], None] | None = None  # is given all declustered events, in the span or not

    @classmethod
    def of(cls, **given) -> Parameters:
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        if given.get("hypothesis") not in K.LAGS:
            raise ValueError(f"unknown hypothesis: {given.get('hypothesis')}")
        return cls(**({"lags": tuple(K.LAGS[given["hypothesis"]])} | given))


def validate_catalog(events: DataFrame) -> DataFrame:
    """One row of counts of what is wrong; all zero for a catalogue that may be analysed."""
    return events.agg(
        F.count_if(~F.col("latitude").between(-90, 90) | F.isnan("latitude")).alias("bad_latitude"),
        F.count_if(~F.col("longitude").between(-180, 180) | F.isnan("longitude")).alias("bad_longitude"),
        F.count_if(F.col("magnitude").isNull() | F.isnan("magnitude")).alias("bad_magnitude"),
        F.count_if(~F.year(F.timestamp_millis("time_ms")).between(1900, 2100)).alias("bad_time"),
    )


def targets_of(events: DataFrame, p: Parameters) -> DataFrame:
    """Decluster everything sent, then cut to the span."""
    found, inside = decluster(events.where(F.col("magnitude") >= p.target_magnitude)), F.col("time_ms").between(p.start_ms, p.end_ms)
    if p.keep_independent is None:
        return written(found.where(inside), "targets")
    found = written(found, "independent")
    p.keep_independent(found)
    return found.where(inside)


def drawable(n: int, hours: int, p: Parameters) -> int | None:
    """How many hours a draw takes; None where there are not as many as triggers and such a test is to have no p."""
    if p.short not in ("raise", "every", "none"):
        raise ValueError(f"unknown value of short: {p.short}")
    if n > hours and p.short == "raise":
        raise ValueError("more draws than hours")
    return n if n <= hours else hours if p.short == "every" else None


def _nulls(tables: dict, n: int, p: Parameters):
    """A function that gives the null of a lag, or None; hash draws are made once for all lags, since they depend on the hours alone."""
    seed = K.SEEDS[p.hypothesis]
    pool = next(iter(tables.values()))
    n = drawable(n, pool.count(), p)
    if n is None:
        return lambda lag: None
    if p.mode == "numpy":
        return lambda lag: stats.null_by_numpy(tables[lag], n, p.iterations, seed)
    draws = written(stats.hash_draws(pool, n, p.iterations, seed), "draws")
    return lambda lag: stats.null_of_draws(draws, tables[lag])


def _with_p(row: DataFrame, null: DataFrame | None, p: Parameters) -> DataFrame:
    if p.hypothesis == "H1b" and null is not None:
        null = null.withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return _p_of(row, null, p)


def _p_of(row: DataFrame, null: DataFrame | None, p: Parameters, statistic: str = "ratio") -> DataFrame:
    """The row of a test with its p against a null, null where there is none; the null is handed to whoever keeps it."""
    if null is None:
        return row.withColumn("p", F.lit(None).cast("double"))
    first = row.first()
    if p.keep_null is not None:
        null = written(null, "null")
        p.keep_null(first["test_id"], null)
    return row.join(F.broadcast(stats.p_value(null, first[statistic] or 0.0, p.iterations)))


def series_test(targets: DataFrame, series: DataFrame, p: Parameters, name: str, value: str, threshold: float, above: bool, least_hours: int, with_null: bool = True) -> list[DataFrame]:
    """H4c and H3b: onsets of threshold episodes against eligible hours of the series."""
    grid = written(hourly_grid(series, p.start_ms, p.end_ms, [value]), "grid")
    onsets = written(episodes(grid, value, threshold, above, least_hours).select(((F.col("onset_ms") - p.start_ms) / K.HOUR_MS).cast("long").alias("idx")), "onsets")
    tables = stats.hour_tables(eligible(grid, value, least_hours), targets, p.lags, p.start_ms, p.end_ms, p.half_ms)
    rows = {lag: stats.ratio_of(table.join(onsets, "idx")).select(F.lit(f"{p.hypothesis}/{name}/{lag[0]}-{lag[1]}h").alias("test_id"), "triggers", "observed", "expected", "ratio") for lag, table in tables.items()}
    if not with_null:
        return list(rows.values())
    null = _nulls(tables, next(iter(rows.values())).first()["triggers"], p)
    return [_with_p(row, null(lag), p) for lag, row in rows.items()]


def h4c(events: DataFrame, series: DataFrame, p: Parameters, with_null: bool = True) -> DataFrame:
    targets = targets_of(events, p)
    rows = series_test(targets, series, p, "kp>=6", "kp", K.TRIGGER_KP, True, 1, with_null) + series_test(targets, series, p, "dst<=-100", "dst", K.TRIGGER_DST, False, 1, with_null)
    return adjusted(rows, p, with_null)


def h3b(events: DataFrame, series: DataFrame, p: Parameters, with_null: bool = True) -> DataFrame:
    return adjusted(series_test(targets_of(events, p), series, p, "wind>=500", "wind_speed", K.STREAM_WIND, True, K.STREAM_HOURS, with_null), p, with_null)


def every_hour(spark, p: Parameters) -> DataFrame:
    return spark.range((p.end_ms - p.start_ms) // K.HOUR_MS).select(F.col("id").alias("idx"), (F.col("id") * K.HOUR_MS + p.start_ms).alias("time_ms"))


def h1b(events: DataFrame, flares: DataFrame, p: Parameters, with_null: bool = True) -> DataFrame:
    """Flares of class M1.0 and up (peak_ms), trimmed to the span; the table of hours serves observations and null alike."""
    targets = targets_of(events, p)
    pool = every_hour(events.sparkSession, p)
    rows = []
    big = flares.where(F.col("peak_ms").between(p.start_ms, p.end_ms - 1)).select(F.col("peak_ms").alias("time_ms"))
    rated = written(stats.local_rate(big, targets, p.start_ms, p.end_ms, p.half_ms), "rates")
    tables = stats.hour_tables(pool, targets, p.lags, p.start_ms, p.end_ms, p.half_ms) if with_null else {}
    for (a, b), real in stats.lag_totals(rated, targets, p.lags).items():
        rows.append(real.select(F.lit(f"H1b/flare>=M1.0/{a}-{b}h").alias("test_id"), "triggers", "observed", "expected", "ratio"))
    if with_null:
        null = _nulls(tables, rows[0].first()["triggers"], p)
        rows = [_with_p(row, null(lag), p) for row, lag in zip(rows, p.lags)]
    return adjusted(rows, p, with_null)


def h2b(events: DataFrame, arrivals: DataFrame, p: Parameters, with_null: bool = True) -> DataFrame:
    """Direct arrivals (time_ms): targets on the sunlit half against the other; triggers are not cut at the start."""
    targets = targets_of(events, p)
    pool = every_hour(events.sparkSession, p)
    rows = []
    for a, b in p.lags:
        real = stats.hemisphere_ratio(arrivals, targets, a, b).select(F.lit(f"H2b/direct-impact/{a}-{b}h").alias("test_id"), "near", "far", "ratio")
        if with_null and (n := drawable(arrivals.count(), pool.count(), p)) is None:
            real = _p_of(real, None, p)
        elif with_null:
            near = F.col("near_hit").cast("int")
            pairs = stats.hemisphere_pairs(pool, targets, a, b).withColumn("near_hit", stats.geo.within_degrees("longitude", "sub_lon", K.HEMISPHERE_DEGREES))
            table = pairs.groupBy("t_ms").agg(F.sum(near).alias("observed"), F.sum((1 - near).cast("double")).alias("expected"))
            table = pool.join(table, pool["time_ms"] == table["t_ms"], "left").select("idx", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
            null = (stats.null_by_numpy if p.mode == "numpy" else stats.null_by_hash)(written(table, "hours"), n, p.iterations, K.SEEDS["H2b"])
            real = _p_of(real, null, p)
        rows.append(real)
    return adjusted(rows, p, with_null)


def h5(events: DataFrame, p: Parameters, with_null: bool = True) -> DataFrame:
    """Independent mainshocks' antipodes: distances of targets in the window against all pairs, by D+ and two-sided D.

    The null redraws the triggers' instants over every hour of the span; antipodes and targets stay.
    """
    targets = targets_of(events, p)
    triggers = targets.where(F.col("magnitude") >= K.H5_TRIGGER_MAGNITUDE)
    (a, b), = p.lags
    window = written(stats.distance_counts(stats.window_distances(triggers, targets, a, b)), "window")
    reference = written(stats.cdf(stats.reference_counts(triggers, targets)), "reference")
    d = stats.d_plus(stats.cdf(window), reference)
    pairs = window.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    row = pairs.join(F.broadcast(d)).select(F.lit(f"H5/M{K.H5_TRIGGER_MAGNITUDE}+ mainshock/{a}-{b}h").alias("test_id"), "pairs", "d_plus", "two_sided")
    if with_null:
        draw = stats.d_plus_null_by_numpy if p.mode == "numpy" else stats.d_plus_null_by_hash
        pool, null = every_hour(events.sparkSession, p), None
        # Each trigger takes an hour of its own, so there is no such draw of fewer hours.
        if drawable(triggers.count(), pool.count(), replace(p, short="none") if p.short == "every" else p) is not None:
            null = draw(pool, triggers, targets, reference, a, b, p.iterations, K.SEEDS["H5"]).withColumnRenamed("d_plus", "ratio")
        row = _p_of(row, null, p, "d_plus")
    return adjusted([row], p, with_null)


def adjusted(rows: list[DataFrame], p: Parameters, with_null: bool) -> DataFrame:
    """All tests of a run, adjusted within the run and over the whole matrix; the matrix decides."""
    tests = reduce(DataFrame.unionByName, rows)
    if not with_null:
        return tests
    tests = written(tests, "tests")
    run = stats.benjamini_hochberg(tests, p.q).withColumnRenamed("p_adjusted", "p_run").drop("rejected")
    return stats.benjamini_hochberg(run, p.q, p.matrix_size).withColumnRenamed("p_adjusted", "p_matrix")


REGISTRY = {"H4c": h4c, "H3b": h3b, "H2b": h2b, "H1b": h1b, "H5": h5}
