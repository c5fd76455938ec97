"""Local rates, lag windows, hemispheres, distance tests, permutation nulls and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo
from tremor.operators.rangejoin import counts_before, hourly_counts, interval_join
from tremor.operators.tables import written


def local_rate(instants: DataFrame, targets: DataFrame, start_ms: int, end_ms: int, half_ms: int = int(K.BASELINE_DAYS * K.DAY_MS / 2)) -> DataFrame:
    """instants with `rate` an hour: targets within half_ms on either side, ends included, over the part of that within the span."""
    lo, hi = F.greatest(F.col("time_ms") - half_ms, F.lit(start_ms)), F.least(F.col("time_ms") + half_ms, F.lit(end_ms))
    inside = targets.where(F.col("time_ms").between(start_ms, end_ms)).select(F.col("time_ms").alias("p"))
    w = instants.withColumn("_lo", lo).withColumn("_hi", hi)
    w = counts_before(counts_before(w, inside, "_hi", "p", "_upto", True), inside, "_lo", "p", "_under", False)
    hours = (F.col("_hi") - F.col("_lo")) / K.HOUR_MS
    return w.withColumn("rate", F.when(F.col("_hi") > F.col("_lo"), (F.col("_upto") - F.col("_under")) / F.when(hours > 0, hours)).otherwise(F.lit(0.0))).select(*instants.columns, "rate")


def lag_counts(instants: DataFrame, targets: DataFrame, a_hours: int, b_hours: int, name: str = "observed") -> DataFrame:
    """instants with the number of targets in [t + a, t + b) hours; a target counts for every instant."""
    p = targets.select(F.col("time_ms").alias("p"))
    w = instants.withColumn("_a", F.col("time_ms") + a_hours * K.HOUR_MS).withColumn("_b", F.col("time_ms") + b_hours * K.HOUR_MS)
    w = counts_before(counts_before(w, p, "_b", "p", "_nb", False), p, "_a", "p", "_na", False)
    return w.withColumn(name, F.col("_nb") - F.col("_na")).select(*instants.columns, name)


def lag_totals(rated: DataFrame, targets: DataFrame, lags: tuple[tuple[int, int], ...]) -> dict[tuple[int, int], DataFrame]:
    """ratio_of(lag_counts) for each lag of instants with their rate, from one count of the targets before every bound of any lag.

    Sums over the instants are all that is needed, so the counts before two bounds are summed first and then subtracted.
    """
    bounds = sorted({x for lag in lags for x in lag})
    at = rated.select("time_ms", F.explode(F.array(*map(F.lit, bounds))).alias("bound")).withColumn("_at", F.col("time_ms") + F.col("bound") * K.HOUR_MS)
    counted = counts_before(at, targets.select(F.col("time_ms").alias("p")), "_at", "p", "_n", False).groupBy("bound").agg(F.sum("_n").alias("n"))
    held = written(counted, "bounds")
    totals = written(rated.agg(F.count("*").alias("triggers"), F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rate")), "totals")
    out = {}
    for a, b in lags:
        observed = held.agg(F.coalesce(F.sum(F.when(F.col("bound") == b, F.col("n")).when(F.col("bound") == a, -F.col("n"))), F.lit(0)).cast("long").alias("observed"))
        both = totals.join(F.broadcast(observed)).select("triggers", "observed", (F.col("rate") * (b - a)).alias("expected"))
        out[a, b] = both.withColumn("ratio", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))
    return out


def hour_table(hours: DataFrame, targets: DataFrame, a_hours: int, b_hours: int, start_ms: int, end_ms: int, half_ms: int) -> DataFrame:
    """For every hour of a pool: what a trigger there would expect and observe. Nulls and observations both look up this table."""
    rated = local_rate(hours, targets, start_ms, end_ms, half_ms)
    return lag_counts(rated, targets, a_hours, b_hours).withColumn("expected", F.col("rate") * (b_hours - a_hours))


def hour_tables(hours: DataFrame, targets: DataFrame, lags: tuple[tuple[int, int], ...], start_ms: int, end_ms: int, half_ms: int) -> dict[tuple[int, int], DataFrame]:
    """hour_table for each lag, for a pool of whole hours (idx, time_ms) from start_ms and a half width of whole hours.

    Targets are counted by hour once; rates and all lags are differences of those counts. Tables grow with the span alone.
    """
    if half_ms % K.HOUR_MS:
        return {lag: written(hour_table(hours, targets, *lag, start_ms, end_ms, half_ms), "hours") for lag in lags}
    half, last = half_ms // K.HOUR_MS, -(-(end_ms - start_ms) // K.HOUR_MS)
    ends = [x for lag in lags for x in lag]
    counts = written(hourly_counts(targets, "time_ms", start_ms, min([0, *ends]), last + max([0, *ends]) + 1), "counts")
    inside = written(hourly_counts(targets.where(F.col("time_ms").between(start_ms, end_ms)), "time_ms", start_ms, 0, last + 1), "inside")
    pool = hours.select("idx", "time_ms")
    low, high = F.greatest(F.col("idx") - half, F.lit(0)), F.least(F.col("idx") + half, F.lit(last))
    under = inside.select(F.col("hour").alias("_l"), F.col("before").alias("_under"))
    upto = inside.select(F.col("hour").alias("_h"), (F.col("before") + F.col("at")).alias("_upto"), F.col("before").alias("_all"))
    rated = pool.join(under, low == F.col("_l")).join(upto, high == F.col("_h"))
    first_ms, last_ms = F.greatest(F.col("time_ms") - half_ms, F.lit(start_ms)), F.least(F.col("time_ms") + half_ms, F.lit(end_ms))
    span = (last_ms - first_ms) / K.HOUR_MS
    # A window that the end of the span cuts within an hour ends there: all that is inside counts.
    within = F.when(F.col("time_ms") + half_ms > end_ms, F.greatest("_upto", "_all")).otherwise(F.col("_upto"))
    rated = written(rated.select("idx", "time_ms", F.when(span > 0, (within - F.col("_under")) / F.when(span > 0, span)).otherwise(F.lit(0.0)).alias("rate")), "rates")
    out = {}
    for a, b in lags:
        from_, to = (counts.select((F.col("hour") - x).alias("idx"), F.col("before").alias(c)) for x, c in ((a, "_a"), (b, "_b")))
        both = rated.join(from_, "idx").join(to, "idx")
        out[a, b] = written(both.select("idx", "time_ms", "rate", (F.col("_b") - F.col("_a")).alias("observed"), (F.col("rate") * (b - a)).alias("expected")), "hours")
    return out


def ratio_of(rows: DataFrame) -> DataFrame:
    a = rows.agg(F.count("*").alias("triggers"), F.coalesce(F.sum("observed"), F.lit(0)).cast("long").alias("observed"), F.coalesce(F.sum("expected"), F.lit(0.0)).alias("expected"))
    return a.withColumn("ratio", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))


def hash_draws(pool: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(iter, idx): n hours without replacement in each iteration, those of least md5; the same in any engine.

    Only hashes below a bound that some more than n of the hours fall under are ordered; an iteration in which fewer do, which
    chance hardly ever brings about, is drawn again from all hours. So the rows that are ordered and kept grow with the draws; hashing
    itself is work for every hour and iteration.
    """
    hours = pool.count()
    order = F.md5(F.concat_ws(":", F.lit(seed), "iter", "idx").cast("binary"))
    least = lambda rows: rows.withColumn("_r", F.row_number().over(Window.partitionBy("iter").orderBy("_h", "idx"))).where(F.col("_r") <= n)
    each = pool.select("idx", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter")).withColumn("_h", order)
    share = (n + 8 * n**0.5 + 8) / max(1, hours)
    if share >= 0.8:
        return least(each).select("iter", "idx")
    low = written(least(each.where(F.col("_h") < f"{int(share * 2**32):08x}")), "draws")
    short = low.groupBy("iter").agg(F.count("*").alias("_c")).where(F.col("_c") == n)
    again = written(pool.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iter")).join(short, "iter", "left_anti"), "again")
    if again.isEmpty():
        return low.select("iter", "idx")
    more = least(pool.select("idx").crossJoin(F.broadcast(again)).withColumn("_h", order))
    return low.join(again, "iter", "left_anti").select("iter", "idx").union(more.select("iter", "idx"))


def null_by_hash(table: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(iter, ratio) of the permutation null; no value where nothing is expected."""
    if n > table.count():
        raise ValueError("more draws than hours")
    return null_of_draws(hash_draws(table, n, iterations, seed), table)


def null_of_draws(draws: DataFrame, table: DataFrame) -> DataFrame:
    """(iter, ratio) of drawn hours (iter, idx), looked up in a table of hours."""
    drawn = draws.join(table.select("idx", "expected", "observed"), "idx")
    s = drawn.groupBy("iter").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e"))
    return s.select("iter", F.when(F.col("e") > 0, F.col("o") / F.col("e")).alias("ratio"))


MOST_HOURS = 4_000_000


def null_by_numpy(table: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """The same null with numpy's draws, in tasks of iterations: the table goes to every executor.

    Its hours are counted first; beyond 4,000,000 of them (64 MB, 456 years) it refuses, and null_by_hash is the one to use:
    the two draw differently, so neither stands in for the other.
    """
    count = table.count()
    if n > count:
        raise ValueError("more draws than hours")
    if count > MOST_HOURS:
        raise ValueError("too many hours for numpy's draws; use mode hash")
    rows = table.orderBy("idx").select("expected", "observed").toPandas().to_numpy(dtype=float)
    shared = table.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                e, o = shared.value[np.random.default_rng([seed, int(i)]).choice(len(shared.value), size=n, replace=False)].sum(axis=0)
                out.append(o / e if e > 0 else None)
            yield pd.DataFrame({"iter": b["id"], "ratio": pd.array(out, dtype="Float64")})

    return table.sparkSession.range(iterations).mapInPandas(run, "iter long, ratio double")


def circular_shift(*_, **__):
    raise NotImplementedError("registered, never specified")


def p_value(null: DataFrame, observed: float, iterations: int, upper: bool = True) -> DataFrame:
    """(1 + extremes) / (1 + iterations); draws without a value are not extreme but count."""
    if iterations <= 0:
        raise ValueError("iterations must be positive")
    extreme = F.col("ratio") >= observed if upper else F.col("ratio") <= observed
    return null.agg(((1 + F.count_if(extreme)) / (1 + iterations)).alias("p"))


def null_summary(null: DataFrame) -> DataFrame:
    r = F.col("ratio")
    return null.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), *(F.percentile(r, q).alias(f"q{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)))


def null_histogram(null: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width bins of the finite values, the last closed; where all are equal the range is widened by a half on either side."""
    values = null.where(F.col("ratio").isNotNull())
    ends = values.agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).where("lo is not null")
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = values.join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("ratio") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    return null.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def benjamini_hochberg(tests: DataFrame, q: float = K.FALSE_DISCOVERY_RATE, family: int | None = None, p: str = "p", bucket_rows: int = 16_384) -> DataFrame:
    """Adjusted p by rank, the running least from the largest rank down, at most 1.

    Equal p share the adjusted p of the last of them, so distinct values are counted first; these are ranked in ranges of
    about bucket_rows, with counts carried up and the least values carried down between the ranges. A test without a p is not of
    the family: it has no adjusted p and is not rejected.
    """
    known = tests.where(F.col(p).isNotNull())
    n = known.count()
    if family is not None and family < n:
        raise ValueError("the family is smaller than the tests given")
    m = family or n
    values = written(known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "values")
    distinct = values.count()
    ranges = -(-distinct // bucket_rows)
    splits = sorted(set(values.approxQuantile("_p", [k / ranges for k in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    placed = values.withColumn("_g", F.size(F.filter(F.array(*[F.lit(x) for x in splits]).cast("array<double>"), lambda x: x < F.col("_p"))) if splits else F.lit(0))
    sums = placed.groupBy("_g").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_g", F.coalesce(F.sum("_sum").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    each = Window.partitionBy("_g").orderBy("_p")
    ranked = placed.join(F.broadcast(before), "_g").withColumn("_raw", F.col("_p") * m / (F.col("_before") + F.sum("_n").over(each)))
    ranked = written(ranked, "ranked")
    later = ranked.groupBy("_g").agg(F.min("_raw").alias("_min")).select("_g", F.min("_min").over(Window.orderBy("_g").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    least = F.least(F.lit(1.0), F.min("_raw").over(each.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))
    adjusted = ranked.join(F.broadcast(later), "_g").select("_p", least.alias("p_adjusted"))
    found = tests.join(F.broadcast(adjusted) if distinct <= 1_000_000 else adjusted, tests[p] == adjusted["_p"], "left").drop("_p")
    return found.withColumn("rejected", F.coalesce(F.col("p_adjusted") <= q, F.lit(False)))


def subsolar(time_ms: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the subsolar point, by the Almanac's low-precision formula."""
    n = time_ms / K.DAY_MS + 2440587.5 - 2451545.0
    mean = F.pmod(280.460 + 0.9856474 * n, F.lit(360.0))
    g = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = F.radians(mean + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.0000004 * n)
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.degrees(F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic)))
    equation = geo.wrap_upper(mean - ascension)
    hours = F.pmod(time_ms, F.lit(K.DAY_MS)) / K.HOUR_MS
    return F.degrees(declination), geo.wrap_upper(-15.0 * (hours - 12.0) - equation)


def hemisphere_pairs(triggers: DataFrame, targets: DataFrame, a_hours: int, b_hours: int) -> DataFrame:
    """Trigger-target pairs with the target in [t + a, t + b), and the trigger's subsolar longitude."""
    t = triggers.select(F.col("time_ms").alias("t_ms")).withColumn("sub_lon", subsolar(F.col("t_ms"))[1])
    return interval_join(t, targets, F.col("t_ms") + a_hours * K.HOUR_MS, F.col("t_ms") + b_hours * K.HOUR_MS - 1, "time_ms", max(1, b_hours - a_hours) * K.HOUR_MS)


def hemisphere_ratio(triggers: DataFrame, targets: DataFrame, a_hours: int, b_hours: int, split: float = K.HEMISPHERE_DEGREES) -> DataFrame:
    near = geo.within_degrees("longitude", "sub_lon", split)
    s = hemisphere_pairs(triggers, targets, a_hours, b_hours).agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far"))
    return s.withColumn("ratio", F.when(F.col("far") > 0, F.col("near") / F.col("far")))


def distance_counts(distances: DataFrame, column: str = "distance_km", bins: int = K.KS_BINS, width: float = K.KS_BIN_KM) -> DataFrame:
    return distances.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(column) / width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def cdf(counts: DataFrame, bins: int = K.KS_BINS) -> DataFrame:
    """(bin, n, cdf), every bin; zeros when there is nothing."""
    full = counts.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return full.select("bin", "n", F.when(total > 0, F.sum("n").over(Window.orderBy("bin")) / F.when(total > 0, total)).otherwise(F.lit(0.0)).alias("cdf"))


def window_distances(triggers: DataFrame, targets: DataFrame, a_hours: int, b_hours: int) -> DataFrame:
    """Distance from each trigger's antipode to the targets in (t + a, t + b), neither end included."""
    la, lo = geo.antipode("latitude", "longitude")
    t = triggers.select(F.col("event_id").alias("trigger_id"), F.col("time_ms").alias("t_ms"), la.alias("alat"), lo.alias("alon"))
    # A month has ten windows of three days: keys of a twelfth of the window are enough for many tasks.
    width = max(1, (b_hours - a_hours) // 12) * K.HOUR_MS
    hit = interval_join(t, targets, F.col("t_ms") + a_hours * K.HOUR_MS + 1, F.col("t_ms") + b_hours * K.HOUR_MS - 1, "time_ms", width)
    return hit.select("trigger_id", "event_id", geo.haversine_km("alat", "alon", "latitude", "longitude").alias("distance_km"))


def _places(points: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """Different places with how many points lie there, some `rows` to a block of three arrays; and the number of blocks."""
    staged = written(points.groupBy("latitude", "longitude").agg(F.count("*").alias("n")), "places")
    blocks = max(1, -(-staged.count() // rows))
    place = F.struct(*(F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "n")))
    held = staged.groupBy(F.pmod(F.xxhash64("latitude", "longitude"), F.lit(blocks)).alias(f"{name}_block")).agg(F.collect_list(place).alias("p"))
    return written(held.select(f"{name}_block", *(F.col(f"p.{c}").alias(f"{name}_{c}") for c in ("latitude", "longitude", "n"))), "blocks"), blocks


def pair_bins(a: np.ndarray, b: np.ndarray, bins: int = K.KS_BINS, width: float = K.KS_BIN_KM, cells: int = 1 << 20) -> np.ndarray:
    """Pairs of places (latitude, longitude, number) by bins of their distance; those without a coordinate are in the last bin.

    Angles come from scalar products. Where they lie so near a border of bins that these do not decide, haversines do.
    """
    counts = np.zeros(bins, dtype=np.int64)
    known_a, known_b = (~np.isnan(x[:2]).any(axis=0) for x in (a, b))
    counts[-1] += int(a[2].sum()) * int(b[2].sum()) - int(a[2][known_a].sum()) * int(b[2][known_b].sum())
    a, b = a[:, known_a], b[:, known_b]
    if not a.size or not b.size:
        return counts

    def vectors(x: np.ndarray) -> np.ndarray:
        la, lo = np.radians(x[0]), np.radians(x[1])
        return np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)))

    va, vb, single = vectors(a).T, vectors(b), bool((a[2] == 1).all() and (b[2] == 1).all())
    step = max(1, cells // a.shape[1])
    for k in range(0, b.shape[1], step):
        x = np.arccos(np.clip(va @ vb[:, k : k + step], -1, 1)) * (K.EARTH_RADIUS_KM / width)
        bin_ = np.minimum(x.astype(np.int64), bins - 1)
        edge = np.round(x)
        i, j = np.nonzero((np.abs(x - edge) < 1e-7) & (edge > 0))
        if len(i):
            p, q = a[:, i], b[:, k + j]
            h = np.sin(np.radians(q[0] - p[0]) / 2) ** 2 + np.cos(np.radians(p[0])) * np.cos(np.radians(q[0])) * np.sin(np.radians(q[1] - p[1]) / 2) ** 2
            bin_[i, j] = np.minimum((2 * K.EARTH_RADIUS_KM * np.arcsin(np.minimum(1, np.sqrt(h))) / width).astype(np.int64), bins - 1)
        # Products of counts are whole numbers: sums of doubles are exact up to 2^53.
        counts += np.bincount(bin_.ravel(), None if single else np.outer(a[2], b[2][k : k + step]).ravel(), bins).astype(np.int64)
    return counts


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lambda row, name: np.array([row[f"{name}_{c}"].values.to_numpy(zero_copy_only=False) for c in ("latitude", "longitude", "n")])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names if not c.endswith("_block")}
            counts = pair_bins(of(row, "a"), of(row, "b"))
            yield pa.RecordBatch.from_pydict({"bin": pa.array(range(len(counts)), pa.int64()), "n": pa.array(counts, pa.int64())})


def reference_counts(triggers: DataFrame, targets: DataFrame, block_rows: int = 4096, target_rows: int = 65_536) -> DataFrame:
    """Distances of every trigger's antipode to every target, as counts a bin.

    Every pair counts, so the work is the product of the numbers of different places. Blocks of them meet in pairs, a pair to a row
    and, where the hash allows, to a task, which keeps 201 counts: a task's time and memory are bounded whatever the number of events.
    """
    la, lo = geo.antipode("latitude", "longitude")
    a, n = _places(triggers.select(la.alias("latitude"), lo.alias("longitude")), block_rows, "a")
    b, m = _places(targets, target_rows, "b")
    pairs = a.crossJoin(b).repartition(min(n * m, 20_000), "a_block", "b_block")
    return pairs.mapInArrow(_count_blocks, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")


def d_plus(observed: DataFrame, reference: DataFrame) -> DataFrame:
    both = observed.select("bin", F.col("cdf").alias("a")).join(reference.select("bin", F.col("cdf").alias("b")), "bin")
    return both.agg(F.max(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))).alias("d_plus"), F.max(F.abs(F.col("a") - F.col("b"))).alias("two_sided"))


def numbered(df: DataFrame, time: str, tie: str, width: int = K.DAY_MS) -> DataFrame:
    """df with `number` from 1 in order of time: ranks within a day, and the counts of the days before."""
    days = df.withColumn("_day", F.floor(F.col(time) / width).cast("long"))
    before = days.groupBy("_day").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy(time, tie))
    return days.withColumn("_rank", rank).join(before, "_day").withColumn("number", F.col("_before") + F.col("_rank")).drop("_day", "_rank", "_n", "_before")


def d_plus_null_by_hash(pool: DataFrame, triggers: DataFrame, targets: DataFrame, reference: DataFrame, a_hours: int, b_hours: int, iterations: int, seed: int) -> DataFrame:
    """(iter, d_plus) of triggers redrawn over the pool's hours: in each draw the k-th trigger takes the k-th hour, its antipode stays."""
    n = triggers.count()
    if n > pool.count():
        raise ValueError("more draws than hours")
    drawn = hash_draws(pool, n, iterations, seed).withColumn("number", F.row_number().over(Window.partitionBy("iter").orderBy("idx")))
    la, lo = geo.antipode("latitude", "longitude")
    anti = numbered(triggers, "time_ms", "event_id").select("number", la.alias("alat"), lo.alias("alon"))
    placed = drawn.join(anti, "number").join(pool.select("idx", F.col("time_ms").alias("t_ms")), "idx")
    points = targets.select("time_ms", "latitude", "longitude")
    hit = interval_join(placed, points, F.col("t_ms") + a_hours * K.HOUR_MS + 1, F.col("t_ms") + b_hours * K.HOUR_MS - 1, "time_ms", (b_hours - a_hours) * K.HOUR_MS)
    bins = hit.groupBy("iter", F.least(F.lit(K.KS_BINS - 1), F.floor(geo.haversine_km("alat", "alon", "latitude", "longitude") / K.KS_BIN_KM)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("iter")
    # The reference only rises between the bins of a draw, so the largest difference is at one of them.
    share = bins.withColumn("_cdf", F.sum("n").over(each.orderBy("bin")) / F.sum("n").over(each)).join(F.broadcast(reference.select("bin", "cdf")), "bin")
    found = share.groupBy("iter").agg(F.max(F.greatest(F.col("_cdf") - F.col("cdf"), F.lit(0.0))).alias("d_plus"))
    return pool.sparkSession.range(iterations).select(F.col("id").alias("iter")).join(found, "iter", "left").select("iter", F.coalesce("d_plus", F.lit(0.0)).alias("d_plus"))


def d_plus_null_by_numpy(pool: DataFrame, triggers: DataFrame, targets: DataFrame, reference: DataFrame, a_hours: int, b_hours: int, iterations: int, seed: int, most_rows: int = 4_000_000) -> DataFrame:
    """The same null with numpy's draws, in tasks of iterations: hours, antipodes and targets (counted first) go to every executor.

    Beyond most_rows of them it refuses: d_plus_null_by_hash is the one to use there, with other draws.
    """
    n, hours = triggers.count(), pool.count()
    if n > hours:
        raise ValueError("more draws than hours")
    if max(hours, targets.count()) > most_rows:
        raise ValueError("too many rows for numpy's draws; use mode hash")
    la, lo = geo.antipode("latitude", "longitude")
    times = pool.orderBy("idx").select("time_ms").toPandas()["time_ms"].to_numpy()
    anti = np.radians(triggers.orderBy("time_ms", "event_id").select(la, lo).toPandas().to_numpy(dtype=float))
    at = targets.orderBy("time_ms", "event_id").select("time_ms", "latitude", "longitude").toPandas()
    known = reference.orderBy("bin").select("cdf").toPandas()["cdf"].to_numpy()
    shared = pool.sparkSession.sparkContext.broadcast((times, anti, at["time_ms"].to_numpy(), np.radians(at[["latitude", "longitude"]].to_numpy(dtype=float)), known))
    hour_ms, km, width, bins = K.HOUR_MS, 2 * K.EARTH_RADIUS_KM, K.KS_BIN_KM, K.KS_BINS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, anti, t, where, known = shared.value
        for b in batches:
            out = []
            for i in b["id"]:
                drawn = times[np.sort(np.random.default_rng([seed, int(i)]).choice(len(times), size=n, replace=False))]
                first, last = np.searchsorted(t, drawn + a_hours * hour_ms, side="right"), np.searchsorted(t, drawn + b_hours * hour_ms, side="left")
                each = np.maximum(last - first, 0)
                k = np.repeat(np.arange(n), each)
                j = np.arange(len(k)) + np.repeat(first - (np.cumsum(each) - each), each)
                x, y = anti[k], where[j]
                h = np.sin((y[:, 0] - x[:, 0]) / 2) ** 2 + np.cos(x[:, 0]) * np.cos(y[:, 0]) * np.sin((y[:, 1] - x[:, 1]) / 2) ** 2
                distance = km * np.arcsin(np.minimum(1.0, np.sqrt(h)))
                upto = np.cumsum(np.bincount(np.minimum(bins - 1, (distance / width).astype(np.int64)), minlength=bins))
                out.append(max(0.0, float(np.max(upto / max(1, upto[-1]) - known))))
            yield pd.DataFrame({"iter": b["id"], "d_plus": out})

    return pool.sparkSession.range(iterations).mapInPandas(run, "iter long, d_plus double")
