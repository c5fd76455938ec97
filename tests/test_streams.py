"""Independent streams into one table, its compaction, alerts by state, digests and snapshots."""

import itertools
import threading

import pytest
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.streaming import alerts as A
from tremor.streaming import feeds as S

TABLE = "time_ms long, kp double, wind double, flux double"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def legs(spark, top, broken=()):
    def read(name):
        return spark.readStream.schema("time_ms long, v double").option("maxFilesPerTrigger", 1).parquet(f"{top}/{name}")

    def rename(name):
        def to(batch):
            if name in broken:
                raise OSError(f"{name} is down")
            return batch.select("time_ms", F.col("v").alias(name))

        return to

    return {n: read(n) for n in ("kp", "wind", "flux")}, {n: rename(n) for n in ("kp", "wind", "flux")}


def rows_of(table):
    return sorted((r.time_ms, r.kp, r.wind, r.flux) for r in table.read().collect())


WANT = [(1, 5.0, 400.0, None), (2, None, 410.0, 1e-6), (3, 6.0, None, 2e-6)]


def fill(spark, top):
    land(spark, f"{top}/kp", [(1, 4.0), (2, None)], "time_ms long, v double")
    land(spark, f"{top}/kp", [(1, 5.0), (3, 6.0)], "time_ms long, v double")
    land(spark, f"{top}/wind", [(1, 400.0), (2, 410.0)], "time_ms long, v double")
    land(spark, f"{top}/flux", [(2, 1e-6), (3, 2e-6)], "time_ms long, v double")


def test_one_stream_fails_the_others_arrive(spark, tmp_path):
    fill(spark, tmp_path)
    table, told = S.VersionedTable(spark, f"file://{tmp_path}/table", TABLE, 4), []
    streams, prepare = legs(spark, tmp_path, broken=("wind",))
    got = S.poll(streams, prepare, table, "time_ms", f"{tmp_path}/c", after=lambda n, e: told.append(n))
    assert got["kp"] is None and got["flux"] is None and "wind is down" in got["wind"]
    assert rows_of(table) == [(t, k, None, f) for t, k, _, f in WANT] and sorted(told) == ["flux", "kp", "kp"]
    streams, prepare = legs(spark, tmp_path)
    assert S.poll(streams, prepare, table, "time_ms", f"{tmp_path}/c", after=lambda n, e: told.append(n)) == {"kp": None, "wind": None, "flux": None}
    assert rows_of(table) == WANT and sorted(told) == ["flux", "kp", "kp", "wind"]


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    fill(spark, tmp_path)
    for k, order in enumerate(itertools.permutations(["kp", "wind", "flux"])):
        table = S.VersionedTable(spark, f"file://{tmp_path}/table{k}", TABLE, 3)
        for name in order:
            streams, prepare = legs(spark, tmp_path)
            S.poll({name: streams[name]}, prepare, table, "time_ms", f"{tmp_path}/c{k}")
        assert rows_of(table) == WANT


def test_batches_that_come_again_and_compaction(spark, tmp_path):
    table = S.VersionedTable(spark, f"file://{tmp_path}/table", TABLE, 4)
    batch = lambda *r: spark.createDataFrame(r, TABLE)
    assert table.compact() == []
    for epoch in range(6):
        assert table.apply(batch((epoch % 2, float(epoch), None, None)), "a", epoch, "time_ms")
        assert not table.apply(batch((9, 9.0, 9.0, 9.0)), "a", epoch, "time_ms")
    assert table.versions() == [0, 1, 2, 3, 4, 5] and rows_of(table) == [(0, 4.0, None, None), (1, 5.0, None, None)]
    before = rows_of(table)
    folders = lambda: {n for n in table._listed(table.path) if n.startswith("v=")}
    named = {f.split("/")[0] for v in (4, 5) for f in table._manifest(v)["buckets"].values()}
    assert len(folders()) == 6 and table.compact(keep=2) and folders() == named  # versions 5 and 4, and what 4 still reads
    assert table.versions() == [4, 5] and rows_of(table) == before
    assert sorted((r.time_ms, r.kp) for r in table.read(4).collect()) == [(0, 4.0), (1, 3.0)]
    with pytest.raises(ValueError, match="no longer kept"):
        table.read(2)
    assert table.apply(batch((7, 7.0, None, None)), "b", 0, "time_ms") and len(rows_of(table)) == 3 and not table.apply(batch((7, 8.0, None, None)), "a", 5, "time_ms")


MIN = 60_000


def run_alerts(spark, tmp_path, batches):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "key string, kind string, event_id string, magnitude double, time_ms long, at_ms long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.ROCKS)
    try:
        for batch in batches:
            land(spark, src, batch, schema)
            stream = A.alert_changes(spark.readStream.schema(schema).parquet(src))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(A.ALERT).parquet(out)


def test_alerts_announce_dismiss_and_expire(spark, tmp_path):
    e = lambda key, i, m, t, at: (key, "event", i, m, t, at)
    batches = [
        [e("a", "x1", 6.0, 0, 10 * MIN), e("a", "x2", 6.5, 5 * MIN, 10 * MIN), e("a", "small", 5.0, 9 * MIN, 10 * MIN), e("b", "y1", 7.0, None, 10 * MIN), e("b", "y2", 5.8, 12 * MIN, 10 * MIN)],
        [e("a", "x2", 6.5, 5 * MIN, 20 * MIN), e("a", "x1", 6.0, 0, 20 * MIN)],  # the one left is announced now
        [("a", "dismiss", None, None, None, 30 * MIN), e("a", "x1", 6.0, 0, 30 * MIN), e("a", "x2", 6.5, 5 * MIN, 30 * MIN)],
        [e("b", "late", 9.0, 0, 400 * MIN)],  # older than 240 minutes; time passes for all keys
        [e("c", "z", 6.0, 400 * MIN, 401 * MIN)],
    ]
    changes = run_alerts(spark, tmp_path, batches)
    got = sorted((r.at_ms // MIN, r.key, r.change, r.event_id) for r in changes.collect())
    assert [g for g in got if g[2] == "announced"] == [(10, "a", "announced", "x2"), (10, "b", "announced", "y2"), (20, "a", "announced", "x1"), (401, "c", "announced", "z")]
    assert [g[1:] for g in got if g[2] == "dismissed"] == [("a", "dismissed", "x1")] and [g[1:] for g in got if g[2] == "expired"] == [("b", "expired", "y2")]
    assert [(r.key, r.event_id) for r in A.current_alerts(changes).orderBy("key").collect()] == [("c", "z")]


def test_digest_on_start(spark):
    events = spark.createDataFrame([(i, 1000 + i, m) for i, m in enumerate([5.8, 5.7, 7.0, 7.0, 6.0] + [5.9] * 12)], "event_id long, time_ms long, magnitude double")
    state = lambda *r: spark.createDataFrame(r, "key string, value string, updated_ms long")
    assert A.digest(events, state()).collect() == [] and A.digest(events, state(("seen_through", "nonsense", 1))).collect() == []
    assert A.digest(events, state(("seen_through", "5000", 1))).collect() == []
    found, after = A.on_start(events, state(("seen_through", "1000", 1), ("other", "1", 1)), 9000)
    row = found.first()
    assert (row.since_ms, row.total, len(row.events)) == (1000, 15, K.MISSED_LIMIT)  # the event at the mark was seen
    assert [e.event_id for e in row.events][:4] == [3, 2, 4, 16]
    assert {(r.key, r.value) for r in after.collect()} == {("seen_through", "9000"), ("other", "1")}
    assert A.digest(events, after).collect() == []


def test_snapshots(spark, tmp_path):
    now, calls, broken = [0], [], []

    def fetch():
        calls.append(now[0])
        if broken:
            raise OSError("no answer")
        return spark.createDataFrame([(now[0],)], "v long")

    cache = A.Snapshots(spark, f"file://{tmp_path}/tec", fetch, 600, lambda: now[0], keep=2)
    broken.append(1)
    assert cache.latest() is None and "no answer" in cache.error
    broken.clear()
    got = []
    askers = [threading.Thread(target=lambda: got.append(cache.latest()[0])) for _ in range(4)]
    [t.start() for t in askers], [t.join() for t in askers]
    assert got == [0] * 4 and len(calls) == 2  # one failed, one shared
    now[0] = 599
    assert cache.latest()[0] == 0 and len(calls) == 2
    now[0] = 600
    at, df = cache.latest()
    assert at == 600 and df.first().v == 600 and cache.error is None
    broken.append(1)
    now[0] = 5000
    assert cache.latest()[0] == 600 and cache.error
    broken.clear()
    for t in (6000, 7000):
        now[0] = t
        cache.latest()
    assert cache.held() == [6000, 7000]
    assert A.Snapshots(spark, f"file://{tmp_path}/tec", fetch, 600, lambda: 7100).latest()[0] == 7000
