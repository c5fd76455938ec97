"""Paged loading and backfills, over functions that keep a log of what was asked for."""

import json
import os
import threading
import uuid
from collections import Counter
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tremor.sources import archive as A

NOW = int(datetime(2003, 6, 1, tzinfo=timezone.utc).timestamp() * 1000)
TIERS = ((1999, 2000, 7.0), (2001, None, 4.5))


def at(year, day=0):
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp() * 1000) + day * 86_400_000


def feature(k, ms, mag):
    return {"id": f"e{k}", "properties": {"mag": mag, "time": ms, "updated": ms}, "geometry": {"coordinates": [1.0, 2.0, None]}}


EVENTS = [feature(k, at(1998 + k // 12, (k % 12) * 30), 4.0 + k % 5) for k in range(12 * 6)]  # the first of each year at its very start


def service(log, broken=""):
    """Pages of EVENTS; years listed in the file `broken` fail, `<year>:<n>` only the first n times."""
    events = json.dumps(EVENTS)

    def fetch(start_ms, end_ms, floor, limit, offset):
        import json as j
        import os as o
        import uuid as u
        from datetime import datetime as d, timezone as z

        year = d.fromtimestamp(start_ms / 1000, z.utc).year
        o.mkdir(f"{log}/{year}-{offset}-{u.uuid4().hex}")
        for spec in open(broken).read().split() if broken else []:
            which, _, times = spec.partition(":")
            if int(which) == year and (not times or len([x for x in o.listdir(log) if x.startswith(f"{year}-")]) <= int(times)):
                raise OSError("service is down")
        found = [f for f in j.loads(events) if start_ms <= f["properties"]["time"] <= end_ms and f["properties"]["mag"] >= floor]
        return sorted(found, key=lambda f: f["properties"]["time"])[offset - 1 : offset - 1 + limit]

    return fetch


def asked(log):
    return Counter(int(x[:4]) for x in os.listdir(log))


def want(year, floor):
    return {f["id"] for f in EVENTS if at(year) <= f["properties"]["time"] < at(year + 1) and f["properties"]["mag"] >= floor}


def held(archive):
    out = {}
    for r in archive.events().select("year", "min_magnitude", "event_id").collect():
        out.setdefault((r.year, r.min_magnitude), set()).add(r.event_id)
    return out


@pytest.fixture
def place(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "broken").write_text("")
    return tmp_path


def run(spark, place, **more):
    archive = A.Archive(spark, f"file://{place}/archive")
    given = {"tiers": TIERS, "page_rows": 4, "delay_seconds": 0.0} | more
    return archive, A.backfill(archive, service(f"{place}/log", f"{place}/broken"), NOW, **given)


def test_plan():
    assert [(c.year, c.min_magnitude) for c in A.planned(NOW, TIERS)] == [(1999, 7.0), (2000, 7.0), (2001, 4.5), (2002, 4.5), (2003, 4.5)]
    every = A.planned(NOW)
    assert every[0].year == 1900 and every[69].year == 1969 and every[70] == A.Chunk(1970, 4.5) and every[-1].year == 2003
    assert A.Chunk(2000, 1.0).end_ms - A.Chunk(2000, 1.0).start_ms == 366 * 86_400_000


def test_whole_backfill_and_a_second_one(spark, place):
    archive, p = run(spark, place)
    assert (p.state, p.completed, p.total, p.error) == ("complete", 4, 5, None) and p.years == [1999, 2000, 2001, 2002, 2003]
    expected = {(c.year, c.min_magnitude): want(c.year, c.min_magnitude) for c in A.planned(NOW, TIERS)}
    assert held(archive) == {k: v for k, v in expected.items() if v}
    ledger = {(r.year, r.min_magnitude): r.event_count for r in archive.ledger().collect()}
    assert ledger == {k: len(v) for k, v in expected.items() if k[0] < 2003}  # this year is never complete
    assert p.stored == sum(ledger.values())
    first = asked(f"{place}/log")
    assert first[2001] == len(want(2001, 4.5)) // 4 + 1  # a page that is full is not the last
    archive, p = run(spark, place)
    assert p.state == "complete" and p.years == [2003] and held(archive) == {k: v for k, v in expected.items() if v}
    assert {y: n - first[y] for y, n in asked(f"{place}/log").items() if n > first[y]} == {2003: first[2003]}


def test_failed_years_leave_nothing_and_resume(spark, place):
    (place / "broken").write_text("2000")
    archive, p = run(spark, place, chunks_per_wave=3)
    assert p.state == "failed" and "2000 failed after 3 attempts" in p.error and p.years == [1999, 2001]
    assert asked(f"{place}/log")[2000] == 3 and set(held(archive)) == {(1999, 7.0), (2001, 4.5)} and not asked(f"{place}/log")[2002]
    (place / "broken").write_text("2000:4")  # down once more, then well
    before = asked(f"{place}/log")
    archive, p = run(spark, place)
    assert p.state == "complete" and p.years == [2000, 2002, 2003]
    after = asked(f"{place}/log")
    assert after[1999] == before[1999] and after[2001] == before[2001] and after[2000] > before[2000]
    assert held(archive)[2000, 7.0] == want(2000, 7.0)


def test_killed_and_cancelled_runs_go_on(spark, place):
    calls = []

    def stop():
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt  # as if the driver were killed between waves
        return False

    with pytest.raises(KeyboardInterrupt):
        run(spark, place, chunks_per_wave=1, cancelled=stop)
    before = asked(f"{place}/log")
    assert set(before) == {1999, 2000}
    archive, p = run(spark, place, cancelled=lambda: True)
    assert p.state == "cancelled" and p.completed == 2 and asked(f"{place}/log") == before
    archive, p = run(spark, place)
    assert p.state == "complete" and p.years == [2001, 2002, 2003] and asked(f"{place}/log")[1999] == before[1999]


def test_floors(spark, place):
    run(spark, place, tiers=((2001, 2001, 7.0),))
    n = asked(f"{place}/log")[2001]
    archive, p = run(spark, place, tiers=((2001, 2001, 4.5),))  # a year held above 7 is not held above 4.5
    assert p.years == [2001] and asked(f"{place}/log")[2001] > n and set(held(archive)) == {(2001, 7.0), (2001, 4.5)}
    archive, p = run(spark, place, tiers=((2001, 2001, 6.0),))  # but above 4.5 is above 6
    assert p.years == [] and p.state == "complete"


def test_revisions_replace_and_nothing_is_taken_out(spark, place):
    archive = A.Archive(spark, f"file://{place}/archive")
    chunk = A.Chunk(2003, 4.5)
    raw = lambda *f: spark.createDataFrame([(json.dumps({"features": list(f)}), 2003, 4.5)], "value string, year int, min_magnitude double")
    parsed = lambda df: A.usgs_events(df, "value", "year", "min_magnitude")
    archive.save(parsed(raw(feature(1, at(2003), 5.0), feature(2, at(2003), 6.0))), [chunk])
    archive.save(parsed(raw(feature(1, at(2003), 5.5))), [chunk])
    assert {r.event_id: r.magnitude for r in archive.events().collect()} == {"e1": 5.5, "e2": 6.0}


def test_file_pages_equal_the_service(spark, place):
    rows = [(f["properties"]["time"], f["properties"]["mag"], json.dumps(f)) for f in EVENTS]
    df = spark.createDataFrame(rows, "time_ms long, magnitude double, feature string").withColumn("year", F.year(F.timestamp_millis("time_ms")))
    df.repartition(3).write.partitionBy("year").parquet(f"file://{place}/mirror")
    files, plain = A.file_pages(f"file://{place}/mirror"), service(f"{place}/log")
    for c in A.planned(NOW, TIERS):
        for offset, limit in ((1, 4), (5, 4), (1, 100), (99, 4)):
            assert files(c.start_ms, c.end_ms, c.min_magnitude, limit, offset) == plain(c.start_ms, c.end_ms, c.min_magnitude, limit, offset)


def test_http_pages(spark, place):
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            ms = [int(datetime.fromisoformat(q[k].replace("Z", "+00:00")).timestamp() * 1000) for k in ("starttime", "endtime")]
            found = service(f"{place}/log")(*ms, float(q["minmagnitude"]), int(q["limit"]), int(q["offset"]))
            status = 500 if q["limit"] == "7" else 200 if found else 204
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps({"features": found}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch = A.http_pages(f"http://127.0.0.1:{server.server_port}/query")
        assert [f["id"] for f in fetch(at(2001), at(2002), 4.5, 3, 1)] == [f["id"] for f in service(f"{place}/log")(at(2001), at(2002), 4.5, 3, 1)]
        assert fetch(at(2001), at(2002), 4.5, 3, 500) == []
        assert seen[0]["starttime"] == "2001-01-01T00:00:00.000Z" and seen[0]["orderby"] == "time-asc" and seen[0]["format"] == "geojson"
        with pytest.raises(Exception, match="500"):
            fetch(at(2001), at(2002), 4.5, 7, 1)
        archive = A.Archive(spark, f"file://{place}/archive-{uuid.uuid4().hex}")
        p = A.backfill(archive, fetch, NOW, tiers=TIERS, page_rows=4, delay_seconds=0.0)
        assert p.state == "complete" and held(archive)[2002, 4.5] == want(2002, 4.5)
    finally:
        server.shutdown()


def test_small_pages_of_a_mirror_read_it_about_once(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    rows = [(at(2001, (k * 37) % 90), 4.0 + k % 5, json.dumps({"id": k})) for k in range(3000)]
    for part, some in enumerate((rows[::2], rows[1::2])):
        (tmp_path / "year=2001").mkdir(exist_ok=True)
        pq.write_table(pa.table({"time_ms": [r[0] for r in some], "magnitude": [r[1] for r in some], "feature": [r[2] for r in some]}), tmp_path / "year=2001" / f"{part}.parquet")
    reads, real = [], ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda *a, **k: reads.append(1) or real(*a, **k))
    fetch, got, offset = A.file_pages(f"file://{tmp_path}"), [], 1
    while page := fetch(at(2001), at(2001, 60), 5.0, 100, offset):
        got += page
        offset += len(page)
    assert [f["id"] for f in got] == [json.loads(f)["id"] for t, _, f in sorted((r for r in rows if r[0] <= at(2001, 60) and r[1] >= 5.0), key=lambda r: (r[0], r[2]))]
    assert len(got) > 1500 and len(reads) <= 4
    assert fetch(at(2001), at(2001, 60), 5.0, 7, 3) == got[2:9] and fetch(at(2002), at(2003), 5.0, 7, 1) == []
