import json

from pyspark.sql import functions as F

from tremor.sources import feeds
from tremor.streaming import feeds as streams


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_geojson(spark):
    doc = json.dumps({"features": [{"id": "a", "properties": {"mag": None, "time": 1500, "updated": 2500, "url": "u", "tsunami": 1, "sig": 3}, "geometry": {"coordinates": [1.5, 2.5, None]}}]})
    r = feeds.usgs_events(frame(spark, doc)).first()
    assert (r.event_id, r.magnitude, r.magnitude_type, r.place, r.longitude, r.depth_km, r.tsunami) == ("a", 0.0, "unknown", "Unknown location", 1.5, None, True)
    doc = json.dumps({"features": [{"properties": {"unid": "x", "time": "2024-01-01T00:00:00Z", "mag": 5.0, "lat": 1.0, "lon": 2.0, "depth": None}}]})
    r = feeds.emsc_events(frame(spark, doc)).first()
    assert (r.event_id, r.depth_km, r.updated_utc == r.time_utc) == ("emsc:x", 0.0, True)


def test_omni_and_kp(spark):
    f = ["0"] * 55
    f[0:3] = ["1970", "32", "5"]
    f[16], f[23], f[24], f[40] = "-1.5", "999.9", "450.", "99999"
    empty = list(f)
    empty[16], empty[24] = "999.9", "9999."
    got = feeds.omni_hours(frame(spark, " ".join(f), " ".join(empty), "short line")).collect()
    assert len(got) == 1 and (got[0].dst, got[0].wind_speed, got[0].density, got[0].bz_gsm) == (None, 450.0, None, -1.5) and got[0].time_utc.isoformat() == "1970-02-01T05:00:00"
    line = "2024 01 02 0 0 0 0 " + "1.333 -1 " + "2 " * 6 + "0 " * 13
    got = feeds.kp_hours(frame(spark, "# head", line)).orderBy("time_utc").collect()
    assert len(got) == 21 and got[0].kp == 1.333 and got[3].time_utc.isoformat() == "2024-01-02T06:00:00"


def test_wind_xray_and_flares(spark):
    rows = [["time_tag", "density", "speed"], ["2024-01-01 00:01:00", "1.25", "400"], ["2024-01-01 00:02:00", None, "401"], ["2024-01-01 01:00:00", "bad", None]]
    got = feeds.solar_wind_hours(frame(spark, json.dumps(rows))).collect()
    assert [(r.wind_speed, r.density) for r in got] == [(400.5, 1.3)]
    x = [{"time_tag": "2024-01-01T00:01:00Z", "flux": f, "energy": e} for f, e in ((1e-6, "0.1-0.8nm"), (2e-6, "0.1-0.8nm"), (9e-6, "0.05-0.4nm"), (0.0, "0.1-0.8nm"))]
    assert feeds.xray_hours(frame(spark, json.dumps(x))).first().xray_flux == 2e-6
    fl = [{"flrID": "1", "classType": " m5.2", "peakTime": "2024-01-01T00:00Z"}, {"flrID": None, "classType": "X1", "peakTime": "2024-01-01T00:00Z"}, {"flrID": "3", "classType": "?", "peakTime": "2024-01-01T00:00Z"}]
    r = feeds.donki_flares(frame(spark, json.dumps(fl))).collect()
    assert [(q.id, q.flare_class, q.magnitude) for q in r] == [("1", "M", 5.2)]


def report_line(date, start, end, peak, position, letter, tenths, region):
    line = [" "] * 90
    for at, text in ((5, date), (13, start), (18, end), (23, peak), (28, position), (59, letter), (60, tenths), (80, region)):
        line[at : at + len(text)] = text
    return "".join(line)


def test_goes_report(spark):
    lines = [
        report_line("150101", "0457", "0517", "0507", "S07E50", "C", " 21", ""), report_line("150101", "0457", "0517", "0507", "S07E50", "C", " 21", "12345"), report_line("151231", "2350", "0010", "0001", "", "X", "280", ""),
        report_line("150102", "0500", "0510", "0459", "", "M", " 10", ""), report_line("150102", "0500", "    ", "0505", "", "M", "    ", ""), report_line("960102", "0500", "2400", "0505", "", "B", "  5", ""), "short",
    ]
    got = feeds.goes_flares(frame(spark, *lines)).collect()
    assert [(r.id, r.active_region_number) for r in got] == [("goes:1996-01-02T05:05:00.000Z-B0.5", None), ("goes:2015-01-01T05:07:00.000Z-C2.1", 12345), ("goes:2016-01-01T00:01:00.000Z-X28", None)]
    assert got[0].end_time_utc.isoformat() == "1996-01-03T00:00:00" and got[2].end_time_utc.isoformat() == "2016-01-01T00:10:00"
    assert feeds.goes_flares(frame(spark, *lines), expected_year=2015).count() == 2


def test_stream_upsert_reruns_and_late_rows(spark, tmp_path):
    schema = "event_id long, time_utc timestamp, magnitude double"
    src = tmp_path / "in"
    spark.createDataFrame([(1, 5.0), (2, 6.0)], "event_id long, m double").select("event_id", F.timestamp_seconds(F.lit(1000)).alias("time_utc"), F.col("m").alias("magnitude")).coalesce(1).write.parquet(str(src))
    table = streams.VersionedTable(spark, f"file://{tmp_path}/table", schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    streams.upsert(stream(), table, "event_id", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, 7.0), (3, 5.9)], "event_id long, m double").select("event_id", F.timestamp_seconds(F.lit(500)).alias("time_utc"), F.col("m").alias("magnitude")).coalesce(1).write.mode("append").parquet(str(src))
    streams.upsert(stream(), table, "event_id", str(tmp_path / "c")).awaitTermination()
    assert sorted((r.event_id, r.magnitude) for r in table.read().collect()) == [(1, 5.0), (2, 7.0), (3, 5.9)]
    assert table.versions() == [1, 2] and sorted((r.event_id, r.magnitude) for r in table.read(1).collect()) == [(1, 5.0), (2, 6.0)]
    changed = {n for n in table._listed(f"{table.path}/v={2:012d}") if n.startswith("bucket=")}
    assert 1 <= len(changed) <= 2  # of ids 2 and 3; the bucket of id 1 stays as it was, unless they share it
    q = streams.alerts(stream()).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "a")).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("alerts").collect()) == [2, 3]


def test_hours_and_trailing_windows_of_a_stream(spark, tmp_path):
    rows = [(0, 10.0), (1800, 11.06), (3599, 12.0), (3600, 1.0), (90_000, 5.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "s long, magnitude double").select(F.timestamp_seconds("s").alias("time_utc"), "magnitude").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("time_utc timestamp, magnitude double").parquet(src)
    for name, df in (("hours", streams.hourly(stream, "time_utc", "magnitude")), ("trail", streams.trailing(stream, "time_utc"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted((r.hour.timestamp(), r.magnitude_mean, r.magnitude_max) for r in spark.table("hours").collect()) == [(0.0, 11.0, 12.0), (3600.0, 1.0, 1.0), (90000.0, 5.0, 5.0)]
    got = {r.until.timestamp(): (r.n, r.max_magnitude) for r in spark.table("trail").collect()}
    want = {}
    for k in range(1, 50):
        inside = [m for s, m in rows if (k - 24) * 3600 <= s < k * 3600]
        if inside:
            want[k * 3600.0] = (len(inside), max(inside))
    assert got == want


def test_cells_and_stations(spark):
    points = spark.createDataFrame([(-180.0, 90.0, 1, 5.0), (-179.0, 89.0, 2, 6.0), (179.9, -89.9, 3, 7.0), (180.0, 0.0, 4, 8.0)], "longitude double, latitude double, seq int, value double")
    assert sorted(tuple(r) for r in feeds.tec_cells(points).collect()) == [(0, 0, 6.0), (71, 71, 7.0)]
    doc = json.dumps({"features": [{"id": "A", "properties": {"name": "Alpha"}, "geometry": {"coordinates": [190.0, 5.0]}}, {"id": "B", "properties": {"name": "A Test site"}, "geometry": {"coordinates": [1.0, 2.0]}}]})
    assert [tuple(r) for r in feeds.stations(frame(spark, doc)).collect()] == [("A", "Alpha", -170.0, 5.0)]
    cmes = json.dumps([{"simulationID": "1", "estimatedShockArrivalTime": "2024-01-01T00:00Z", "kp_90": 5.0}, {"simulationID": None, "estimatedShockArrivalTime": "2024-01-01T00:00Z"}])
    assert [(r.simulation_id, r.predicted_kp, r.glancing_blow) for r in feeds.donki_cmes(frame(spark, cmes)).collect()] == [("1", 5.0, False)]
