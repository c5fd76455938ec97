"""Records of five lines, and what displays make of odd values."""

import math

from pyspark.sql import functions as F

from tremor.functions import views as V
from tremor.sources.mechanisms import mechanisms


def record(name="C202401010000A", date="2024/01/01", time="00:00:10.5", lat=" 10.00", lon="  20.00", depth=" 15.0", exponent="25", moment="  1.500", planes="10 20 30 40 50 -60", centroid=True):
    line = [[" "] * 90 for _ in range(5)]

    def put(k, at, text):
        line[k][at : at + len(text)] = text

    put(0, 0, "PDEW"), put(0, 5, date), put(0, 16, time), put(0, 27, lat), put(0, 34, lon), put(0, 42, depth)
    put(1, 0, name), put(3, 0, exponent), put(4, 49, moment), put(4, 57, planes)
    if centroid:
        put(2, 22, "  11.00"), put(2, 34, "   21.00"), put(2, 47, "  16.0")
    return ["".join(x) for x in line]


def test_records_of_five_lines(spark):
    records = [
        record(), record("B", time="23:59:60.0", lon=" 180.00"), record("C", planes="10 20 30 40 50"), record("D", date="2024/13/01"), record("E", lat=" 91.00"), record("F", moment=" -1.000"), record("G", planes="10 95 30 40 50 60"), record(""),
        record("H", lat="  abc "), record("I", planes="360 90 -180 0 0 180", date="2023/12/31"), record("J", time="00:00:61.0"),
    ]
    lines = [x for r in records for x in r] + ["PDEW broken off", "x"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").repartition(3)
    good, skipped = mechanisms(df)
    rows = good.collect()
    assert [r.id for r in rows] == ["I", "C202401010000A", "B"] and skipped.first().skipped == 8
    a = rows[1]
    assert (a.time_ms, a.latitude, a.depth_km, a.centroid_latitude, a.strike1, a.rake2) == (1704067210500, 10.0, 15.0, 11.0, 10.0, -60.0)
    assert abs(a.magnitude - 2 / 3 * (math.log10(1.5e25) - 16.1)) < 1e-12 and a.reference_catalog == "PDEW"
    assert rows[2].time_ms == 1704067200000 + 86_400_000
    assert mechanisms(df.limit(0))[0].collect() == []


def test_labels_of_odd_values(spark):
    one = spark.range(1)
    nan, inf, null = F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")
    got = one.select(*(f(x).alias(f"x{i}") for i, (f, x) in enumerate([(V.flux_label, nan), (V.flux_label, inf), (V.flux_label, F.lit(5e-9)), (V.flux_label, F.lit(2.8e-3)), (V.elapsed_label, F.lit(-1.0)), (V.elapsed_label, F.lit(0.5)), (V.rate_label, null), (V.rate_label, F.lit(0.01)), (V.p_label, F.lit(0.00001)), (V.p_label, F.lit(0.25)), (V.is_emphasized, inf), (V.depth_class, null)]))).first()
    assert tuple(got) == ("—", "—", "<A0.5", "X28.0", "unknown", "30 min", "not yet elapsed", "0.3/mo", "p < 0.0001", "p = 0.2500", False, None)
