"""Parsers of the published feeds: text or JSON columns in, frames of fixed columns out. All are column expressions.

A feed is landed as files first; readers take a frame with the raw lines or documents, so batch and streaming share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GEOJSON = "struct<features:array<struct<id:string,properties:struct<mag:double,magType:string,place:string,time:bigint,updated:bigint,url:string,status:string,alert:string,tsunami:int,sig:int>,geometry:struct<coordinates:array<double>>>>>"
EMSC = "struct<features:array<struct<properties:struct<unid:string,time:string,lastupdate:string,mag:double,magtype:string,flynn_region:string,lat:double,lon:double,depth:double>>>>"


def usgs_events(raw: DataFrame, body: str = "value", *kept: str) -> DataFrame:
    """Feature collections to events, with columns of the raw rows that are to be kept; an unknown depth stays null."""
    f = raw.select(*kept, F.explode(F.from_json(body, GEOJSON)["features"]).alias("f")).select(*kept, "f.id", "f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    return f.select(
        *kept,
        F.col("id").alias("event_id"), F.lit("usgs").alias("source"), F.coalesce("mag", F.lit(0.0)).alias("magnitude"), F.coalesce("magType", F.lit("unknown")).alias("magnitude_type"),
        F.coalesce("place", F.lit("Unknown location")).alias("place"), F.timestamp_millis("time").alias("time_utc"), F.timestamp_millis("updated").alias("updated_utc"), F.get("c", F.lit(0)).alias("longitude"), F.get("c", F.lit(1)).alias("latitude"),
        F.get("c", F.lit(2)).alias("depth_km"), "status", (F.coalesce("tsunami", F.lit(0)) == 1).alias("tsunami"), F.col("alert").alias("alert_level"), F.col("sig").alias("significance"), "url",
    )


def emsc_events(raw: DataFrame, body: str = "value") -> DataFrame:
    """The second network's collections; here an unknown depth becomes 0."""
    p = raw.select(F.explode(F.from_json(body, EMSC)["features"]).alias("f")).select("f.properties.*")
    return p.select(
        F.concat(F.lit("emsc:"), "unid").alias("event_id"), F.lit("emsc").alias("source"), F.coalesce("mag", F.lit(0.0)).alias("magnitude"), F.coalesce("magtype", F.lit("unknown")).alias("magnitude_type"), F.coalesce("flynn_region", F.lit("Unknown location")).alias("place"),
        F.to_timestamp("time").alias("time_utc"), F.to_timestamp(F.coalesce("lastupdate", "time")).alias("updated_utc"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.coalesce("depth", F.lit(0.0)).alias("depth_km"),
        F.lit(None).cast("string").alias("status"), F.lit(False).alias("tsunami"), F.lit(None).cast("string").alias("alert_level"), F.lit(None).cast("int").alias("significance"), F.lit("").alias("url"),
    )


def hour_of_year(year: Column, day: Column, hour: Column) -> Column:
    start = F.make_timestamp(year, *[F.lit(x) for x in (1, 1, 0, 0, 0)])
    return F.timestamp_add("HOUR", ((day - 1) * 24 + hour).cast("int"), start)


def omni_hours(lines: DataFrame, body: str = "value") -> DataFrame:
    """Hourly indices of 45 fields or more; each field has its own fill value; rows with nothing measured go."""
    f = F.split(F.trim(F.col(body)), r"\s+")
    rows = lines.select(f.alias("f")).where(F.size("f") >= 45)
    head = [F.get("f", F.lit(k)).try_cast("int") for k in range(3)]
    # Columns and fills of the format.
    field = lambda k, fill: F.nullif(F.get("f", F.lit(k)).try_cast("double"), F.lit(fill))
    out = rows.select(hour_of_year(*head).alias("time_utc"), field(40, 99999.0).cast("int").alias("dst"), field(24, 9999.0).alias("wind_speed"), field(23, 999.9).alias("density"), field(16, 999.9).alias("bz_gsm"))
    return out.where(F.col("time_utc").isNotNull() & F.coalesce("dst", "wind_speed", "density", "bz_gsm").isNotNull())


def kp_hours(lines: DataFrame, body: str = "value") -> DataFrame:
    """Eight three-hour values a line of 28 fields, each as three hours; -1 is unmeasured."""
    f = F.split(F.trim(F.col(body)), r"\s+")
    rows = lines.where(~F.startswith(F.ltrim(body), F.lit("#"))).select(f.alias("f")).where(F.size("f") == 28)
    day = F.make_timestamp(*[F.get("f", F.lit(k)).try_cast("int") for k in range(3)], *[F.lit(0)] * 3)
    values = rows.select(day.alias("day"), F.posexplode(F.slice("f", 8, 8)).alias("k", "v")).withColumn("h", F.explode(F.array(*[F.lit(h) for h in range(3)])))
    kp = F.col("v").try_cast("double")
    return values.where((kp >= 0) & F.col("day").isNotNull()).select(F.timestamp_add("HOUR", (F.col("k") * 3 + F.col("h")).cast("int"), F.col("day")).alias("time_utc"), kp.alias("kp"))


def solar_wind_hours(raw: DataFrame, body: str = "value") -> DataFrame:
    """Arrays with a header row, columns by name; hourly means to one decimal, halves up; hours with nothing go."""
    rows = raw.select(F.from_json(body, "array<array<string>>").alias("a")).select(F.get("a", F.lit(0)).alias("names"), F.explode(F.slice("a", 2, 1 << 30)).alias("r"))
    named = rows.select(F.map_from_arrays("names", F.slice("r", F.lit(1), F.size("names"))).alias("m"))
    value = lambda n: F.try_element_at("m", F.lit(n)).try_cast("double")
    flat = named.select(F.date_trunc("hour", F.try_to_timestamp(F.try_element_at("m", F.lit("time_tag")))).alias("time_utc"), value("speed").alias("s"), value("density").alias("d"))
    mean = lambda c: F.floor(F.avg(c) * 10 + 0.5) / 10
    return flat.where("time_utc is not null").groupBy("time_utc").agg(mean("s").alias("wind_speed"), mean("d").alias("density")).where("wind_speed is not null or density is not null")


def xray_hours(raw: DataFrame, body: str = "value") -> DataFrame:
    """The long channel's greatest positive flux an hour."""
    rows = raw.select(F.explode(F.from_json(body, "array<struct<time_tag:string,flux:double,energy:string>>")).alias("x")).select("x.*")
    return rows.where("energy = '0.1-0.8nm' and flux > 0 and not isnan(flux)").groupBy(F.date_trunc("hour", F.to_timestamp("time_tag")).alias("time_utc")).agg(F.max("flux").alias("xray_flux"))


def flare_class(text: Column) -> tuple[Column, Column]:
    t = F.upper(F.trim(text))
    pattern = r"^([ABCMX])(\d+(?:\.\d+)?)$"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2).try_cast("double"))


def iso_time(text: Column) -> Column:
    """Times that may lack seconds, as in 2024-01-01T00:00Z; null for what is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"T(\d\d:\d\d)Z$", "T$1:00Z"))


def donki_flares(raw: DataFrame, body: str = "value") -> DataFrame:
    kind = "array<struct<flrID:string,classType:string,beginTime:string,peakTime:string,endTime:string,sourceLocation:string,activeRegionNum:int,link:string>>"
    x = raw.select(F.explode(F.from_json(body, kind)).alias("x")).select("x.*")
    cls, mag = flare_class(F.col("classType"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = x.select(F.col("flrID").alias("id"), F.lit("donki").alias("source"), F.col("classType").alias("class_type"), cls.alias("flare_class"), mag.alias("magnitude"), *(iso_time(F.col(f"{k}Time")).alias(f"{k}_time_utc") for k in ("peak", "begin", "end")), blank("sourceLocation").alias("source_location"), F.col("activeRegionNum").alias("active_region_number"), blank("link").alias("link"))
    return out.where("id is not null and peak_time_utc is not null and flare_class is not null")


def donki_cmes(raw: DataFrame, body: str = "value") -> DataFrame:
    x = raw.select(F.explode(F.from_json(body, "array<struct<simulationID:string,estimatedShockArrivalTime:string,kp_90:double,isEarthGB:boolean,isEarthMinorImpact:boolean,link:string>>")).alias("x")).select("x.*")
    out = x.select(F.col("simulationID").alias("simulation_id"), iso_time(F.col("estimatedShockArrivalTime")).alias("arrival_time_utc"), F.col("kp_90").alias("predicted_kp"), F.coalesce("isEarthGB", F.lit(False)).alias("glancing_blow"), F.coalesce("isEarthMinorImpact", F.lit(False)).alias("minor_impact"), "link")
    return out.where("simulation_id is not null and arrival_time_utc is not null")


def stations(raw: DataFrame, body: str = "value") -> DataFrame:
    """Observatories without test sites; longitudes above 180 brought below."""
    f = raw.select(F.explode(F.from_json(body, "struct<features:array<struct<id:string,properties:struct<name:string>,geometry:struct<coordinates:array<double>>>>>")["features"]).alias("f"))
    lon = F.get("f.geometry.coordinates", F.lit(0))
    return f.where(~F.coalesce(F.lower("f.properties.name").rlike(r"\btest\b"), F.lit(False))).select(F.col("f.id").alias("station"), F.col("f.properties.name").alias("name"), F.when(lon > 180, lon - 360).otherwise(lon).alias("longitude"), F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"))


def disturbances(readings: DataFrame) -> DataFrame:
    """(station, range, n, last) from finite readings (station, time_ms, value), two at least."""
    ok = readings.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return ok.groupBy("station").agg((F.max("value") - F.min("value")).alias("range_nt"), F.count("*").alias("n"), F.max("time_ms").alias("last_ms")).where("n >= 2")


def tec_cells(points: DataFrame) -> DataFrame:
    """Points (longitude, latitude, seq, value) onto 72 by 72 cells of 5 by 2.5 degrees; the last write wins."""
    at = points.withColumn("col", F.floor((F.col("longitude") + 180) / 5)).withColumn("row", F.floor((90 - F.col("latitude")) / 2.5))
    return at.where("col between 0 and 71 and row between 0 and 71").groupBy("row", "col").agg(F.max_by("value", "seq").alias("value"))


def aurora_cells(points: DataFrame) -> DataFrame:
    """360 by 181 cells; values rounded into 0..255."""
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("value") + 0.5)))
    return points.select((90 - F.col("latitude")).cast("int").alias("row"), F.pmod(F.col("longitude") + 180, F.lit(360)).cast("int").alias("col"), value.cast("int").alias("value"))


AURORA_CELLS = 360 * 181


def aurora_grid(points: DataFrame) -> DataFrame:
    """aurora_cells of a whole grid: any other number of points is an error when the result is read."""
    counted = points.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") != AURORA_CELLS, F.raise_error(F.lit(f"not {AURORA_CELLS} cells"))).cast("string").alias("_bad"))
    return aurora_cells(points).join(F.broadcast(counted)).where("_bad is null").drop("_bad")


def keep_richest(flares: DataFrame, order: str) -> DataFrame:
    """Of rows with one id, the one with most of location, region and end time; the first on ties."""
    rich = F.col("source_location").isNotNull().cast("int") + F.col("active_region_number").isNotNull().cast("int") + F.col("end_time_utc").isNotNull().cast("int")
    return flares.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(rich.desc(), order))).where("_r = 1").drop("_r")


def moment_magnitude(moment_dyne_cm: Column) -> Column:
    return 2 / 3 * (F.log10(moment_dyne_cm) - 16.1)


# First character and length of each field of a flare report's line.
REPORT = {"date": (6, 6), "start": (14, 4), "end": (19, 4), "peak": (24, 4), "position": (29, 16), "letter": (60, 1), "tenths": (61, 4), "region": (81, 6)}


def goes_flares(lines: DataFrame, body: str = "value", expected_year: int | None = None) -> DataFrame:
    """A yearly report of fixed columns to flares; of lines that name one flare the richer stays.

    lines may have `line_no`, the order that breaks ties. Times of day run to 24:00; a flare that ends before it starts crosses
    midnight, and only such a one may peak before it starts. Lines that break a rule are left out.
    """
    cut = {k: F.substring(body, a, n) for k, (a, n) in REPORT.items()}
    if "line_no" not in lines.columns:
        lines = lines.withColumn("line_no", F.monotonically_increasing_id())
    rows = lines.select("line_no", *(F.trim(c).alias(k) if k in ("position", "tenths", "region") else c.alias(k) for k, c in cut.items()))
    rows = rows.where(F.col("tenths").rlike(r"^\d{1,3}$") & F.col("letter").rlike("^[ABCMXabcmx]$") & F.col("date").rlike(r"^\d{6}$"))
    short = F.substring("date", 1, 2).cast("int")
    rows = rows.withColumn("year", F.when(short >= 75, 1900 + short).otherwise(2000 + short))
    month, day = F.substring("date", 3, 2).cast("int"), F.substring("date", 5, 2).cast("int")
    rows = rows.where(month.between(1, 12) & day.between(1, 31))
    if expected_year is not None:
        rows = rows.where(F.col("year") == expected_year)
    midnight = F.timestamp_add("DAY", day - 1, F.make_timestamp(F.col("year"), month, *[F.lit(x) for x in (1, 0, 0, 0)]))
    hours, minutes = (lambda c: F.substring(c, 1, 2).try_cast("int")), (lambda c: F.substring(c, 3, 2).try_cast("int"))
    of_day = lambda c: F.when(F.col(c).rlike(r"^\d{4}$") & (hours(c) <= 24) & (minutes(c) <= 59), hours(c) * 60 + minutes(c))
    rows = rows.withColumns({"day": midnight, **{f"{k}_m": of_day(k) for k in ("start", "end", "peak")}})
    crosses = F.coalesce(F.col("end_m") < F.col("start_m"), F.lit(False))
    rows = rows.where(F.col("start_m").isNotNull() & F.col("peak_m").isNotNull() & (crosses | (F.col("peak_m") >= F.col("start_m"))))
    at = lambda k: F.timestamp_add("MINUTE", F.col(f"{k}_m") + F.when(F.col(f"{k}_m") < F.col("start_m"), 1440).otherwise(0), F.col("day"))
    n = F.col("tenths").cast("int")
    cls = F.concat(F.upper("letter"), F.expr("cast(tenths as int) div 10").cast("string"), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("."), (n % 10).cast("string"))))
    out = rows.select(
        F.concat(F.lit("goes:"), F.date_format(at("peak"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("-"), cls).alias("id"), F.lit("goes").alias("source"), cls.alias("class_type"), F.upper("letter").alias("flare_class"), (n / 10).alias("magnitude"),
        at("peak").alias("peak_time_utc"), at("start").alias("begin_time_utc"), at("end").alias("end_time_utc"), F.nullif("position", F.lit("")).alias("source_location"), F.when(F.col("region").rlike(r"^\d+$"), F.col("region").try_cast("int")).alias("active_region_number"), F.lit(None).cast("string").alias("link"), "line_no",
    )
    return keep_richest(out, "line_no").drop("line_no").orderBy("peak_time_utc")
