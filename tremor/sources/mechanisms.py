"""Focal mechanisms from records of five lines in fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.sources.feeds import moment_magnitude

# The line (from 0) and the first and last character (from 0, end exclusive) of each field.
FIELDS = {
    "catalog": (0, 0, 4), "date": (0, 5, 15), "time": (0, 16, 26), "latitude": (0, 27, 33), "longitude": (0, 34, 41), "depth": (0, 42, 47),
    "id": (1, 0, 16), "centroid_latitude": (2, 22, 29), "centroid_longitude": (2, 34, 42), "centroid_depth": (2, 47, 53),
    "exponent": (3, 0, 2), "moment": (4, 49, 56), "planes": (4, 57, 200),
}


def _number(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text).try_cast("double")).otherwise(F.lit(0.0))


def mechanisms(lines: DataFrame, body: str = "value", line_no: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(mechanisms by time, one row with how many records were skipped) from lines with their number within the file.

    A time may run to 60 seconds, which is the next minute. A record whose date, place, moment or planes cannot be read, or
    whose angles are out of range, is skipped; an unreadable centroid falls back to the hypocentre. Blank records count for
    nothing, nor does one that the file breaks off.
    """
    n = F.col(line_no)
    placed = lines.select(F.expr(f"{line_no} div 5").alias("record"), (n % 5).cast("int").alias("k"), F.col(body).alias("text"))
    records = placed.groupBy("record").agg(*(F.max(F.when(F.col("k") == k, F.col("text"))).alias(f"l{k}") for k in range(5)), F.count("*").alias("n")).where((F.col("n") == 5) & (F.trim("l0") != ""))
    cut = records.select(*(F.substring(f"l{line}", a + 1, b - a).alias(name) for name, (line, a, b) in FIELDS.items()))
    time = F.regexp_extract_all(F.trim("time"), F.lit(r"^(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)$"), F.lit(0))
    part = lambda k: F.regexp_extract(F.trim("time"), r"^(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)$", k).try_cast("double")
    day = F.try_to_timestamp(F.replace(F.col("date"), F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd"))
    read = cut.select(
        F.trim("id").alias("id"), F.trim("catalog").alias("reference_catalog"),
        F.when((F.size(time) == 1) & (part(1) <= 23) & (part(2) <= 59) & (part(3) <= 60), F.unix_millis(day) + ((part(1) * 3600 + part(2) * 60 + part(3)) * 1000).cast("long")).alias("time_ms"),
        *(_number(F.col(c)).alias(f"{c}{'_km' if 'depth' in c else ''}") for c in ("latitude", "longitude", "depth", "centroid_latitude", "centroid_longitude", "centroid_depth")),
        (_number(F.col("moment")) * F.pow(F.lit(10.0), _number(F.col("exponent")))).alias("scalar_moment"),
        F.transform(F.split(F.trim("planes"), r"\s+"), lambda x: x.try_cast("double")).alias("p"),
    )
    angle = lambda k: F.get("p", F.lit(k))
    plane = lambda k: angle(k).between(0, 360) & angle(k + 1).between(0, 90) & angle(k + 2).between(-180, 180)
    good = (F.col("id") != "") & F.col("time_ms").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("depth_km").isNotNull() & (F.col("scalar_moment") > 0) & (F.size("p") == 6) & plane(0) & plane(3)
    judged = read.withColumn("good", F.coalesce(good, F.lit(False)))
    names = ("strike", "dip", "rake")
    out = judged.where("good").select(
        "id", "time_ms", "latitude", "longitude", "depth_km", moment_magnitude(F.col("scalar_moment")).alias("magnitude"), "scalar_moment",
        *(angle(3 * k + j).alias(f"{names[j]}{k + 1}") for k in range(2) for j in range(3)),
        *(F.coalesce(f"centroid_{c}", c).alias(f"centroid_{c}") for c in ("latitude", "longitude", "depth_km")), "reference_catalog",
    )
    return out.orderBy("time_ms", "id"), judged.agg(F.count_if(~F.col("good")).alias("skipped"))
