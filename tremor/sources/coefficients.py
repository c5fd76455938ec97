"""Text tables of spherical-harmonic coefficients, as rows (kind, n, m, year, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH_YEARS = 5


def coefficient_table(lines: DataFrame, degree: int, column: str = "value") -> DataFrame:
    """The table of a text whose header `g/h n m <year>... <span>` names the epochs and, last, a yearly change.

    Data lines start with g or h and have as many fields, parted by any white space, as the header; others are comment. The last
    column becomes one more epoch, five years on. A header that is missing, repeated or without a span, an epoch or a value that is no
    number, a coefficient that comes twice, and any other number of coefficients than degree * (degree + 2) raise an error:
    a table with holes would give a wrong field without any sign of it. So the result has a known size.
    """
    fields = lines.select(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ").alias("f"))
    heads = fields.where(F.col("f")[0] == "g/h").limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{'no' if not heads else 'more than one'} header of epochs")
    *years, span = heads[0].f[3:] or [""]
    if "-" not in span:
        raise ValueError(f"the last column should be a yearly change, not {span!r}")
    try:
        epochs = [float(y) for y in years]
    except ValueError:
        raise ValueError("an epoch is no number") from None
    if not epochs:
        raise ValueError("no epochs")
    width = len(epochs) + 4
    rows = fields.where(F.col("f")[0].isin("g", "h") & (F.size("f") == width)).select(
        F.col("f")[0].alias("kind"), *(F.expr(f"try_cast(f[{k}] as int)").alias(c) for k, c in ((1, "n"), (2, "m"))), F.transform(F.slice("f", 4, width), lambda x: x.try_cast("double")).alias("v")
    )
    whole = F.col("n").isNotNull() & F.col("m").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    seen = rows.agg(F.count("*").alias("rows"), F.count_if(~whole).alias("broken"), F.max("n").alias("n"), F.count_distinct("kind", "n", "m").alias("distinct")).first()
    want = degree * (degree + 2)
    if seen.broken:
        raise ValueError(f"{seen.broken} coefficients with a value that is no number")
    if seen.rows != want or seen.distinct != want or seen.n != degree:
        raise ValueError(f"{seen.rows} coefficients ({seen.distinct} different) up to degree {seen.n}, not {want} up to {degree}")
    held = F.slice("v", 1, len(epochs))
    last = F.col("v")[len(epochs) - 1] + EPOCH_YEARS * F.col("v")[len(epochs)]
    at = F.array(*map(F.lit, [*epochs, epochs[-1] + EPOCH_YEARS]))
    each = rows.select("kind", "n", "m", F.explode(F.arrays_zip(at.alias("year"), F.concat(held, F.array(last)).alias("value"))).alias("e"))
    return each.select("kind", "n", "m", F.col("e.year").alias("year"), F.col("e.value").alias("value"))


def epochs_of(table: DataFrame) -> DataFrame:
    """Epochs with the number of their coefficients and the year that follows."""
    by = table.groupBy("year").agg(F.count("*").alias("n"))
    return by.withColumn("next", F.lead("year").over(Window.orderBy("year")))  # some tens of epochs
