"""Writing intermediate tables to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in spark.checkpoint.dir (in local mode in a temporary folder where that is unset) that nothing has used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tremor-"))
    return f"{base.rstrip('/')}/tremor-{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in a new folder, read back: lineage ends here."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
