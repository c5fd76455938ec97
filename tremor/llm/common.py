"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as the contracts define it: a run without space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows below which a two- or three-column frame may be broadcast (some tens of MB).
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}
_shipped: set[str] = set()
_lists: list[list[str]] = []
_kept: dict[tuple[str, str], object] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tremor-"))
    return base.rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that stage() made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p.rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders that stage() makes meanwhile, but for those of an inner collecting() or with keep=True."""
    _lists.append([])
    try:
        yield _lists[-1]
    finally:
        _lists.pop()


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Delete afterwards what stage() has written meanwhile, but for tables with keep=True: the result must not read the others."""
    with collecting() as paths:
        yield
    delete(spark, paths)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tremor-"), "tremor_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        z.writestr("tremor/__init__.py", "")
        for name in sorted(os.listdir(os.path.join(top, "llm"))):
            if name.endswith(".py"):
                z.write(os.path.join(top, "llm", name), f"tremor/llm/{name}")
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def kept(owner: str, key: str, make):
    """What `make` gives; a worker process keeps it from task to task until it gets work of another module than `owner`."""
    if (owner, key) not in _kept:
        _kept[owner, key] = make()
    return _kept[owner, key]


def release(owner: str) -> None:
    """Forget what kept() holds for other modules: Spark gives one worker process the work of many operators."""
    for k in [k for k in _kept if k[0] != owner]:
        del _kept[k]


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, after making sure that the workers can import this package. A task begins without what other modules keep."""
    ship(df.sparkSession)
    owner = run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def numbered(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different ones among words without spaces, and which of them each word is."""
    coded = words.dictionary_encode()
    one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
    different = pc.binary_join(one, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
    return different, coded.indices.to_numpy()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows whose texts come to about `most` bytes, one row at least.

    What a task then holds for its rows, and sends back at once, does not grow with the length of 10,000 texts.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/tremor-{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str, codec: str = "snappy", keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts lineage, and unlike an executor's cache it survives the loss of executors. With `keep`, a discarding() around it
    leaves it, and the next one out decides.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    at = len(_lists) - 1 - keep
    if at >= 0:
        _lists[at].append(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are few; else Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def buckets_for(rows: int, least: int = 128, per: int = 16384) -> int:
    """How many sub-groups to split every group into, so that none of them grows with the input."""
    return max(least, -(-rows // per))


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """A copy of the schema with further columns."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in more.items())])


LONG, INT, DOUBLE, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()


def as_long(col: str) -> Column:
    return F.col(col).cast(T.LongType())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
