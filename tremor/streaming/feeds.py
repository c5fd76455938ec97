"""The same operators on streams: upserts by micro-batch, hourly windows with late rows, alerts once each."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tremor import constants as K
from tremor.operators.upsert import merge_coalesce, merge_latest


class VersionedTable:
    """A table in buckets of its key, each write a numbered folder with the buckets that it changed, and a manifest.

    The manifest of a version names the folder of every bucket and is written last, so a version is whole or not there. A batch
    rewrites only the buckets that it touches, and one that is run again changes nothing. Rows are replaced or added, never taken
    out. A read costs one small file and the buckets asked for, however many versions came before; compact() deletes folders that no kept version names.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._turn = threading.Lock()

    def _fs(self, path: str):
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), fs_path

    def _listed(self, path: str) -> list[str]:
        fs, fs_path = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []

    def _manifest(self, version: int) -> dict:
        if version < 0:
            return {"buckets": {}, "applied": {}}
        fs, fs_path = self._fs(f"{self.path}/manifests/v={version:012d}.json")
        stream = fs.open(fs_path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Write beside, then rename: a reader sees the old manifest, none, or the whole new one."""
        fs, part = self._fs(f"{self.path}/manifests/.v={version:012d}.{uuid.uuid4().hex}")
        _, whole = self._fs(f"{self.path}/manifests/v={version:012d}.json")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(whole):
            fs.delete(whole, False)
        fs.rename(part, whole)

    def versions(self) -> list[int]:
        """Those that were written to the end and not compacted away, in order."""
        return sorted(int(n[2:14]) for n in self._listed(f"{self.path}/manifests") if n.startswith("v=") and n.endswith(".json"))

    def latest(self) -> int:
        return max(self.versions(), default=-1)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of the latest; of some buckets, if only those are asked for. A version that is gone is an error."""
        held = self.versions()
        before = [v for v in held if version is None or v <= version]
        if held and not before and version is not None and version >= 0:
            raise ValueError(f"version {version} is no longer kept")
        folders = self._manifest(max(before, default=-1))["buckets"]
        wanted = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, key: str, applied: dict[str, int] | None = None) -> None:
        """Make a version of the one before it and the buckets of df, which hold all their rows."""
        folder = f"v={version:012d}"
        df.withColumn("bucket", self.bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        before = self._manifest(max((v for v in self.versions() if v < version), default=-1))
        new = {n[7:]: f"{folder}/{n}" for n in self._listed(f"{self.path}/{folder}") if n.startswith("bucket=")}
        self._publish(version, {"buckets": before["buckets"] | new, "applied": before["applied"] | (applied or {})})

    def apply(self, batch: DataFrame, stream: str, epoch: int, key: str, *, coalesce: bool = True, order: str | None = None) -> bool:
        """Merge one batch of one of several streams as the next version; False where this batch is in already.

        One batch at a time: streams of one application share this object, and with it its turn.
        """
        with self._turn:
            latest = self.latest()
            if self._manifest(latest)["applied"].get(stream, -1) >= epoch:
                return False
            touched = {r["b"] for r in batch.select(self.bucket(key).alias("b")).distinct().collect()}  # at most the number of buckets
            old = self.read(latest, touched)
            merged = merge_coalesce(old, batch, key, order) if coalesce else merge_latest(old, batch, key, order)
            self.write(merged, latest + 1, key, {stream: epoch})
            return True

    def compact(self, keep: int = 2) -> list[str]:
        """Forget all but the last `keep` versions and delete the folders that none of them names; returns what was deleted."""
        with self._turn:
            versions = self.versions()
            gone, kept = versions[:-keep] if keep else versions, versions[-keep:] if keep else []
            named = {f for v in kept for f in self._manifest(v)["buckets"].values()}
            # Only folders of versions up to the last kept one: a later one may be in the writing.
            bound = max(versions, default=-1)
            deleted = []
            for v in gone:
                fs, path = self._fs(f"{self.path}/manifests/v={v:012d}.json")
                fs.delete(path, False)
            for folder in (n for n in self._listed(self.path) if n.startswith("v=") and int(n[2:14]) <= bound):
                buckets = [f"{folder}/{n}" for n in self._listed(f"{self.path}/{folder}") if n.startswith("bucket=")]
                free = [b for b in buckets if b not in named]
                for name in [folder] if len(free) == len(buckets) else free:
                    fs, path = self._fs(f"{self.path}/{name}")
                    fs.delete(path, True)
                    deleted.append(name)
            return deleted


def upsert(stream: DataFrame, table: VersionedTable, key: str, checkpoint: str, *, coalesce: bool = False, order: str | None = None, after: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Merge each micro-batch into the table as version batch id + 1; one batch runs at a time, and late rows and revisions overwrite.

    Only the buckets that the batch has keys of are read and written.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        touched = {r["b"] for r in batch.select(table.bucket(key).alias("b")).distinct().collect()}  # at most the number of buckets
        old = table.read(min(table.latest(), epoch), touched)
        merged = merge_coalesce(old, batch, key, order) if coalesce else merge_latest(old, batch, key, order)
        table.write(merged, epoch + 1, key)
        if after is not None:
            after(table.read(epoch + 1), epoch)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def poll(streams: dict[str, DataFrame], prepare: dict[str, Callable[[DataFrame], DataFrame]], table: VersionedTable, key: str, checkpoints: str, *, order: str | None = None, after: Callable[[str, int], None] | None = None) -> dict[str, str | None]:
    """Run independent streams into one table; per stream None or its error. One that fails takes nothing from the others.

    Each stream has a checkpoint of its own and its own function from a batch to rows of the table, where columns that it does not
    measure may be missing. Merging keeps what is measured, so the streams may arrive in any order. `after` is told of each batch that went in.
    """
    columns = table.spark.createDataFrame([], table.schema).schema

    def sink(name: str):
        def run(batch: DataFrame, epoch: int) -> None:
            rows = prepare[name](batch)
            whole = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns))
            if table.apply(whole, name, epoch, key, order=order) and after is not None:
                after(name, epoch)

        return run

    out: dict[str, str | None] = {}
    started: dict[str, StreamingQuery] = {}
    for name, stream in streams.items():
        try:
            started[name] = stream.writeStream.foreachBatch(sink(name)).option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}").trigger(availableNow=True).start()
        except Exception as e:  # a stream that cannot start is its own failure too
            out[name] = str(e)
    for name, q in started.items():
        try:
            q.awaitTermination()
            out[name] = None
        except Exception as e:
            out[name] = str(e)
    return out


def hourly(stream: DataFrame, time_col: str, value: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hours with mean (to one decimal) and maximum; rows later than `late` no longer count."""
    g = stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour"))
    return g.agg((F.floor(F.avg(value) * 10 + 0.5) / 10).alias(f"{value}_mean"), F.max(value).alias(f"{value}_max")).select(F.col("window.start").alias("hour"), f"{value}_mean", f"{value}_max")


def trailing(stream: DataFrame, time_col: str, window: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    g = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window, slide))
    return g.agg(F.count("*").alias("n"), F.max("magnitude").alias("max_magnitude")).select(F.col("window.end").alias("until"), "n", "max_magnitude")


def alerts(stream: DataFrame, time_col: str = "time_utc", late: str = "1 day") -> DataFrame:
    """Large events, each id once."""
    return stream.where(F.col("magnitude") >= K.ALERT_MAGNITUDE).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["event_id"])


def scratch_checkpoint(base: str) -> str:
    return f"{base.rstrip('/')}/checkpoint-{uuid.uuid4().hex}"
