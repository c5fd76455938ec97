"""Paged archives as a data source, and backfills that resume: a partition a chunk, a ledger of what is complete.

A service gives pages of events in order of time: `fetch(start_ms, end_ms, floor, limit, offset)` returns a list of features,
with offsets from 1 and both ends of the span included. `http_pages` and `file_pages` make such functions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tremor import constants as K
from tremor.operators.tables import written
from tremor.operators.upsert import merge_latest
from tremor.sources.feeds import usgs_events

Fetch = Callable[[int, int, float, int, int], list[dict]]

PAGE_ROWS = 20_000
ATTEMPTS, DELAY_SECONDS = 3, 1.0
CHUNKS_PER_WAVE = 16
ROWS = "year int, min_magnitude double, kind string, page int, time_ms long, value string, n long"
LEDGER = "year int, min_magnitude double, event_count long, fetched_ms long"


@dataclass(frozen=True)
class Chunk:
    """A calendar year above a floor of magnitude; the end is not in it."""

    year: int
    min_magnitude: float

    @property
    def start_ms(self) -> int:
        return int(datetime(self.year, 1, 1, tzinfo=timezone.utc).timestamp()) * 1000

    @property
    def end_ms(self) -> int:
        return Chunk(self.year + 1, self.min_magnitude).start_ms


#: (first year, last year, floor): large events from when all of them are known, then all from the main epoch; None is the current year.
TIERS = ((K.DEEP_EPOCH_YEAR, K.ARCHIVE_EPOCH_YEAR - 1, K.DEEP_FLOOR), (K.ARCHIVE_EPOCH_YEAR, None, K.ARCHIVE_FLOOR))


def planned(now_ms: int, tiers=TIERS) -> list[Chunk]:
    """Every chunk up to the current year, the small deep tier first: some 130."""
    this = datetime.fromtimestamp(now_ms / 1000, timezone.utc).year
    return [Chunk(y, floor) for first, last, floor in tiers for y in range(first, min(this, last or this) + 1)]


def paged_archive(fetch: Fetch) -> type[DataSource]:
    """A data source `paged_archive` over a service: option `chunks` is a list of [year, floor, start_ms, end_ms] as JSON, one partition each.

    Made anew for each service, so that it travels to the executors with its `fetch`.
    """
    rows, page_default, attempts_default, delay_default = ROWS, PAGE_ROWS, ATTEMPTS, DELAY_SECONDS

    def pages(year: int, floor: float, start_ms: int, end_ms: int, page_rows: int, attempts: int, delay_seconds: float) -> Iterator[tuple]:
        """The rows of one chunk: its events, then one row `done` with their number, or `failed` with the error, whatever came before.

        A page is asked for again after a failure, waiting longer each time. A page that is not full is the last. What lies at or
        past the end goes: it belongs to the next chunk, and the service includes it.
        """
        offset, page, kept = 1, 0, 0
        while True:
            for attempt in range(1, attempts + 1):
                try:
                    features = fetch(start_ms, end_ms, floor, page_rows, offset)
                    break
                except Exception as e:  # whatever a service or its client raises
                    if attempt == attempts:
                        yield year, floor, "failed", page, None, f"page at {offset}: {e}", None
                        return
                    time.sleep(delay_seconds * attempt)
            for f in features:
                at = f["properties"]["time"]
                if at < end_ms:
                    kept += 1
                    yield year, floor, "event", page, at, json.dumps({"features": [f]}), None
            page += 1
            if len(features) < page_rows:
                yield year, floor, "done", page, None, None, kept
                return
            offset += len(features)

    class ChunkPartition(InputPartition):
        pass

    class ArchiveReader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [ChunkPartition(tuple(c)) for c in json.loads(self.options["chunks"])]

        def read(self, partition):
            o = self.options
            return pages(*partition.value, int(o.get("page_rows", page_default)), int(o.get("attempts", attempts_default)), float(o.get("delay_seconds", delay_default)))

    class PagedArchive(DataSource):
        @classmethod
        def name(cls):
            return "paged_archive"

        def schema(self):
            return rows

        def reader(self, schema):
            return ArchiveReader(dict(self.options))

    return PagedArchive


def http_pages(url: str, timeout: float = 60.0) -> Fetch:
    """Pages of an FDSN event service as GeoJSON, oldest first; 204 is an empty page, any other status an error."""

    def fetch(start_ms: int, end_ms: int, floor: float, limit: int, offset: int) -> list[dict]:
        import json
        from datetime import datetime, timezone
        from urllib.parse import urlencode
        from urllib.request import urlopen

        iso = [datetime.fromtimestamp(t / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z") for t in (start_ms, end_ms)]
        query = {"format": "geojson", "starttime": iso[0], "endtime": iso[1], "orderby": "time-asc", "limit": limit, "offset": offset, "minmagnitude": floor}
        with urlopen(f"{url}?{urlencode(query)}", timeout=timeout) as answer:
            return [] if answer.status == 204 else json.load(answer)["features"]

    return fetch


def file_pages(root: str) -> Fetch:
    """Pages of a mirror in files: a Parquet folder (time_ms, magnitude, feature) in parts year=..., each in any order.

    Only the years that the span touches are read, and of these the rows within it. The instants of a span are counted when its
    first page is asked for; rows are then read and kept some 65,536 at a time, so they are read about once, however small the pages are.
    """
    ahead_rows, kept = 65_536, {}

    def fetch(start_ms: int, end_ms: int, floor: float, limit: int, offset: int) -> list[dict]:
        import json
        from datetime import datetime, timezone

        import numpy as np
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        files, path = fs.FileSystem.from_uri(root)
        first, last = (datetime.fromtimestamp(t / 1000, timezone.utc).year for t in (start_ms, end_ms))
        part = ds.partitioning(flavor="hive")
        c = ds.field
        within = lambda a, b: (c("year") >= first) & (c("year") <= last) & (c("time_ms") >= a) & (c("time_ms") <= b) & (c("magnitude") >= floor)
        read = lambda columns, a, b: ds.dataset(path, filesystem=files, format="parquet", partitioning=part).to_table(columns=columns, filter=within(a, b))
        if kept.get("span") != (start_ms, end_ms, floor):
            kept.clear()
            times, counts = np.unique(read(["time_ms"], start_ms, end_ms)["time_ms"].to_numpy(), return_counts=True)
            kept.update(span=(start_ms, end_ms, floor), times=times, upto=np.concatenate(([0], np.cumsum(counts))), low=0, high=0)
        times, upto = kept["times"], kept["upto"]
        low = offset - 1
        high = min(low + limit, int(upto[-1]))
        if low >= high:
            return []
        if not kept["low"] <= low <= high <= kept["high"]:
            i = int(np.searchsorted(upto, low, side="right")) - 1
            j = int(np.searchsorted(upto, min(max(high, low + ahead_rows), int(upto[-1])), side="left"))
            rows = read(["time_ms", "feature"], int(times[i]), int(times[j - 1])).sort_by([("time_ms", "ascending"), ("feature", "ascending")])
            if len(rows) != upto[j] - upto[i]:
                raise OSError("the mirror has changed since its instants were counted")
            kept.update(low=int(upto[i]), high=int(upto[j]), rows=rows["feature"])
        return [json.loads(f) for f in kept["rows"].slice(low - kept["low"], high - low).to_pylist()]

    return fetch


@dataclass
class Progress:
    """What a backfill did: `state` is complete, cancelled or failed."""

    state: str
    completed: int
    total: int
    stored: int
    error: str | None = None
    years: list[int] = field(default_factory=list)


class Archive:
    """Events by chunk and the ledger of complete chunks, as two Parquet folders.

    The ledger's row is written after the chunk's events are, so a run that is killed at any point leaves only whole years marked.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A folder that may not be there yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def events(self) -> DataFrame | None:
        """The events of all chunks with `year` and `min_magnitude`; None before the first are saved."""
        return self._read("events")

    def ledger(self) -> DataFrame:
        """The latest row of each year and floor."""
        rows = self._read("ledger", LEDGER)
        rows = self.spark.createDataFrame([], LEDGER) if rows is None else rows
        return rows.groupBy("year", "min_magnitude").agg(F.max_by("event_count", "fetched_ms").alias("event_count"), F.max("fetched_ms").alias("fetched_ms"))

    def completed(self) -> list[tuple[int, float]]:
        return [(r.year, r.min_magnitude) for r in self.ledger().select("year", "min_magnitude").collect()]  # a row a year and floor

    def save(self, events: DataFrame, chunks: list[Chunk]) -> None:
        """Put whole chunks in, in place of what their parts held, but for events that are no longer served."""
        keys = self.spark.createDataFrame([(c.year, c.min_magnitude) for c in chunks], "year int, min_magnitude double")
        old = self.events()
        if old is not None:
            years, floors = sorted({c.year for c in chunks}), sorted({c.min_magnitude for c in chunks})
            old = old.where(F.col("year").isin(years) & F.col("min_magnitude").isin(floors)).join(F.broadcast(keys), ["year", "min_magnitude"], "left_semi")
            events = merge_latest(old.select(*events.columns), events, "event_id", "updated_utc")
        merged = written(events, "merged")  # it may have been read from the folders that are written next
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("min_magnitude", "year").parquet(f"{self.path}/events")

    def record(self, counts: list[tuple[Chunk, int]], now_ms: int) -> None:
        rows = [(c.year, c.min_magnitude, n, now_ms) for c, n in counts]
        if rows:
            self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")


def backfill(archive: Archive, fetch: Fetch, now_ms: int, *, tiers=TIERS, chunks_per_wave: int = CHUNKS_PER_WAVE, page_rows: int = PAGE_ROWS, attempts: int = ATTEMPTS, delay_seconds: float = DELAY_SECONDS, cancelled: Callable[[], bool] = lambda: False) -> Progress:
    """Fetch every chunk that is not complete at its floor or a lower one, in waves; each wave's whole chunks are saved, then recorded.

    A year is whole or not there: of a chunk with a failed page nothing is kept, the other chunks of its wave are. The current
    year is fetched each time and never recorded, as it still grows. A count that is not that of the rows raises an error.
    A call that fails or is cancelled, between waves, leaves what earlier waves saved, and the next call goes on from there.
    """
    spark, this = archive.spark, datetime.fromtimestamp(now_ms / 1000, timezone.utc).year
    chunks, done = planned(now_ms, tiers), archive.completed()
    todo = [c for c in chunks if c.year >= this or not any(y == c.year and floor <= c.min_magnitude for y, floor in done)]
    spark.dataSource.register(paged_archive(fetch))
    state, error, years = "complete", None, []
    for a in range(0, len(todo), chunks_per_wave):
        if cancelled():
            state = "cancelled"
            break
        wave = todo[a : a + chunks_per_wave]
        options = {"chunks": json.dumps([(c.year, c.min_magnitude, c.start_ms, c.end_ms) for c in wave]), "page_rows": str(page_rows), "attempts": str(attempts), "delay_seconds": str(delay_seconds)}
        rows = written(spark.read.format("paged_archive").options(**options).load(), "pages")
        ends = {(r.year, r.min_magnitude): r for r in rows.where("kind <> 'event'").collect()}  # one a chunk
        counted = {(r.year, r.min_magnitude): r["count"] for r in rows.where("kind = 'event'").groupBy("year", "min_magnitude").count().collect()}
        whole = [c for c in wave if (c.year, c.min_magnitude) in ends and ends[c.year, c.min_magnitude].kind == "done"]
        for c in whole:
            if counted.get((c.year, c.min_magnitude), 0) != ends[c.year, c.min_magnitude].n:
                raise RuntimeError(f"{c.year}: rows were lost between the pages and the table")
        if whole:
            keys = spark.createDataFrame([(c.year, c.min_magnitude) for c in whole], "year int, min_magnitude double")
            found = rows.where("kind = 'event'").join(F.broadcast(keys), ["year", "min_magnitude"])
            parsed = usgs_events(found, "value", "year", "min_magnitude")
            archive.save(parsed, whole)
            archive.record([(c, ends[c.year, c.min_magnitude].n) for c in whole if c.year < this], now_ms)
            years += [c.year for c in whole]
        if len(whole) < len(wave):
            state = "failed"
            error = "; ".join(f"{y} failed after {attempts} attempts: {r.value}" for (y, _), r in sorted(ends.items()) if r.kind == "failed")
            break
    ledger = archive.ledger().agg(F.count("*").alias("n"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("stored")).first()
    return Progress(state, ledger.n, len(chunks), ledger.stored, error, years)
