"""Operator 3, WARC: a writer that stores equal payloads once, and a reader whose tasks take byte ranges of the archives.

Every record is a gzip member of its own. A reading task scans its range for the gzip magic, takes a place for a member only
if a WARC header decodes there, and from then on steps from member to member; it owns the records that start in its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import map_arrow, new_path, stage

SPLIT_BYTES = 32 << 20
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
SALTS = 32
MOST_TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"  # archives of one input are the same in every run
_URN = "urn:tremor:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record, gzipped: a response, or a revisit of the page refers_to, which keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = f"<{_URN}{page_id}>" if page_id is not None else "<urn:tremor:page:null>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, to: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record a row below the folder `to`; returns the manifest (path, bytes) of the files that count.

    Of records with equal payloads of at least `least_bytes`, those with the smallest id are responses, the rest revisit
    it; rows without an id are responses. A task names its files by chance and reports them in its rows, so what a failed
    attempt leaves behind is never read.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    # Only payloads that repeat are looked up. If they are few, Spark broadcasts them and no page moves; else the salt keeps a payload with many copies from meeting in one task.
    repeated = stage(groups.select("sha", "n", "first_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "repeated")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    known = salted.join(repeated, ["sha", "n", "salt"], "left").select("page_id", "url", "payload", "sha", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(to)
        store.create_dir(base, recursive=True)
        sink, path, size, many, done = None, "", 0, 0, []
        for b in batches:
            columns = [b[c].to_pylist() for c in ("page_id", "url", "payload", "sha", "refers_to")]
            for page_id, url, raw, sha, refers_to in zip(*columns):
                if sink is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    sink, size, many = store.open_output_stream(path, compression=None), 0, 0
                record = member(page_id, url, raw, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to)
                sink.write(record)
                size, many = size + len(record), many + 1
                if size >= file_bytes:
                    sink.close()
                    done.append((path, size, many))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, size, many))
        names = [f"{to}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "bytes", "records"])

    return stage(map_arrow(known, run, "path string, bytes long, records long"), "manifest")


class _Tail:
    """A file from one place on, read in chunks."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.data = f, at, size, bytearray()

    def more(self) -> bool:
        got = self.f.read_at(min(CHUNK, self.size - self.at - len(self.data)), self.at + len(self.data)) if self.at + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _decoded(tail: _Tail, head: int | None = None) -> tuple[bytes, int] | None:
    """The member at the tail's start and its length in the file; with `head`, as soon as so many bytes are out. None if there is none."""
    z, out, fed = zlib.decompressobj(31), [], 0
    n = 0
    while not z.eof:
        if fed == len(tail.data) and not tail.more():
            return None
        part = bytes(tail.data[fed : fed + CHUNK])
        try:
            got = z.decompress(part, (head - n) if head else 0)
        except zlib.error:
            return None
        fed += len(part)
        out.append(got)
        n += len(got)
        if head and n >= head:
            break
    return b"".join(out), fed - len(z.unused_data)


def records(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the members that start in [start, end) and decode to a WARC header.

    Where a header decodes but the rest does not (a flipped byte, a file that was cut off), that is an error: a record that is
    lost must not look like one that never was.

    A range that starts within a member goes on to the next candidate that decodes so. In archives of others a payload with
    whole gzip members of WARC records, stored uncompressed, could pass for records there; the texts that `write` stores
    cannot, since no UTF-8 holds the magic.
    """
    tail = _Tail(f, start, size)
    while tail.at < end:
        at = tail.data.find(MAGIC)
        if at < 0:
            tail.skip(max(0, len(tail.data) - len(MAGIC) + 1))
            if not tail.more():
                return
            continue
        tail.skip(at)
        if tail.at >= end:
            return
        head = _decoded(tail, 6)
        if not head or head[0][:5] != b"WARC/":
            tail.skip(1)
            continue
        whole = _decoded(tail)
        if whole is None:
            raise ValueError(f"the record at {tail.at} is damaged or cut off")
        yield tail.at, whole[0]
        tail.skip(whole[1])


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read(manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives that the manifest (path, bytes) lists, one row each.

    payload is null for revisits; payload_bytes and payload_digest are of the full payload in either case, computed anew from
    what a response holds and taken from the headers of a revisit. A response whose digest differs from its header's fails.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("start"))
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    dealt = ranges.repartition(max(1, min(int(n), MOST_TASKS)), "path", "start")  # a given number: the rows are few bytes, what they stand for is not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def located(path: str, found: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
            try:
                yield from found
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

        for b in batches:
            for path, size, start in zip(b["path"].to_pylist(), b["bytes"].to_pylist(), b["start"].to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                held, weight = [], 0
                with store.open_input_file(name) as f:
                    for at, raw in located(path, records(f, size, start, min(start + split_bytes, size))):
                        h, body = _headers(raw)
                        body = body[: int(h["content-length"])]
                        http, payload = _headers(body)
                        said = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "revisit":
                            held.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), "revisit", _page(h.get("warc-refers-to")), int(http["content-length"]), said, None))
                        else:
                            if (found := digest_of(payload)) != said:
                                raise ValueError(f"{path} at {at}: payload digest {found}, header says {said}")
                            held.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), "response", None, len(payload), found, payload))
                        weight += len(raw)
                        if weight >= 16 * CHUNK:
                            yield batch(held)
                            held, weight = [], 0
                yield batch(held)

    return map_arrow(dealt, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame, *, id_col: str = "page_id", columns: list[str] | None = None, **more) -> DataFrame:
    """Write all pages, read the archives back: one row a page, of all columns of read() or those asked for.

    Null html counts as empty; a null id stays null and is always a response; rows that repeat the smallest id of their
    payload are responses all; an empty table gives no archive and an empty result. Any other number of records than the
    manifest counts is an error.
    """
    split = more.pop("split_bytes", SPLIT_BYTES)
    manifest = write(pages, new_path(pages.sparkSession, "warc"), id_col=id_col, **more)
    rows = read(manifest, split_bytes=split)
    found = stage(rows.select(*columns) if columns else rows, "records")
    want, got = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if got != want:
        raise RuntimeError(f"{got} records were read of {want} that were written")
    return found


__all__ = ["archive", "digest_of", "member", "read", "records", "write"]
