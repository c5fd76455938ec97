import gzip
import random
import zlib

import pyarrow as pa
import pytest

from tremor.llm import warc
from tremor.llm.common import new_path


def rows(n=150):
    rng = random.Random(9)
    out = [(i, f"http://x/{i}?a=b c\r\nX: y", "<p>" + "é" * rng.randint(0, 4) + str(rng.randint(0, 40)) + "</p>" * rng.choice([1, 1, 900]), 1) for i in range(n)]
    return out + [(n, None, None, 1), (n + 1, "u", "", 1), (None, "u", "", 1), out[7], (n + 2, "u", "WARC/1.1\r\n\r\n" + "z" * 300000, 1), (-3, "u", out[5][2], 1)]


def expected(rs):
    first = {}
    for i, _, h, _ in rs:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rs:
        raw = (h or "").encode()
        visit = i is not None and first[h or ""] < i
        out.append((str(i), len(raw), warc.digest_of(raw), "revisit" if visit else "response", str(first[h or ""]) if visit else "None"))
    return sorted(out)


def test_round_trip(spark):
    rs = rows()
    df = spark.createDataFrame(rs, "page_id long, url string, html string, payload int")
    for split in (97, 1000, 1 << 25):
        got = warc.archive(df.repartition(3), split_bytes=split, file_bytes=20000).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expected(rs)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert all(texts[i] == (h or "") for i, _, h, _ in rs if i in texts)


def test_archives_are_gzip_of_warc(spark):
    df = spark.createDataFrame(rows(8), "page_id long, url string, html string, x int")
    m = warc.write(df, new_path(spark, "warc"))
    for r in m.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_false_magic_and_damage():
    real = [warc.member(k, "u", b"x" * 50, warc.digest_of(b"x" * 50), None) for k in range(3)]
    fake = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = b"\x1f\x8b\x08junk" + real[0] + fake.compress(b"not a record") + fake.flush() + real[1] + warc.MAGIC + real[2] + warc.MAGIC
    f = pa.BufferReader(data)
    for cut in range(0, len(data), 5):
        found = [raw for part in ((0, cut), (cut, len(data))) for _, raw in warc.records(f, len(data), *part)]
        assert [r.split(b"page:")[1][:1] for r in found] == [b"0", b"1", b"2"]


@pytest.mark.parametrize("how", ["flipped", "cut", "lost"])
def test_damage_is_an_error(spark, how):
    df = spark.createDataFrame([(k, "u", "x" * 50 + str(k)) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    m = warc.write(df, new_path(spark, "warc"))
    (path, size, many), = [tuple(r) for r in m.collect() if r.bytes]
    assert many == 30 and warc.read(m).count() == 30
    name = path.removeprefix("file://")
    with open(name, "rb") as f:
        raw = bytearray(f.read())
    if how == "flipped":
        raw[raw.find(warc.MAGIC, size // 2) - 5] ^= 0xFF  # within the checksum of a record
    else:
        del raw[-20 if how == "cut" else raw.rfind(warc.MAGIC) :]
    with open(name, "wb") as f:
        f.write(raw)
    given = spark.createDataFrame([(path, len(raw), many)], m.schema)
    if how == "lost":
        assert warc.read(given).count() == 29  # a whole record too few can be seen by the manifest's count alone
        return
    for split in (50, 1 << 20):
        with pytest.raises(Exception, match="damaged or cut off|payload digest"):
            warc.read(given, split_bytes=split).collect()


def test_fewer_records_than_written_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(k, "u", str(k)) for k in range(9)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.archive(df, columns=["page_id"]).collect()) == list(range(9))
    plain = warc.read
    monkeypatch.setattr(warc, "read", lambda m, **k: plain(m, **k).where("page_id <> 4"))
    with pytest.raises(RuntimeError, match="8 records were read of 9"):
        warc.archive(df)


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.archive(df, least_bytes=3).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archive(df.limit(0)).collect() == []
