import hashlib
import random

import numpy as np
import pytest

from tremor.llm import suffix


def brute(rows, length):
    """Rows (id, text) with distinct ids, by a dictionary of all strings."""
    first = {}
    out = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first.setdefault(raw[i : i + length], (d, i)) != (d, i):
                gone[i : i + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120, scale=1):
    rng = random.Random(seed)
    words = ["alpha", "be", "gämma", "delta", "ep", "zeta,", "eta.", "日本", "x"]
    line = " ".join(rng.choice(words) for _ in range(30 * scale))
    texts = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60, 150]) * scale))
        k = rng.random()
        if k < 0.3:
            at = rng.randint(0, len(t))
            t = t[:at] + line + t[at:]
        elif k < 0.55 and texts:
            o = rng.choice(texts)
            a, b = sorted(rng.randint(0, len(o)) for _ in range(2))
            t = t[: len(t) // 2] + o[a:b] + "!" * rng.randint(0, 1) + o[b:][:50]
        elif k < 0.65 and texts:
            t = rng.choice(texts)
        elif k < 0.7:
            t = rng.choice(["a", "ab", "abc"]) * rng.randint(1, 150) * scale
        texts.append(t)
    return list(zip(rng.sample(range(5 * n), n), texts)) + [(-5, None), (-6, "")]


@pytest.mark.parametrize("length,cover,chunk,crowd", [(100, 32, 1 << 18, 500), (20, 8, 64, 3), (7, 3, 50, 20), (100, 32, 1 << 18, 2)])
def test_against_brute_force(spark, monkeypatch, length, cover, chunk, crowd):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rows = corpus(length)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(5)
    got = sorted(tuple(r) for r in suffix.remove_repeats(df, length=length, cover=cover).collect())
    assert got == sorted(brute(rows, length))


def test_chunks_of_long_texts():
    text = "".join(random.Random(2).choices("abcd", k=3000))
    whole = {}
    for chunk in (1 << 18, 200, 131):
        suffix.CHUNK = chunk
        starts = [o + k for s, w, off in suffix.scans([text, None, "short"], 50, 16) for o, n in zip(off[s.start].tolist(), s.count.tolist()) for k in range(n)]
        assert sorted(starts) == list(range(2951)), chunk
        whole[chunk] = len(starts)
    suffix.CHUNK = 1 << 18


def test_repeated_rows_nulls_and_empty(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, "x" + long), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect())
    assert got == [("1", 300, 300, 1), ("1", 300, 300, 1), ("2", 300, 300, 1), ("3", 0, 0, 0), ("None", 301, 0, 0)]
    assert suffix.remove_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("period", [4, 16, 37, 64])
def test_difference_cover(period):
    d = suffix.difference_cover(period)
    assert {(int(a) - int(b)) % period for a in d for b in d} == set(range(period))
    shifts = suffix._shifts(period)
    assert all((i + shifts[i, j]) % period in d and (j + shifts[i, j]) % period in d and 0 <= shifts[i, j] < period for i in range(period) for j in range(period))


@pytest.mark.parametrize("text", [b"ab" * 600, b"a" * 900, bytes(random.Random(1).choices(b"ab", k=1200)), b"abcabcabd" * 90 + bytes(range(256)) + b"abcabcabd" * 60])
def test_suffixes_are_sorted(text):
    """Places in the order of their first 100 bytes, and neighbours with 100 bytes in common found, by comparing strings."""
    order = suffix.Suffixes(np.frombuffer(text, np.uint8), 100)
    places = np.array(random.Random(2).sample(range(len(text)), len(text)))
    at = order.sorted(places)
    full = text + bytes(4000)
    strings = [full[i : i + 100] for i in at.tolist()]
    assert sorted(at.tolist()) == list(range(len(text))) and strings == sorted(strings)
    assert order.same(at).tolist() == [a == b for a, b in zip(strings, strings[1:])]


def test_long_ties_and_many_equal_documents(spark, monkeypatch):
    rng = random.Random(5)
    same = "".join(rng.choices("abcdef ", k=400))
    rows = [(i, same) for i in range(1000)] + [(2000, "ab" * 20_000), (2001, "x" + "ba" * 3000)] + [(3000 + i, "".join(rng.choices("gh", k=90)) + same[60:200] + "".join(rng.choices("gh", k=50))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute(rows, 100))
    for crowd in (8192, 30):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        assert sorted(tuple(r) for r in suffix.remove_repeats(df).collect()) == want


def test_buckets_do_not_change_the_groups():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.randint(12, 40))).encode() for _ in range(60)]
    found = set()
    for bucket in (1 << 16, 50, 3):
        groups = {}
        for k, part in enumerate(suffix.repeated_windows(texts, 12, bucket)):
            for g, r, w in part.T.tolist():
                groups.setdefault((k, g), set()).add((r, w))
        found.add(frozenset(frozenset(x) for x in groups.values()))
    by = {}
    for r, t in enumerate(texts):
        for w in range(len(t) - 11):
            by.setdefault(t[w : w + 12], set()).add((r, w))
    assert found == {frozenset(frozenset(x) for x in by.values() if len(x) > 1)}
