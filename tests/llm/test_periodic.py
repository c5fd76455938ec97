import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tremor.llm import periodic, registry


def brute_runs(w):
    """Stretches by period, each kept at its smallest."""
    n, best = len(w), {}
    for q in range(n // 4, 0, -1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best[i, j + q] = q
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(d, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h, n = zlib.crc32(str(d).encode()) if d is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digests(w):
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept(w, runs))))


def random_words(rng):
    k = rng.random()
    n = rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
    w = [rng.choice("ab" if k < 0.3 else "abcdefgh") for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 20]))]
        at = rng.randint(0, len(w))
        w[at:at] = (unit * 9)[: rng.randint(0, 9 * len(unit))]
    return w


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_runs_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(periodic, "CANDIDATES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randint(1, 12))]
        docs += [list(docs[0]), ["a"] * 50, ["a", "b"] * 3, ["a"] * 6]
        runs, gone = periodic.runs_of([[x.encode() for x in w] for w in docs])
        at = 0
        for k, w in enumerate(docs):
            want = brute_runs(w)
            assert [tuple(r[1:]) for r in runs.tolist() if r[0] == k] == want
            assert [x for x, g in zip(w, gone[at : at + len(w)]) if not g] == kept(w, want)
            at += len(w)


def test_no_documents_and_long_ones():
    runs, gone = periodic.runs_of([[], []])
    assert runs.shape == (0, 4) and len(gone) == 0
    unit = [str(k).encode() for k in np.random.default_rng(1).integers(0, 50, 1000)]
    words = [b"x", *unit * 200, b"y"]
    runs, gone = periodic.runs_of([words])
    assert (0, 1, 200_000, 1000) in set(map(tuple, runs.tolist())) and (~gone).sum() <= 1002


def test_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "ça", "x"]) + rng.choice(["", "", "\t", "\n ", "\x0b"]) for _ in range(rng.choice([0, 3, 30, 200]))), 1) for i in range(150)]
    rows += [(900, None, 1), (901, "", 1), (None, "a " * 40, 1), rows[3], (902, "u v " * 12, 1), (903, "la la " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted((tuple(r) for r in periodic.run_digests(periodic.periodic_runs(periodic.repeated_tails(df))).collect()), key=str)
    slow = {903}
    want = sorted(((d, *digests(planted(d, t))) for d, t, _ in rows if d not in slow), key=str)
    assert [r for r in got if r[0] not in slow] == want and any(r[1] > 0 for r in want)
    long = next(r for r in got if r[0] == 903)
    assert long[1:5] == (1, 0, 60_000, 1)
    assert periodic.run_digests(periodic.periodic_runs(df.limit(0))).collect() == []


def test_operator_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "so  very very very very very very\tgood")], "doc_id long, text string")
    r = periodic.periodic_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(1, 6, 1)] and r.collapsed == "so very good"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r[0]: tuple(r[1:]) for r in registry.op13_runs(spark, sf).collect()}
    assert got == {d: digests(planted(d, t)) for d, t in rows}
    assert sum(v[0] for v in got.values()) > 10
