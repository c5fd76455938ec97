import math
import random

import numpy as np
import pandas as pd
import pytest

from tremor.llm import mtree
from tremor.llm.registry import OP5_SQL

LONG = 1 << 63


def exact(x):
    """floor(1024 x) by fractions alone."""
    n, d = float(x).as_integer_ratio()
    return 1024 * n // d


def brute(rows, k, every):
    """By the words of the contract: finite vectors take part, all other rows are candidates."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            kept.append((i, [exact(np.float32(x)) for x in v]))
    out = []
    for n, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(kept) if m != n and len(w) == len(v))
            out += [(q, r + 1, None if none else i, max(-LONG, min(LONG - 1, -s))) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def make(n=900, d=6):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice([1, 1, 4]) for _ in range(d)], 1) for i in range(n)]
    same = rows[10][1]
    rows += [(n + i, same, 1) for i in range(400)]
    rows += [(5000, None, 1), (5010, [], 1), (5015, [], 1), (5020, [float("nan")] * d, 1), (5030, [None] * d, 1), (5040, [float("inf")] * d, 1), (None, same, 1), (None, None, 1), (20, rows[20][1], 1), (30, [9.0] * d, 1), (6000, [1.0, 2.0], 1), (6001, [3.0, 2.0], 1)]
    return rows


def large(d=6):
    """Values up to the largest floats, in both signs, among small ones."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 0, 3, 5, 9]) for _ in range(d)], 1) for i in range(200)]
    return rows + [(200 + i, [rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 5, 20, 38]) for _ in range(d)], 1) for i in range(80)] + [(400, [70000.0, 1.0], 1), (401, [1.0, 1.0], 1), (2, [5.0] * d, 1), (2, [2.0] * d, 1)]


def got(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted((tuple(r) for r in mtree.top_k(df, k=k, every=every).collect()), key=str)


@pytest.mark.parametrize("k,part", [(3, 100), (10, 8192)])
def test_top_k_is_exact(spark, monkeypatch, k, part):
    monkeypatch.setattr(mtree, "PART_ROWS", part)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 20)
    assert got(spark, make(), k, 20) == brute(make(), k, 20)


def test_large_values_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PIVOT_ROWS", 16)
    assert got(spark, large(), 10, 4) == brute(large(), 10, 4)


def test_sql_keeps_repeated_ids_too(spark):
    import duckdb

    rows = [(100, [1.0, 2.0]), (100, [5.0, 5.0]), (100, [5.0, 5.0]), (3, [70000.0, 1.0]), (None, [2.0, 2.0]), (200, []), (201, []), (7, [float("inf"), 1.0])]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"})
    con = duckdb.connect()
    con.register("e", embeddings)
    con.execute("CREATE VIEW embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM e")
    want = sorted(con.execute(OP5_SQL).fetchall(), key=str)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in mtree.top_k(df).collect()), key=str) == want == brute([(*r, 1) for r in rows], 10, 100)


def test_few_and_none(spark):
    df = spark.createDataFrame(make(40, 2)[:3], "vec_id long, embedding array<float>, score int")
    assert len(mtree.top_k(df, k=10, every=1).collect()) == 6
    assert mtree.top_k(df.limit(0)).collect() == []


def test_written_scores_sort():
    numbers = [0, 1, -1, 9, 10, -10, -9, 10**18, 10**19, -(10**19), LONG - 1, -LONG, LONG, 10**83, -(10**83)]
    assert sorted(numbers) == sorted(numbers, key=mtree.written)


def test_bounds_pass_over_most_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.1
    y = np.floor(1024 * x).astype(np.int64)
    names = ["page", "leaf", "entries", "rows", "vectors", "radii", "parent_distances", "top", "unit"]
    pages = pd.DataFrame(mtree.Tree(np.arange(4000), np.arange(4000), x).rows, columns=names)
    tree = mtree.Searcher(pages, 16)
    for q in range(0, 4000, 100):
        want = sorted((-int(s), i) for i, s in enumerate(y @ y[q]) if i != q)[:10]
        assert [(-s, i) for s, i, _ in tree.search(q, x[q], 10)] == want
    assert tree.computed < 0.6 * 40 * 4000
