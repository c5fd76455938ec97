import random
import re

import pyarrow as pa

from tremor.llm import jaccard
from tremor.llm.common import sliced
from tremor.llm.components import components


def sets(text, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, percent):
    s = [sets(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    up[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None] if s[i] else [r[0]]
        out.append((str(r[0]), len(s[i]), str(min(ids, default=None))))
    return sorted(out)


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts, rows = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.45:  # a copy with some words changed, added or removed
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(w)) if w else 0
                what = rng.random()
                if what < 0.6 and w:
                    w[at] = rng.choice(vocabulary)
                elif what < 0.8:
                    w.insert(at, rng.choice(vocabulary))
                elif w:
                    del w[at]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 90, 200]))]
            if kind > 0.8:
                at = rng.randrange(len(w))
                w[at:at] = passage
        texts.append(w)
        rows.append((1000 - i, rng.choice([" ", "\n", " \t"]).join(x.upper() if rng.random() < 0.1 else x for x in w), 1))
    rows += [(2000, None, 1), (2001, "", 1), (2002, " \n", 1), rows[3], (2003, rows[5][1], 1), (2004, "É é", 1), (2005, "é é", 1), (2006, "a b c", 1)]
    return rows


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, g int")
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(df, words=k, percent=percent).collect())
        assert got == brute(rows, k, percent)


def test_one_of_each_and_empty(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "", "x"), (4, None, "x"), (5, "", "x"), (None, "a b c d e f g", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string")
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(df).collect()) == ["1", "2", "4", "5", "None"]
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (9, 8)] + [(500, 500 + i) for i in range(1, 30)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}


def test_batches_go_on_in_slices():
    texts = ["word " * 200_000, None, "", *("a b c d e f" for _ in range(50)), "word " * 900_000, "x y z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), "t"))
    assert [x for p in parts for x in p["t"].to_pylist()] == texts
    assert len(parts) == 3 and all(p.num_rows == 1 or sum(len(x or "") for x in p["t"].to_pylist()) <= 1 << 22 for p in parts)


def test_sets_of_arrow_texts():
    rng = random.Random(8)
    texts = [None, "", " \t\x0b", "A b\x0cC", "É\xa0e x\x1cy  z w", *("".join(rng.choice("aB \t\n\x0b\xa0é") for _ in range(rng.randint(0, 30))) for _ in range(500))]
    got = jaccard.shingle_sets(pa.array(texts, pa.string()), 2)
    for t, s in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(s) == len({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else ())


def test_a_worker_lets_go_of_what_other_operators_keep(spark):
    from tremor.llm import common, packing

    def seen(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([len(common._kept)])], names=["n"]) for _ in batches)

    one = spark.range(1).coalesce(1)
    held = common.kept(packing.__name__, "x", lambda: 1)
    assert held == common.kept(packing.__name__, "x", lambda: 2) == 1
    common.release(packing.__name__)
    assert len(common._kept) == 1
    seen.__module__ = jaccard.__name__
    assert common.map_arrow(one, seen, "n long").collect()[0].n == 0
    common.release(jaccard.__name__)
    assert common._kept == {}
