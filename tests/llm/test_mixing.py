import random
import re

import pytest
from pyspark.sql import functions as F

from tremor.llm import mixing


def water(sizes, weights):
    """Targets by repeated sharing."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [3 * sizes[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > 3 * sizes[i]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permuted_is_a_bijection(spark, n):
    for epoch in (0, 1):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), epoch, 6)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != list(range(n))


def docs(spark, n=400):
    rng = random.Random(4)
    rows = [(i, " ".join("w%d" % rng.randint(0, 9) for _ in range(rng.choice([1, 5, 90, 400]))), rng.choice(["b", "b", "b", "a", "é", "Z", None]), 9) for i in range(n)]
    rows += [(n, None, "a", 9), (n + 1, " \t ", "only", 9), (None, "x y", "a", 9), rows[2], (n + 2, "one word two\x0bthree ", "small", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), rows


def test_mix(spark):
    df, rows = docs(spark)
    got = mixing.mix(df, block=16).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.size) for r in got), key=key) == sorted(((d, size(t)) for d, t, _, _ in rows), key=key)
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    sums = [sum(size(t) for _, t, s, _ in rows if s == x) for x in names]
    want = water(sums, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, x in enumerate(names):
        ids = {d for d, _, s, _ in rows if s == x}
        mine = [r for r in got if r.doc_id in ids and r.source_size == sums[i]]
        assert mine and all(abs(r.target - want[i]) < 1e-6 * max(1, want[i]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[i]) <= max(40, 0.02 * want[i])
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(df.repartition(7), block=16).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixed_documents_and_empty(spark):
    df, rows = docs(spark)
    out = mixing.mixed_documents(df)
    assert out.schema == df.schema and 0 < out.count() < 3 * len(rows)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mixed_documents(df.limit(0)).collect() == []


def test_shards_hold_all_slots(spark):
    df, _ = docs(spark)
    sizes = df.select("source", mixing.word_count(F.col("text")).alias("size"))
    s = mixing.slots(mixing.targets(sizes), block=4)
    assert s.count() == s.select("_k", "draw").distinct().count()
    assert s.groupBy("shard", "_k").count().agg(F.sum("count")).first()[0] == s.count()


def test_mixed_documents_are_the_drawn_ranges(spark):
    df, rows = docs(spark)
    out = mixing.mixed_documents(df, block=16)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, emitted = {}, {}
    for r in mixing.mix(df, block=16).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    texts = {}
    for d, t, _, _ in rows:
        texts.setdefault(d, []).append(t)
    for r in out.collect():
        assert any(t and r.text in t for t in texts[r.doc_id])
        emitted[r.doc_id] = emitted.get(r.doc_id, 0) + size(r.text)
    assert emitted == {k: v for k, v in taken.items() if v}
    again = mixing.mixed_documents(df.repartition(7), block=16)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_one_long_document_meets_its_target(spark, monkeypatch):
    long = "  " + " ".join(f"w{i}" for i in range(20_000)) + "\n"
    df = spark.createDataFrame([(1, long, "z", len(long))] + [(i, f"a{i} " * 5000, "a", 0) for i in range(2, 14)], "doc_id long, text string, source string, n_chars long")
    target = next(r.target for r in mixing.mix(df).collect() if r.doc_id == 1)
    mine = [r for r in mixing.mixed_documents(df).collect() if r.doc_id == 1]
    words = sum(len(r.text.split()) for r in mine)
    assert target % 20_000 > 1000 and abs(words - target) <= 2 * mixing.BLOCK_WORDS
    assert all(r.n_chars == len(r.text) and r.text in long for r in mine)
    monkeypatch.setattr(mixing, "SLOTS_A_SHARD", 64)  # many shards: pieces in each
    cut = [r.text for r in mixing.mixed_documents(df).collect() if r.doc_id == 1]
    assert len(cut) > len(mine) and sum(len(t.split()) for t in cut) == words


def sources_of(spark, sizes, targets):
    return spark.createDataFrame([(i, s, float(t)) for i, (s, t) in enumerate(zip(sizes, targets))], "_k long, source_size long, target double")


def test_counts_by_shard_are_the_draw(spark, monkeypatch):
    """Counts by shard vary as a multinomial's do, and they, not the targets, say how many slots a source has."""
    monkeypatch.setattr(mixing, "SLOTS_A_SHARD", 256)
    table = sources_of(spark, [40_000, 30_000, 10_000], [50_000, 20_000, 10_000])
    free = mixing.slots(table, block=4, near=1.0).collect()
    shards = {}
    for r in free:
        shards.setdefault(r.shard, [0, 0, 0])[r._k] += 1
    full = [c for s, c in shards.items() if sum(c) == 256]
    assert len(full) >= len(shards) - 1
    p = [50 / 80, 20 / 80, 10 / 80]
    chi = sum((c[k] - 256 * p[k]) ** 2 / (256 * p[k]) for c in full for k in range(3)) / (2 * len(full))
    assert 0.6 < chi < 1.6
    totals = [sum(c[k] for c in shards.values()) for k in range(3)]
    assert totals != [12_500, 5_000, 2_500] and all(abs(t - 20_000 * q) < 5 * (20_000 * q) ** 0.5 for t, q in zip(totals, p))
    for k, n in enumerate((10_000, 7_500, 2_500)):
        assert sorted(r.draw for r in free if r._k == k) == list(range(totals[k]))
        for turn in range(3):
            blocks = [r.block for r in free if r._k == k and r.draw // n == turn]
            assert len(set(blocks)) == len(blocks) and all(0 <= b < n for b in blocks)


@pytest.mark.parametrize("near", [0.0, 0.002, 0.05])
def test_slots_stay_near_targets(spark, monkeypatch, near):
    monkeypatch.setattr(mixing, "SLOTS_A_SHARD", 32)
    sizes, targets = [4000, 40, 900, 1, 7000], [6000.0, 120.0, 300.0, 3.0, 5518.0]
    got = mixing.slots(sources_of(spark, sizes, targets), block=8, near=near).collect()
    for k, (s, t) in enumerate(zip(sizes, targets)):
        n = -(-s // 8)
        want = min(3 * n, round(t * n / s))
        mine = [r.draw for r in got if r._k == k]
        assert sorted(mine) == list(range(len(mine))) and len(mine) <= 3 * n
        assert want * (1 - near) <= len(mine) <= want * (1 + near)


def test_taken_by_brute_force(spark):
    """`taken` from the table of blocks: every document's words of every slot's block, counted one by one."""
    df, rows = docs(spark, 120)
    block = 16
    got = mixing.mix(df, block=block).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    sizes = df.select("source", mixing.word_count(F.col("text")).alias("size"))
    blocks = {}
    for r in mixing.slots(mixing.targets(sizes), block=block).collect():
        blocks[r._k, r.block] = blocks.get((r._k, r.block), 0) + 1
    for k, name in enumerate(names):
        total = sum(words(t) for _, t, s, _ in rows if s == name)
        ids = {d for d, _, s, _ in rows if s == name}
        mine = sum(r.taken for r in got if r.doc_id in ids and r.source_size == total)
        assert mine == sum(times * (min(total, (b + 1) * block) - b * block) for (q, b), times in blocks.items() if q == k)
    # One document a source: it has all of the source's blocks.
    alone = spark.createDataFrame([(i, "w " * m, chr(97 + i)) for i, m in enumerate((500, 37, 90))], "doc_id long, text string, source string")
    table = mixing.targets(alone.select("source", mixing.word_count(F.col("text")).alias("size")))
    want = {0: 0, 1: 0, 2: 0}
    for r in mixing.slots(table, block=block).collect():
        want[r._k] += min((500, 37, 90)[r._k], (r.block + 1) * block) - r.block * block
    assert {r.doc_id: r.taken for r in mixing.mix(alone, block=block).collect()} == want
