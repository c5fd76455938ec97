import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tremor.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def hist(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


def test_plan_is_whole_and_fits():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        found = packing.plan(hist(sizes), capacity)
        assert sorted((s for m, n in found for s in m * n), reverse=True) == sizes
        assert all(sum(m) <= capacity and n > 0 for m, n in found)


def test_reduction_never_costs_a_bin():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([12, 20, 31])
        sizes = sorted((rng.randint(2, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        count = np.zeros(capacity + 1, dtype=np.int64)
        for s in sizes:
            count[s] += 1
        fixed = packing.dominance(count, capacity)
        rest = [int(s) for s in np.repeat(np.arange(capacity + 1), count)][::-1]
        assert sum(n for _, n in fixed) + brute(rest, capacity) == brute(sizes, capacity)


def test_word_ids_are_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    texts = [None, "", " \t\n", "Hello, World!! don't STOP it's", "a b c éclair ẞ ÉCOLE İX ΣΑΣ", "x<|endoftext|>y 12a3 <|startoftext|>", "naïve—dash “q” Ünïcode\x1cz", "été\nÇA\r\nva? 日本語 🙂🙂", "w" * 5000]
    got = packing.WordIds(PATH, words=3, cores=3).of(texts, together=10)
    for x, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_pack(spark):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma,", "delta!!", "épée", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 300])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "the end " * 3000), (None, "no id"), (3, rows[3][1])]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, piece string, length int")
    got = packing.pack(df, PATH, capacity=512).collect()
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [1]
    want = sorted((-1 if d is None else d, k, 512 * k, len(p := ids(x)[512 * k : 512 * k + 512]), zlib.crc32(np.array(p, "<u4").tobytes())) for d, x in rows for k in range(-(-len(ids(x)) // 512)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(by) <= 1.1 * (total / 512) + 1


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("sizes", [[4096] * 5, [1] * 9000, [2048, 2049] * 50])
def test_known(sizes):
    n = sum(k for _, k in packing.plan(hist(sizes)))
    assert n == {4096: 5, 1: 3, 2048: 75}[sizes[0]]


def test_words_are_encoded_together():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    found = packing.WordIds(PATH)
    asked = []
    encode = found._encode
    found._encode = lambda items: asked.append(len(items)) or encode(items)
    texts = [" ".join(rng.choice(plain) + rng.choice(["", ",", "!?", "."]) for _ in range(400)) for _ in range(30)]
    got = [np.frombuffer(raw, "<u4").tolist() for raw in found.of(pa.array([*texts, None]))]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts] + [[]]
    assert sum(asked) < 100  # one call of the tokenizer's does for many words


def test_words_that_cannot_be_told_apart():
    t = Tokenizer.from_file(PATH)
    found = packing.WordIds(PATH)
    found.last[:] = False
    texts = ["one two, three", "<|ENDOFTEXT|> <|endoftext|>x", "a\x0bb\x0cc  d é Ȩ́", "it's ''s 's"]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in found.of(texts, together=20)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
