import hashlib
import os
import random

import pytest

from tremor.llm import merges, registry

PATH = registry.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return merges.Merges(PATH)


def texts(model):
    rng = random.Random(4)
    bits = ["▁", " ", "   ", " " * 17, "the", "ing", "tion", "e", "é", "日本", "１", "\0", "🙂", "\n", "\t", "#", "==", "don't", "<s>", "<0x41>", "a" * 9, "ab", "​"]
    out = ["", " ", "▁", "\n", "🙂", "a" * 5000, " " * 3001 + "x", "=-" * 2000, "ab" * 3000]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rng.choice(model.piece) for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    return out


def test_ids_are_those_of_the_library(model):
    for t in texts(model):
        assert model.encode(t) == model.model.encode(t), t[:200]
    assert model.encode(None) == []


def test_bounded_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(merges, "KEPT_STRETCHES", 5)
    monkeypatch.setattr(merges, "KEPT_PAIRS", 5)
    m = merges.Merges(PATH)
    for t in texts(m)[:200]:
        assert m.encode(t) == m.model.encode(t)
    assert len(m.kept) <= 5 and len(m.before) <= 5 and len(m.pairs) <= 6


def test_walk_needs_no_cuts(model, monkeypatch):
    import re

    monkeypatch.setattr(model, "stretch", re.compile("(?s:.+)"))
    model.kept.clear(), model.before.clear()
    for t in texts(model)[:400]:
        assert model.encode(t) == model.model.encode(t)
    model.kept.clear(), model.before.clear()


def test_backtracking_happens(model):
    longest = [model.automaton.longest_prefix(w) for w in model.piece]
    assert max(longest) > 10
    greedy = 0
    for w in random.Random(1).choices(model.piece, k=3000):
        w = w + random.Random(w).choice(model.piece)
        if set(w) <= model.letters:
            t = max((p for p in range(1, len(w) + 1) if w[:p] in set(model.piece[k] for k in model.walk(w[:p])) and len(model.walk(w[:p])) == 1), default=0)
            greedy += len(model.piece[model.walk(w)[0]]) < t
    assert greedy > 20  # the first piece is often not the longest that fits


def test_documents(spark, model):
    rows = [(1, "Hello  world\n", "i"), (2, None, "i"), (3, "", "i"), (None, "né 🙂", "i"), (1, "Hello  world\n", "i"), (4, "long " * 50_000, "i"), (5, "x" * 100_000, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = merges.encoded(df, PATH)
    want = sorted((str(d), model.model.encode(t or ""), model.model.decode(model.model.encode(t)) if t else "") for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want
    digest = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in merges.id_digests(got).collect())
    assert digest == sorted((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in want)
    assert merges.encoded(df.limit(0), PATH).collect() == []


def test_batches_leave_early(spark, monkeypatch):
    monkeypatch.setattr(merges, "IDS_AT_ONCE", 3)
    df = spark.range(200).selectExpr("id as doc_id", "repeat('ab c', id % 5) as text")
    assert merges.encoded(df, PATH).count() == 200


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_over_documents(spark, model):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op12_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = model.model.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.model.decode(ids).encode()).hexdigest()
