import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tremor.llm import registry, spelling


def near(a, b):
    """Exactly one code point more, less or other, tried at every place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    n = Counter()
    for w, c in words:
        if w:
            n[w] += c
    form, out = {}, {}
    others = {w: [x for x in n if near(w, x)] for w in n}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(others[w]), form[w] and n[form[w]])
    return out


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed, size=400):
    rng = random.Random(seed)
    letters = "abcdeéß÷"
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) if not words or rng.random() < 0.3 else rng.choice(list(words))
        i, k = rng.randrange(len(w) + 1), rng.randrange(3)
        w = w[:i] + (rng.choice(letters) if k else "") + w[i + (k < 2) :]
        if w:
            words[w] = int(10 ** rng.uniform(0, 6))
    return list(words.items())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("log2", [16, 29])
def test_groups_equal_brute_force(spark, monkeypatch, seed, log2):
    monkeypatch.setattr(spelling, "SLICE", 50)
    full = spelling.bitmap
    monkeypatch.setattr(spelling, "bitmap", lambda df, column, rows: full(df, column, rows, log2))  # a small one lets more through
    words = [*vocabulary(seed), (None, 5), ("", 7), ("abc", 1), ("abc", 2)]
    df = spark.createDataFrame([(w, n, 1) for w, n in words], "word string, n long, id int")
    assert by_word(spelling.spelling_groups(df)) == brute([w for w in words if w[0]])


def test_every_edit_comes_once():
    words, letters = ["aab", "b", "éé", "aaaa"], "abé"
    found = {k: Counter() for k in range(len(words))}
    for word, h, edit in spelling.edits(words, np.array(sorted(map(ord, letters))), 3):
        for w, x, e in zip(word.tolist(), h.tolist(), edit.tolist()):
            at, kind, c = e // 768, e // 256 % 3, chr(e % 256)
            s = words[w]
            made = s[:at] + ("" if kind == spelling.DELETE else c) + s[at + (kind != spelling.INSERT) :]
            found[w][made] += 1
            if made:
                assert int(spelling.Places([made]).hashes[0]) == x
    for k, w in enumerate(words):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))}
        want |= {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) if i + j <= len(w) for c in letters} - {w}
        assert set(found[k]) == want and set(found[k].values()) == {1}


def test_long_words_and_chains(spark):
    long = "".join(random.Random(3).choices("abc", k=30_000))
    words = [(long, 1), (long + "a", 10), (long[:7] + long[8:], 1000), *[("chained" + "x" * k, 10**k) for k in range(12)]]
    got = by_word(spelling.spelling_groups(spark.createDataFrame(words, "word string, n long")))
    assert got[long][:2] == (words[2][0], words[2][0]) and got[long][3] == 2 and got[long + "a"][3] == 1
    assert all(got["chained" + "x" * k][1] == "chained" + "x" * 11 for k in range(12))


def test_words_of_documents(spark):
    rng = random.Random(8)
    base = ["Wonderful", "naïveté", "étrange", "tellement", "short", "Ärger÷×", "AEIOUxyz"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(60)) + "!" + rng.choice(base) + "9x") for i in range(80)]
    rows += [(500, None), (501, ""), (None, "Wonderful Wonderful " * 40), rows[0]]
    want = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, word string")
    vocab = spelling.vocabulary(spelling.slipped(spelling.letter_runs(df)))
    assert {r.word: r.n for r in vocab.collect()} == want and any(w not in " ".join(base).lower() for w in want)
    assert by_word(spelling.spelling_groups(vocab)) == brute(list(want.items()))
    assert spelling.spelling_groups(spelling.vocabulary(spelling.slipped(spelling.letter_runs(df.limit(0))))).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(vocab, times=1)


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = registry.op11_spelling(spark, sf)
    want = c.sql(registry.ORACLE_SQL["op11_spelling"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) > 100
