import random
from collections import Counter

from tremor.llm import langid

SEEDS = {"en": "the and ing ion ent her that with was for", "fr": "eau eux ment que les des é ç tion par", "de": "sch ung ein der die ß ü cht und ge"}


def brute(text):
    """Counts of 1- to 3-grams, by strings."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    line = "_" + "_".join(words) + "_"
    found = Counter(c for c in line if c != "_")
    for n in (2, 3):
        found.update(line[i : i + n] for i in range(len(line) - n + 1))
    return found


def as_text(key):
    out = ""
    key = int(key)
    while key:
        c = key & (1 << 21) - 1
        out = ("_" if c == 1 else chr(c)) + out
        key >>= 21
    return out


def test_grams_match_brute_force():
    for t in [None, "", "12 !", "a", "Hello, wörld! 3x 日本語 𐐀𐐨 İ", "a b", "  end"]:
        keys, counts = langid.grams(t)
        assert {as_text(k): int(n) for k, n in zip(keys, counts)} == dict(brute(t)), t


def corpus(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SEEDS))
        rows.append((i, " ".join("".join(rng.choice(SEEDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(40)), lang, 1.0))
    rows += [(n, None, "en", 1.0), (n + 1, "", None, 1.0), (n + 2, "123 $$", "fr", 1.0), (None, rows[0][1], None, 1.0), (n + 3, "the and with " * 30000, None, 1.0), rows[1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), rows


def test_languages(spark):
    df, rows = corpus(spark)
    got = langid.languages(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[d].lang_pred, lang) for d, t, lang, _ in rows[:300] if by[d].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert [by[300 + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"] and by[None].held_out is False


def test_no_labels_and_empty(spark):
    df, rows = corpus(spark, 20)
    assert {r.lang_pred for r in langid.languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert langid.languages(df.limit(0)).collect() == []


def test_labelled_texts_without_letters(spark):
    rows = [(i, "12 34 !", "fr" if i % 2 else "de", 1.0) for i in range(40)] + [(100, "some words", None, 1.0), (101, "", None, 1.0)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert got[100] == ("de", 0.5) and got[101] == ("und", 0.0) and got[0] == ("und", 0.0)


def ranks(counts):
    code = lambda g: int("".join(f"{1 if c == '_' else ord(c):021b}" for c in g), 2)
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]


def test_predictions_match_brute_force(spark):
    """Out-of-place distances over strings, from profiles counted over strings: the same language and score for each text."""
    df, rows = corpus(spark, 150)
    got = langid.languages(df).collect()
    import zlib

    teach = {}
    for d, t, lang, _ in rows:
        if lang is not None and t is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            teach.setdefault(lang, Counter()).update(brute(t))
    profiles = {lang: {g: i for i, g in enumerate(ranks(c))} for lang, c in teach.items()}
    want = []
    for d, t, _, _ in rows:
        own = ranks(brute(t))
        far = sorted((sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)), lang) for lang, p in profiles.items())
        want.append((str(d), far[0][1], round(far[1][0] / (far[0][0] + far[1][0]), 9)) if own else (str(d), "und", 0.0))
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)
