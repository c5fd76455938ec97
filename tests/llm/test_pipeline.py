"""The stages against what they promise, on a small corpus, and the whole run against the stages one by one."""

import random

import corpus_pipeline


def corpus(spark, folder):
    rng = random.Random(11)
    words = ["river", "stone", "walks", "slowly", "under", "bright", "cloud", "house", "green", "lamp", "seven", "about"]
    docs, labels = [], []
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        bad = i % 4 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(200 + i, docs[i][1] + " end", "en", "s0", 9) for i in range(1, 30) if i % 4]
    docs += [(300, docs[5][1] + " token=0123456789abcdef0123456789abcdef " + docs[9][1], "en", "s1", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema, seen = docs.columns, []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == schema
    bad = {i for i in range(150) if i % 4 == 0}
    kept = {r.doc_id for r in seen[0]}
    assert len(bad & kept) <= 2 and len({r[0] for r in rows} - bad - kept) <= 4
    after = {r.doc_id for r in seen[1]}
    assert after <= kept and not any(200 < i < 230 and i - 200 in after for i in after)
    secret = next(r for r in seen[2] if r.doc_id == 300)
    assert "[SECRET]" in secret.text and "0123456789abcdef" not in secret.text and secret.n_chars == len(secret.text)
    assert {r.doc_id for r in seen[2]} == after and {r.doc_id for r in seen[3]} <= after
    assert sum(r.piece == 0 for r in seen[4]) == len(seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, seen[4]))
