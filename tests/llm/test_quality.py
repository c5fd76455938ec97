import random

from pyspark.sql import functions as F

from tremor.llm import quality


def corpus(spark, n=240):
    rng = random.Random(2)
    words = ["river", "stone", "walks", "slowly", "under", "bright", "cloud", "house"]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = i % 3 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws) + ".", "x", 0.5))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(n, None, "x", 0.5), (n + 1, "", "x", 0.5), (None, "river stone", "x", 0.5), (n + 2, "river stone walks " * 20000, "x", 0.5), docs[5]]
    labels += [(None, 1, 0), (n, None, 0), labels[3], (n + 9, 7, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, held_out string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_shape(spark):
    docs, labels = corpus(spark)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: int(i % 3 != 0) for i in range(240)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.held_out for r in got}[None] is False
    assert {r.doc_id: r.predicted for r in got}[242] == 1


def test_held_out_rows_do_not_teach(spark):
    docs, labels = corpus(spark)
    flipped = labels.withColumn("quality", F.when(quality.train_part(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_one_class_none_and_empty(spark):
    docs, labels = corpus(spark, 30)
    assert all(r.score > 0.5 for r in quality.quality(docs, labels.where("quality = 1")).collect())
    assert all(r.score == 0.5 for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_keep_good_keeps_columns(spark):
    docs, labels = corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 240} == {i for i in range(240) if i % 3}
