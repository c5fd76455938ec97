"""Operator 1, quality classifier: compressed size under a dictionary of good text against one of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import DOUBLE, LONG, extended, map_arrow

BLOCK = 4096
LEVEL = 3


class Model:
    """Two dictionaries and the logistic curve that turns their size difference into a probability."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        found = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return found

    def score(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        z = features(good, bad) @ np.asarray(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def features(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """1, the normalised size difference, and it again weighted by how much text backs it."""
    d = 20.0 * (bad - good) / np.maximum(bad + good, 1.0)
    return np.stack([np.ones_like(d), d, d * np.log1p(good / 64.0)], axis=1)


def sizes(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, int]:
    """Compressed bytes of the whole text under each dictionary, block by block, so that the dictionary matters to the end."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    good, bad = compressors
    a = b = 0
    for i in range(0, len(raw), BLOCK):
        block = raw[i : i + BLOCK]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return a, b


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b"".join(blocks)[-size:] or b"\0" * 16


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = 1500, blocks_per_class: int = 3000, dictionary_bytes: int = 112_640) -> Model:
    """Fit on a bounded sample of the labelled rows given.

    The bound: per class, docs_per_class documents (the lowest hashes of the id) give at most blocks_per_class blocks of
    4096 bytes for the dictionaries, and as many other documents calibrate the score. Rows with a null id or label, or a
    label other than 0 and 1, are passed over; of an id with several labels the lowest counts. Without both classes, the
    score of every text is the share of label 1 (0.5 without labels).
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        odds = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -6, 6))
        return Model(b"\0" * 16, b"\1" * 16, [odds, 0.0, 0.0])
    parts = [rows.where(F.col("_y") == y).withColumn("_h", F.xxhash64("_id", F.lit(17))).orderBy("_h", "_id").limit(2 * docs_per_class) for y in (0, 1)]
    chosen = parts[0].union(parts[1]).withColumn("_fit", F.pmod("_h", F.lit(2)) == 0).drop("_h")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys, hs, out = [], [], [], []
            for i, y, t in zip(b["_id"].to_pylist(), b["_y"].to_pylist(), b["_text"].to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for k in range(0, len(raw), BLOCK):
                    ids.append(str(i)), ys.append(y), hs.append(k), out.append(raw[k : k + BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(hs, pa.int64()), pa.array(out, pa.binary())], names=["id", "y", "at", "block"])

    cut = map_arrow(text.where("_fit"), blocks, "id string, y int, at long, block binary").withColumn("h", F.xxhash64("id", "at"))
    dictionaries = []
    for y in (1, 0):
        got = cut.where(F.col("y") == y).orderBy("h", "id", "at").limit(blocks_per_class).select("block").collect()
        dictionaries.append(_dictionary([bytes(r[0]) for r in got], dictionary_bytes))
    model = Model(dictionaries[0], dictionaries[1], [0.0, 1.0, 0.0])
    seen = measure(text.where("not _fit"), model, id_col="_id", text_col="_text", keep=["_y"]).select("_y", "good_bytes", "bad_bytes").limit(4 * docs_per_class).collect()
    if len({r[0] for r in seen}) == 2:
        y = np.array([r[0] for r in seen], dtype=float)
        x = features(np.array([r[1] for r in seen], float), np.array([r[2] for r in seen], float))
        w = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
        model.weights = _logistic(x, y, w * len(y) / w.sum()).tolist()
    return model


def measure(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, kept columns, compressed bytes under both dictionaries and the score. A null text counts as empty."""
    keep = keep or []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        both = m.compressors()
        for b in batches:
            got = [sizes(t, both) for t in b[text_col].to_pylist()]
            good, bad = (np.array([g[k] for g in got], dtype=np.int64) for k in (0, 1))
            columns = [b[c] for c in [id_col, *keep]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good), pa.array(bad), pa.array(m.score(good.astype(float), bad.astype(float)))], names=[id_col, *keep, "good_bytes", "bad_bytes", "score"])

    picked = docs.select(id_col, *keep, text_col)
    schema = extended(picked.drop(text_col).schema, good_bytes=LONG, bad_bytes=LONG, score=DOUBLE)
    return map_arrow(picked, run, schema)


def train_part(ids: str = "doc_id") -> Column:
    """Rows that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(ids).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Score every whole text; labels come only from rows outside the held-out third.

    Null and empty texts get the score of no evidence. A null id is not held out. Repeated rows are scored each. Only the
    named columns are read, so others may have any name; an empty table gives an empty result.
    """
    usable = labels.where(train_part(id_col))
    model = fit(docs, usable, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = measure(docs, model, id_col=id_col, text_col=text_col, keep=keep)
    return scored.select(
        id_col, *(keep or []), (~train_part(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "good_bytes", "bad_bytes"
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    usable = labels.where(train_part(id_col))
    model = fit(docs, usable, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        both = m.compressors()
        for b in batches:
            got = np.array([sizes(t, both) for t in b[text_col].to_pylist()], dtype=float).reshape(-1, 2)
            yield b.filter(pa.array(m.score(got[:, 0], got[:, 1]) >= 0.5))

    return map_arrow(docs, run, docs.schema)


__all__ = ["Model", "fit", "keep_good", "measure", "quality"]
