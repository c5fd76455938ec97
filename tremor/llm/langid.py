"""Operator 9, language identification: rank-order profiles of n-grams, compared by out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import DOUBLE, STRING, broadcast_if_small, extended, map_arrow, uniform

PROFILE = 300
DOCS_PER_LANGUAGE = 600
_BITS = np.uint64(21)
_EDGE = 1
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; made once a worker."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x33480) if chr(c).isalpha()]] = True  # no letters are assigned beyond
        _letters = table
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 lower-case letters, word edges included, as numbers, with their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letter_table()[codes]
    c = np.full(len(codes) + 2, _EDGE, dtype=np.uint64)
    c[1:-1][letter] = codes[letter]
    c = c[np.concatenate(([True], (c[1:] != _EDGE) | (c[:-1] != _EDGE)))]  # one edge between words
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    keys = np.concatenate((c[c != _EDGE], two, three))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """All languages' profiles as one sorted list of n-grams with the rank in each language, or the rank of the absent."""

    def __init__(self, by_language: dict[str, list[int]]):
        self.names = sorted(by_language)
        self.keys = np.array(sorted({k for v in by_language.values() for k in v}), dtype=np.uint64)
        self.rank = np.full((len(self.keys) + 1, len(self.names)), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.rank[np.searchsorted(self.keys, np.array(by_language[name], dtype=np.uint64)), i] = np.arange(len(by_language[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, ties by name; and how much nearer it is than the second."""
        own = ranked(*grams(text))
        if not len(own) or not self.names:
            return "und", 0.0
        absent = len(self.keys)  # without any n-gram learnt, all are absent and the first language by name wins
        at = np.searchsorted(self.keys, own)
        known = self.keys[np.minimum(at, absent - 1)] == own if absent else np.zeros(len(own), bool)
        rank = self.rank[np.where(known, at, absent)]
        far = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own))[:, None]))
        d = far.sum(axis=0)
        order = np.argsort(d, kind="stable")
        best = float(d[order[0]])
        second = float(d[order[1]]) if len(order) > 1 else float(PROFILE * len(own))
        return self.names[order[0]], second / (best + second) if best + second else 1.0


def train_part(ids: str = "doc_id") -> Column:
    """Rows that may teach: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(ids).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles from about docs_per_language documents of each language (the bound; chosen by a hash of the id), whole texts.

    Rows with a null language or text teach nothing. What reaches the driver is one count and 300 n-grams a language.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_lang is not null and _text is not null")
    counts = usable.groupBy("_lang").agg(F.count("*").alias("_n")).collect()
    if not counts:
        return Profiles({})
    share = docs.sparkSession.createDataFrame([(r["_lang"], docs_per_language / r["_n"]) for r in counts], "_lang string, _share double")
    sample = usable.join(broadcast_if_small(share, len(counts)), "_lang").where((uniform("_id", F.lit(9)) < F.col("_share")) | (F.col("_share") >= 1)).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for lang, text in zip(b["_lang"].to_pylist(), b["_text"].to_pylist()):
                held.setdefault(lang, []).append(grams(text))
            for lang, found in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])
            held = {}

    sums = map_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    for keys in (["lang", "salt"], ["lang"]):  # first in parts, so that no language gathers all its n-grams in one task
        top = top.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    by: dict[str, list[tuple[int, int]]] = {r["_lang"]: [] for r in counts}
    for r in top.select("lang", "gram", "r").collect():
        by[r["lang"]].append((r["r"], r["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in by.items()})


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the predicted language and a score in [0, 1]; `und` and 0 for a text without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            found = [p.nearest(t) for t in b[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    picked = docs.select(id_col, text_col)
    return map_arrow(picked, run, extended(picked.select(id_col).schema, lang_pred=STRING, score=DOUBLE))


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, then predict every whole text.

    Without any labelled text every prediction is `und`; where the labelled texts have no letters, the first language by name
    is predicted for a text that has some. Repeated rows are predicted each; a null id is not held out; an
    empty table gives an empty result.
    """
    profiles = fit(docs.where(train_part(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return identify(docs, profiles, id_col=id_col, text_col=text_col).select(id_col, (~train_part(id_col)).alias("held_out"), "lang_pred", "score")


__all__ = ["Profiles", "fit", "grams", "identify", "languages", "ranked"]
