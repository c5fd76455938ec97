"""Operator 13, periodic runs of words: Karp-Miller-Rosenberg names of power-of-two blocks, grid candidates, extension by names.

Level k names the blocks of 2^k words, equal names for equal blocks; a block that occurs once in its document needs no name. The
longest common extension of two places goes down the levels, once each. A run of period p and four periods holds a multiple of
3p that equals the word p further on, so these places are the only candidates. Every step is a few array operations over many
documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import LONG, STRING, WORD, extended, map_arrow

LEAST, PERIODS, GRID = 6, 4, 3  # words in a run, periods in a run, periods between candidates
WORDS_AT_ONCE = 1 << 18
CANDIDATES_AT_ONCE = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(c, LONG) for c in ("start", "length", "period")]))


def block_names(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at each place, -1 where a block occurs once or passes the document's end.

    `first` names single words, with different names in different documents; the last place of each array belongs to no word.
    """
    levels, names, size = [], first, 1
    while True:
        at = np.flatnonzero(names >= 0)
        _, inverse, counts = np.unique(names[at], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        named = np.full(len(names), -1, dtype=np.int64)
        named[at[again]] = inverse[again]
        if not again.any():
            return levels
        levels.append(named)
        at = at[again]
        at = at[at + 2 * size <= end[at]]
        at = at[named[at + size] >= 0]
        names = np.full(len(named), -1, dtype=np.int64)
        names[at] = named[at] * (len(counts) + 1) + named[at + size]
        size *= 2


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from i and j on, for i < j in one document."""
    agree = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        a = name[i + agree]
        agree += ((a >= 0) & (a == name[j + agree])) * (1 << k)
    return agree


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before i and j."""
    agree = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, from_ = levels[k], i - agree - (1 << k)
        a = name[np.maximum(from_, 0)]
        agree += ((from_ >= 0) & (a >= 0) & (a == name[np.maximum(j - agree - (1 << k), 0)])) * (1 << k)
    return agree


def grid(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): every multiple of three periods in every document, for each period that can make a run there."""
    longest = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    doc = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(doc)) - (np.cumsum(longest) - longest)[doc] + 1
    many = (sizes[doc] - period - 1) // (GRID * period) + 1
    upto = np.cumsum(many)
    a = 0
    while a < len(doc):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + CANDIDATES_AT_ONCE, side="right")))
        which = np.repeat(np.arange(a, b), many[a:b])
        step = np.arange(len(which)) - (upto[which] - many[which] - done)
        yield first[doc[which]] + GRID * period[which] * step, period[which]
        a = b


def runs_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of some documents as rows (document, start, length, period) in that order but by period before length; and a
    mask over all their words of those that a run holds after its first period."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    names = np.full(total + 1, -1, dtype=np.int64)
    at = 0
    for w in words:
        known: dict[bytes, int] = {}
        for k, x in enumerate(w, at):
            names[k] = known.setdefault(x, k)
        at += len(w)
    end = np.append(np.repeat(first + sizes, sizes), 0)
    levels = block_names(names, end)
    found = []
    for i, p in grid(first, sizes) if levels else ():
        same = (levels[0][i] >= 0) & (levels[0][i] == levels[0][i + p])
        i, p = i[same], p[same]
        start, stop = i - backward(levels, i, i + p), i + p + forward(levels, i, i + p)
        long = stop - start >= np.maximum(LEAST, PERIODS * p)
        found.append(np.unique(np.stack((start, stop, p), axis=1)[long], axis=0))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Of a stretch's periods that fit four times, the smallest divides the others.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    start, stop, period = rows[new].T
    depth = np.zeros(total + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, stop, -1)
    doc = np.searchsorted(first, start, side="right") - 1
    out = np.stack((doc, start - first[doc] if len(doc) else start, stop - start, period), axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], np.cumsum(depth)[:-1] > 0


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its runs (start, length, period; by start, then period) and the text without their repeated periods.

    Words are runs without space and \\t..\\r. A run is a stretch of smallest period q and at least max(6, 4q) words that no
    neighbour extends; a word is dropped if a run holds it after that run's first q words, the others are joined by one space.
    A null or empty text has no words, no runs and an empty text; repeated rows are treated each; an empty table gives
    an empty result. A task holds the names of about 2^18 words, or of one document if that is longer (some 40 bytes a word
    and level, of which a text without long repeats has few).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, held, size = 0, [], 0
            for k, t in enumerate(b[text_col]):
                held.append((t.as_py() or "").encode().split())  # bytes split at exactly these characters
                size += len(held[-1])
                if size >= WORDS_AT_ONCE or k == b.num_rows - 1:
                    yield made(b[id_col].slice(a, len(held)), held)
                    a, held, size = k + 1, [], 0

    def made(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        runs, dropped = runs_of(words)
        offsets = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
        texts, at = [], 0
        for k, w in enumerate(words):
            gone = dropped[at : at + len(w)]
            at += len(w)
            texts.append(b" ".join([x for x, g in zip(w, gone.tolist()) if not g] if offsets[k + 1] > offsets[k] else w).decode())
        rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(texts, pa.string())], names=[id_col, "runs", "collapsed"])

    picked = docs.select(id_col, text_col)
    return map_arrow(picked, run, extended(picked.select(id_col).schema, runs=RUNS, collapsed=STRING))


def repeated_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id, text) in which every tenth document, by crc32 of its id, ends in a repetition of some of its words.

    With h = crc32(id), g = floor(h / 10) and n words, where 10 divides h each word from a = g % n on becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id alters nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    w = docs.select(id_col, text_col, F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(f"({WORD})"))).alias("_w"))
    w = w.withColumn("_n", F.coalesce(F.size("_w"), F.lit(0))).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    w = w.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    said = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i))), " ")
    return w.select(id_col, F.when(F.col("_n") > 0, said).otherwise(F.col(text_col)).alias(text_col))


def run_digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row of periodic_runs(): the number of runs, the longest (ties: smallest start, then period), and digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    b = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.p")
    return b.select(id_col, "n_runs", F.col("b.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


__all__ = ["periodic_runs", "repeated_tails", "run_digests", "runs_of"]
