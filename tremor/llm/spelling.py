"""Operator 11, spelling variants: every distinct edit of every word is emitted and hash-joined to the vocabulary.

A word of length L over an alphabet of A letters has up to L deletions, L(A - 1) replacements and L(A - 1) + A insertions; each
distinct one is made exactly once. Candidates travel as 64-bit polynomial hashes with the edit that makes them, 24 bytes
whatever the word's length, so a word of a million letters costs no more memory than many short ones. What the join finds is
rebuilt from the edit and compared as a string: equal hashes of unequal strings fall out and no distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import discarding, map_arrow, stage
from tremor.llm.suffix import Seen, bitmap

#: Latin letters with those of Latin-1: the proven bound of the observed alphabet is 26 + 64 letters.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
SLICE = 8192  # places of words that are edited together
WORDS_PER_TASK = 2048
DELETE, REPLACE, INSERT = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MULTIPLIER = np.uint64(_BASE)


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): every maximal run of letters in the whole text, A-Z lower-cased, once an occurrence."""
    low = F.translate(text_col, UPPER, LOWER)
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN})"))).alias("word"))


def slipped(runs: DataFrame, every: int = 31) -> DataFrame:
    """(word): where `every` divides h = crc32("id:word"), the code point h % length is left out. A null id counts as empty text."""
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    h = runs.select("word", F.crc32(named.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words that are long and frequent enough; null words are none."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point, spread by multiplications and shifts."""
    x = codes.astype(np.uint64) + np.uint64(1)
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Places:
    """The places 0..L of some words as flat arrays: the letters, hashes of what lies before, and the whole word's hash."""

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.code = codes.astype(np.int64)  # one place more than letters a word: the end, with code 0
        self.word = np.repeat(np.arange(len(words)), lengths + 1)
        first = np.cumsum(lengths + 1) - (lengths + 1)
        self.at = np.arange(len(codes)) - first[self.word]
        self.end = self.at == lengths[self.word]
        powers = np.ones(int(lengths.max(initial=0)) + 1, dtype=np.uint64)
        np.multiply.accumulate(np.concatenate((powers[:1], np.full(len(powers) - 1, _MULTIPLIER))), out=powers)
        self.power = powers[self.at]
        self.value = np.where(self.end, np.uint64(0), letter_values(self.code))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value * self.power, dtype=np.uint64)))
        self.before = sums[:-1] - sums[first][self.word]
        self.whole = self.before[first + lengths][self.word]
        self.hashes = self.before[first + lengths]
        self.repeats = np.zeros(len(codes), bool)
        self.repeats[1:] = (self.at[1:] > 0) & (self.code[1:] == self.code[:-1])


def edits(words: list[str], letters: np.ndarray, places_at_once: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the word, hash of the candidate, edit) of every distinct single edit, a slice of places at a time.

    Of equal letters in a row only the first is deleted, and nothing is inserted before its equal: so no candidate comes twice.
    An edit is (place * 3 + kind) * 256 + letter.
    """
    if not words:
        return
    p, values = Places(words), letter_values(letters)
    for a in range(0, len(p.at), places_at_once):
        s = slice(a, a + places_at_once)
        word, at, code, power, before, whole = (x[s] for x in (p.word, p.at, p.code, p.power, p.before, p.whole))
        gone = ~p.end[s] & ~p.repeats[s]
        cut = before + (whole - before - p.value[s] * power) * _INVERSE
        kinds = [(word[gone], cut[gone], (at[gone] * 3 + DELETE) * 256)]
        other = code[:, None] != letters
        put = values * power[:, None]
        for kind, mask, key in (
            (REPLACE, other & ~p.end[s][:, None], (whole - p.value[s] * power)[:, None] + put),
            (INSERT, other, (before + (whole - before) * _MULTIPLIER)[:, None] + put),
        ):
            row, letter = np.nonzero(mask)
            kinds.append((word[row], key[mask], (at[row] * 3 + kind) * 256 + letters[letter]))
        yield tuple(np.concatenate(x) for x in zip(*kinds))


def hashed(vocab: DataFrame) -> DataFrame:
    """(h, id) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Places(b["word"].to_pylist()).hashes.view(np.int64)), b["id"]], names=["h", "id"])

    return map_arrow(vocab.select("id", "word"), run, "h long, id long")


def candidates(vocab: DataFrame, alphabet: list[str], seen: Seen) -> DataFrame:
    """(h, id, edit): of all distinct deletions, replacements and insertions over the alphabet those that the bitmap may hold."""
    letters = np.array(sorted(map(ord, alphabet)), dtype=np.int64)
    shared = vocab.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["id"].to_numpy()
            for word, h, edit in edits(b["word"].to_pylist(), letters):
                may = shared.value.has(h)
                word, h, edit = word[may], h[may], edit[may]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[word]), pa.array(edit)], names=["h", "id", "edit"])

    return map_arrow(vocab.select("id", "word"), run, "h long, id long, edit long")


def near_words(vocab: DataFrame) -> DataFrame:
    """(id, other): each pair of words of a vocabulary (id, word) that are one edit apart, in both directions, once each.

    A bitmap of the vocabulary's hashes, of 64 MB at most, goes to the tasks, so that few candidates are shuffled that find nothing;
    beyond some tens of millions of words it only lets more of them through. An adverse set of words can only make unequal
    strings meet, which the comparison drops.
    """
    words = vocab.count()
    alphabet = [r[0] for r in vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]  # 90 at most
    if not alphabet:
        return vocab.sparkSession.createDataFrame([], "id long, other long")
    dealt = vocab.repartition(max(1, -(-words // WORDS_PER_TASK)), "id")
    known = stage(hashed(vocab).withColumnRenamed("id", "other"), "hashes", keep=True)
    met = candidates(dealt, alphabet, bitmap(known, "h", words)).join(known, "h").select("id", "edit", "other")
    spelt = met.join(vocab.select("id", "word"), "id").join(vocab.select(F.col("id").alias("other"), F.col("word").alias("found")), "other")
    kind, at = F.floor(F.col("edit") / 256) % 3, F.floor(F.col("edit") / 768).cast("int")
    made = F.concat(
        F.substring("word", F.lit(1), at),
        F.when(kind == DELETE, "").otherwise(F.char(F.col("edit") % 256)),
        F.substring("word", at + F.when(kind == INSERT, 1).otherwise(2), F.length("word")),
    )
    return spelt.where(made == F.col("found")).select("id", "other")


def spelling_groups(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """Per distinct word of (word, n): its form, root, n, n_near and form_n.

    The form is the near word of largest n, ties to the smallest in code-point order, if that n is at least `times` the word's;
    the root is reached by following forms. Each form is `times` as frequent, so the largest count bounds the chains and with
    them the number of doublings. Null and empty words are left out; rows that repeat a word count together; an
    empty vocabulary gives an empty result.
    """
    if times < 2:
        raise ValueError("forms must be more frequent, or their chains could be circles")
    spark = words.sparkSession
    with discarding(spark):
        one = words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
        vocab = stage(one.withColumn("id", F.monotonically_increasing_id()), "vocabulary", keep=True)
        other = vocab.select(F.col("id").alias("other"), F.struct((-F.col("n")).alias("n"), "word", "id").alias("best"))
        near = near_words(vocab).join(other, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
        met = vocab.join(near, "id", "left")
        frequent = -F.col("best.n") >= times * F.col("n")
        ruled = stage(met.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("best")), "ruled", keep=True)
        links = ruled.where("best is not null").select("id", F.col("best.id").alias("to"))
        most, edges = vocab.agg(F.max("n")).first()[0] or 0, 0
        while most >= times:
            most, edges = most // times, edges + 1
        reached = 1
        while reached < edges:
            ahead = links.select(F.col("id").alias("to"), F.col("to").alias("_on"))
            links = stage(links.join(ahead, "to", "left").select("id", F.coalesce("_on", "to").alias("to")), "links", keep=True)
            reached *= 2
        roots = links.join(vocab.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
        found = ruled.join(roots, "id", "left")
        return found.select("word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))
