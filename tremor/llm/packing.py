"""Operator 2, best-fit packing: dominance reduction, then best fit, over the counts of each document length.

Documents of one length are interchangeable, so the packing is decided on a histogram that has at most `capacity` rows
however large the corpus is. Ranking the pieces of a length, and looking up the place of each rank, is Spark's work.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import INT, LONG, buckets_for, extended, kept, map_arrow, numbered, sliced, stage

CAPACITY = 4096
END_ID = 1

# ---------------------------------------------------------------- deciding


def _smallest(count: np.ndarray, k: int, above: int = 0) -> list[int]:
    """The k smallest items, with repeats, larger than `above`; fewer if there are no more."""
    found: list[int] = []
    for s in (np.flatnonzero(count[above + 1 :]) + above + 1)[:k]:
        found += [int(s)] * min(int(count[s]), k - len(found))
        if len(found) == k:
            break
    return found


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two items of largest sum within room, the larger first."""
    sizes = np.flatnonzero(count[: room + 1])
    lo, hi, best = 0, len(sizes) - 1, None
    while lo <= hi:
        a, b = int(sizes[hi]), int(sizes[lo])
        if a + b > room or (lo == hi and count[a] < 2):
            hi -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        lo += 1
    return best


def dominance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix document sets of at most three that dominate every other set with their largest member; takes them off count.

    For the largest remaining document j with room r = capacity - j: alone if nothing fits; with the largest k that fits if
    k fills r exactly or no two fit; and with the best pair (a, b), if no three fit, a is as large as any that fits, and no
    two documents larger than b fit together. Whatever else shares a bin with j can then change places with k, or a and b,
    without needing another bin.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                room = capacity - j
                count[j] -= 1
                fits = np.flatnonzero(count[: room + 1])
                if not len(fits):
                    members: tuple[int, ...] | None = (j,)
                else:
                    k, low = int(fits[-1]), _smallest(count, 3)
                    if k == room or len(low) < 2 or low[0] + low[1] > room:
                        members = (j, k)
                    elif len(low) < 3 or sum(low) > room:
                        pair = _best_pair(count, room)
                        a, b = pair if pair else (0, 0)
                        larger = _smallest(count, 2, above=b)
                        if k >= a + b:
                            members = (j, k)
                        elif a == k and not (len(larger) == 2 and sum(larger) <= room):
                            members = (j, a, b)
                        else:
                            members = None
                    else:
                        members = None
                count[j] += 1
                if members is None:
                    break
                times = min(int(count[s]) // members.count(s) for s in set(members))
                for s in members:
                    count[s] -= times
                fixed.append((members, times))
                again = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: bins that are alike are handled together."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, members: tuple[int, ...], times: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((members, times))

    for s in np.flatnonzero(count)[::-1].tolist():
        left = int(count[s])
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                members, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            else:
                room, members, bins = capacity, (), left
            each = room // s
            full = min(bins, left // each)
            if full:
                put(room - each * s, members + (s,) * each, full)
            left -= full * each
            bins -= full
            if left and bins:
                put(room - left * s, members + (s,) * left, 1)
                left, bins = 0, bins - 1
            if bins and members:
                put(room, members, bins)
    return [x for found in by_room.values() for x in found]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one bin, number of such bins) for all documents of the histogram."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        count[s] = n
    fixed = dominance(count, capacity)
    return fixed + best_fit(count, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, how many of the length in one bin, offset of the first in its bin)."""
    rank: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for members, bins in patterns:
        offset = 0
        for s in sorted(set(members), reverse=True):
            m = members.count(s)
            found.setdefault(s, []).append((rank.get(s, 0), first_bin, m, offset))
            rank[s] = rank.get(s, 0) + m * bins
            offset += m * s
        first_bin += bins
    return {s: np.array(rows, dtype=np.int64) for s, rows in found.items()}


# ---------------------------------------------------------------- token ids

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=>?@\[-`{-~]*)")


class WordIds:
    """Token ids of a text, as little-endian 32-bit numbers, from word caches of bounded size.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Arrow splits the
    texts and numbers their different words, so that each is looked up once a slice. A word of plain letters and then plain
    signs splits there too, after lower-casing; any other word goes to the tokenizer whole.
    """

    def __init__(self, path: str, words: int = 50_000, cores: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}
        self.most = words, cores
        self.last = np.zeros(t.get_vocab_size() + 1, dtype=bool)  # the ids that end a word
        if suffix := getattr(t.model, "end_of_word_suffix", None):
            self.last[[i for w, i in t.get_vocab().items() if w.endswith(suffix)]] = True

    def _encode(self, items: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _encode_plain(self, items: list[str], together: int = 256) -> list[bytes]:
        """The ids of runs of letters or of signs; one call encodes several, which are told apart by the ids that end a word."""
        found: list[bytes] = []
        groups = [items[k : k + together] for k in range(0, len(items), together)]
        for group, raw in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) * 4 + 4
            if len(ends) == len(group):
                found += [raw[lo:hi] for lo, hi in pairwise([0, *ends.tolist()])]
            else:
                found += self._encode(group)
        return found

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word. The first words are kept for good; of their parts, what else was known may be forgotten."""
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        match, heads, tails, whole = _PLAIN.fullmatch, [], [], set()
        for w in new:
            if w.isascii() and w.isalpha():
                head, tail = w.lower(), ""
            elif m := match(w):
                head, tail = m[1].lower(), m[2]
            else:
                head, tail = w, ""
                whole.add(w)
            heads.append(head), tails.append(tail)
        if len(self.cores) > self.most[1]:
            self.cores = {"": b""}
        cores = self.cores
        odd = list(whole.difference(cores))
        cores.update(zip(odd, self._encode(odd)))
        parts = list(set(chain(heads, tails)).difference(cores))
        cores.update(zip(parts, self._encode_plain(parts)))
        made = [cores[a] + cores[b] for a, b in zip(heads, tails)]
        self.words.update(islice(zip(new, made), max(0, self.most[0] - len(self.words))))
        rest = iter(made)
        return [next(rest) if ids is None else ids for ids in found]

    def of(self, texts: pa.Array | list[str | None], together: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text, for slices of about `together` bytes at a time."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for b in sliced(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", together):
            spaced = pc.fill_null(b["text"], "")
            for c in "\n\t\r":
                spaced = pc.replace_substring(spaced, c, " ")
            words = pc.split_pattern(spaced, " ")
            different, of_word = numbered(words.flatten())
            get, of_word = self._ids(different).__getitem__, of_word.tolist()
            for lo, hi in pairwise(words.offsets.to_numpy().tolist()):
                yield b"".join(map(get, of_word[lo:hi]))


def word_ids(path: str) -> WordIds:
    """One per worker process, kept from task to task."""
    return kept(__name__, path, lambda: WordIds(path))


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece of a document of at most `capacity` ids: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(encoder.of(b[text_col])):
                raw += end
                for k, p in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[p : p + 4 * capacity]
                    at.append(i), piece.append(k), start.append(p // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b[id_col].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    picked = docs.select(id_col, text_col)
    schema = extended(picked.select(id_col).schema, piece=INT, start=LONG, length=LONG, ids_crc32=LONG)
    return map_arrow(picked, run, schema)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids; one row per piece with its sequence and offset.

    A null or empty text has the end id alone. Repeated rows are packed each; rows that tie (same id and piece) take their
    places in any order, which leaves the result the same up to swapping equals. An empty table gives an empty result.
    """
    cut = stage(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    total = cut.count()
    salted = cut.withColumn("_b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets_for(total))))
    sub = salted.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sub.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r[0]: r[1] for r in sub.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    inside = F.row_number().over(Window.partitionBy("length", "_b").orderBy(id_col, "piece")) - 1
    ranked = salted.withColumn("_r", inside).join(before.select("length", "_b", "_before"), ["length", "_b"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_r") + F.coalesce("_before", F.lit(0))).alias("_rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for b in batches:
            length, rank = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for s in np.unique(length).tolist():
                t, which = rows[s], np.flatnonzero(length == s)
                seg = t[np.searchsorted(t[:, 0], rank[which], side="right") - 1]
                k = rank[which] - seg[:, 0]
                sequence[which] = seg[:, 1] + k // seg[:, 2]
                offset[which] = seg[:, 3] + (k % seg[:, 2]) * s
            others = [b[c] for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sequence), pa.array(offset)], names=[c for c in b.schema.names if c != "_rank"] + ["sequence_id", "offset"])

    return map_arrow(ranked, run, extended(cut.schema, sequence_id=LONG, offset=LONG))
