"""Operator 10, exact substring removal: bytes of any string of fixed length that also starts earlier.

Suffixes are sorted a bucket at a time, with a difference cover to settle long ties; two exact steps first leave out what
need not be sorted.

1. Of the 32-byte strings in a window of 100 bytes, the one with the least hash is its anchor. Equal windows have equal
   anchors at the same place, so windows whose anchor occurs once are unique. Consecutive windows with one anchor are a run.
2. Of runs alike in text, all but the earliest are repeats throughout. Those leave runs that share an anchor and differ.
3. The rest meet by anchor. A task sorts the suffixes that start at their windows: it ranks the suffixes at the places of a
   difference cover once, then takes one bucket of leading bytes at a time, sorts it by as many bytes as the cover's period,
   and settles what is still tied by the ranks of the first cover places that both have. Neighbours in that order with 100
   bytes in common are repeats.

The runs of an anchor with more of them than a task should hold are halved, by where the anchor lies in the window, as often
as it takes: the windows of a half have more in common than the anchor, and runs that differ there part, while others agree
on the half and are then alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import discarding, map_arrow, ship, stage

LENGTH = 100
COVER = 32
CHUNK = 1 << 18
_NONE = -(1 << 63)  # stands for a null id: before all others

_rng = np.random.default_rng(10)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < size:
        with np.errstate(over="ignore"):
            for name, base in (("n", _STEP), ("i", _INVERSE)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["n"], _powers["i"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Scan:
    """The runs of one buffer of joined texts: kmer, start and number of windows."""

    def __init__(self, data: bytes, valid: np.ndarray, length: int, cover: int):
        """valid: for each position, whether a window of `length` bytes of one text starts there."""
        self.length, self.raw = length, np.frombuffer(data, np.uint8)
        with np.errstate(over="ignore"):
            self.ladder = {1: _BYTE[self.raw]}
            n, mult = 1, _BASE
            while 2 * n <= length:
                h = self.ladder[n]
                self.ladder[2 * n] = h[:-n] * mult + h[n:] if len(h) > n else h[:0]
                n, mult = 2 * n, mult * mult
            h = _mixed(self._hash(cover))
            w = length - cover + 1
            m, span = h, 1
            while 2 * span <= w:
                m = np.minimum(m[:-span], m[span:]) if len(m) > span else m[:0]
                span *= 2
            if span < w:
                m = np.minimum(m[: len(m) - (w - span)], m[w - span :]) if len(m) > w - span else m[:0]
        ok = valid[: len(m)]
        ends = np.ones(len(m), dtype=bool)
        if len(m) > 1:
            ends[:-1] = (h[: len(m) - 1] == m[:-1]) | (m[1:] != m[:-1]) | ~ok[1:]
        at = np.flatnonzero(ends & ok)
        begins = np.ones(len(m), dtype=bool)
        begins[1:] = ends[:-1] | ~ok[:-1]
        self.start = np.flatnonzero(begins & ok)
        self.count = at - self.start + 1
        self.kmer = m[self.start]
        self.hashes = h

    def anchors(self, which: np.ndarray) -> np.ndarray:
        """Where the anchor of each run lies: its first place in the last window, as in all others."""
        at = self.start[which] + self.count[which] - 1
        wanted = self.kmer[which]
        open_ = np.arange(len(which))
        while len(open_ := open_[self.hashes[at[open_]] != wanted[open_]]):
            at[open_] += 1
        return at

    def _hash(self, n: int) -> np.ndarray:
        """Hashes of all strings of n bytes, from those of powers of two."""
        total = len(self.raw) - n + 1
        if total <= 0:
            return np.zeros(0, np.uint64)
        out, at = None, 0
        for p in sorted((p for p in self.ladder if n & p), reverse=True):
            part = self.ladder[p][at : at + total]
            if out is None:
                out = part
            else:
                mult = _BASE
                for _ in range(p.bit_length() - 1):
                    mult = mult * mult
                out = out * mult + part
            at += p
        return out

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """A hash of the text and the number of windows of each run."""
        with np.errstate(over="ignore"):
            up, down = _power_table(len(self.raw) + 1)
            sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(self.ladder[1] * up[: len(self.raw)], out=sums[1:])
            lo = self.start[which]
            text = (sums[lo + self.count[which] - 1 + self.length] - sums[lo]) * down[lo]
            return _mixed(text + self.count[which].astype(np.uint64) * _BASE)


def scans(texts: list[str | None], length: int, cover: int) -> Iterator[tuple[Scan, np.ndarray, np.ndarray]]:
    """Scans of all texts in buffers of about CHUNK bytes, with the number of the text and the offset in it of each position.

    A long text is cut into chunks that overlap, so that every window starts in exactly one.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[Scan, np.ndarray, np.ndarray]]:
        sizes = np.array([len(p) for _, _, p in parts])
        which = np.repeat(np.array([i for i, _, _ in parts]), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(which))
        valid = place + length <= begin + np.repeat(sizes, sizes)
        offset = place - begin + np.repeat(np.array([o for _, o, _ in parts]), sizes)
        yield Scan(b"".join(p for _, _, p in parts), valid, length, cover), which, offset

    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw) - length + 1, 0), CHUNK):
            parts.append((i, at, raw[at : at + CHUNK + length - 1]))
            size += len(parts[-1][2])
            if size >= CHUNK:
                yield from flush()
                parts, size = [], 0
    if parts:
        yield from flush()


class Seen:
    """A bitmap of hashed numbers, of bounded size: what was put in is found, and a few others, which only cost their rows."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def slots(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.log2)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = self.slots(x)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(numbers: DataFrame, column: str, rows: int, most_log2: int = 29) -> Seen:
    """32 bits a number, 64 MB at most (beyond which it only lets more through); made in slices by the executors."""
    log2 = min(most_log2, max(16, int(32 * max(rows, 1)).bit_length()))
    per = log2 - 6
    ship(numbers.sparkSession)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(pdf["slot"].to_numpy()).astype(np.int64)
        flags = np.zeros(1 << per, dtype=np.uint8)
        flags[at] = 1
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    empty = Seen(np.zeros(0, np.uint8), log2)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(empty.slots(b[column].to_numpy(zero_copy_only=False).view(np.uint64))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> per).astype(np.int32)), pa.array(at & ((1 << per) - 1))], names=["slice", "slot"])

    found = map_arrow(numbers.select(column), slots, "slice int, slot long").distinct().groupBy("slice").applyInPandas(fill, "slice int, bits binary").collect()
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    for r in found:
        bits[r["slice"] << (per - 3) : (r["slice"] + 1) << (per - 3)] = np.frombuffer(r["bits"], np.uint8)
    return Seen(bits, log2)


# ---------------------------------------------------------------- suffix sorting

PERIOD = 64
BUCKET = 1 << 16
BLOCK_BYTES = 1 << 20
CROWD = 8192


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo the period is that of two of them: the first r, and the multiples of r."""
    r = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate((np.arange(r), np.arange(0, period + r, r))) % period)


def _shifts(period: int) -> np.ndarray:
    """For two residues, how far to go until both are in the cover."""
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    to = np.full((period, period), -1, np.int64)
    at = np.arange(period)
    for shift in range(period - 1, -1, -1):
        there = cover[(at + shift) % period]
        to[np.ix_(there, there)] = shift
    return to


class Suffixes:
    """The order of suffixes of one text, as far as `depth` bytes decide it."""

    def __init__(self, text: np.ndarray, depth: int, period: int = PERIOD):
        self.period, self.depth, self.shift = period, depth, _shifts(period)
        size = len(text)
        reach = period
        while reach < depth:
            reach *= 2
        padded = np.concatenate((text, np.zeros(2 * reach + 16, np.uint8)))
        words = np.zeros(size + 2 * reach, np.uint64)  # eight bytes from each place on, the first the most significant
        for k in range(8):
            words = words << np.uint64(8) | padded[k : k + len(words)]
        self.words = words
        # Ranks of the cover's places, by the bytes of a period, then by pairs of ranks: twice as many bytes each time.
        cover = np.zeros(period, bool)
        cover[difference_cover(period)] = True
        places = np.flatnonzero(np.tile(cover, -(-(size + 2 * reach) // period))[: size + reach])
        at = places[np.argsort(words[places], kind="stable")]
        group = np.cumsum(np.append(0, words[at][1:] != words[at][:-1])) if len(at) else np.zeros(0, np.int64)
        for k in range(8, period, 8):
            self._refine(at, group, words, k)
        self.rank = np.zeros(size + 4 * reach, np.int64)
        self.rank[at] = group + 1
        span = period
        while span < depth:
            before = self.rank.copy()
            self._refine(at, group, before, span)
            self.rank[at] = group + 1
            span *= 2

    def _refine(self, at: np.ndarray, group: np.ndarray, by: np.ndarray, k: int) -> None:
        """Split the groups that tie, by what lies k bytes on; at and group are put in the new order."""
        tied = self._tied(group)
        if len(tied):
            keys = by[at[tied] + k]
            order = np.argsort(keys, kind="stable")
            order = order[np.argsort(group[tied][order], kind="stable")]
            at[tied] = at[tied][order]
            self._split(group, tied, keys[order])

    def sorted(self, places: np.ndarray) -> np.ndarray:
        """The places of one bucket in the order of their suffixes."""
        at = places[np.argsort(self.words[places], kind="stable")]
        # Groups that tie on the bytes so far, split by the next eight.
        group = np.cumsum(np.append(0, self.words[at][1:] != self.words[at][:-1])) if len(at) else np.zeros(0, np.int64)
        for k in range(8, self.period, 8):
            self._refine(at, group, self.words, k)
        while len(tied := self._tied(group)):  # each round compares a group with one of it, at the places of the cover
            g, mine = group[tied], at[tied]
            first = np.append(True, g[1:] != g[:-1])
            heads = np.flatnonzero(first)
            sizes = np.diff(np.append(heads, len(g)))
            pivot = np.repeat(mine[heads + sizes // 2], sizes)
            shift = self.shift[mine % self.period, pivot % self.period]
            order_by = np.sign(self.rank[mine + shift] - self.rank[pivot + shift])
            order = np.lexsort((order_by, g))
            at[tied] = mine[order]
            new = order_by[order]
            edge = np.append(True, (g[1:] != g[:-1]) | (new[1:] != new[:-1]))
            equal = new == 0  # ordered as far as the depth goes: each is a group of its own from now on
            self._renumber(group, tied, edge | equal)
        return at

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        same = group[1:] == group[:-1]
        return np.flatnonzero(np.append(same, False) | np.append(False, same))

    def _split(self, group: np.ndarray, tied: np.ndarray, keys: np.ndarray) -> None:
        g = group[tied]
        self._renumber(group, tied, np.append(True, (g[1:] != g[:-1]) | (keys[1:] != keys[:-1])))

    @staticmethod
    def _renumber(group: np.ndarray, tied: np.ndarray, edge: np.ndarray) -> None:
        starts = np.append(True, group[1:] != group[:-1])
        starts[tied] = edge
        group[:] = np.cumsum(starts) - 1

    def same(self, at: np.ndarray) -> np.ndarray:
        """Whether each place but the first has `depth` bytes in common with the one before it."""
        out = np.ones(max(len(at) - 1, 0), bool)
        last = max(self.depth - 8, 0)
        for k in [*range(0, last, 8), last]:
            left = np.flatnonzero(out)
            if self.depth < 8:
                cut = np.uint64(8 * (8 - self.depth))
                out[left] = self.words[at[left]] >> cut == self.words[at[left + 1]] >> cut
            else:
                out[left] = self.words[at[left] + k] == self.words[at[left + 1] + k]
        return out


def repeated_windows(texts: list[bytes], length: int, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """Groups of equal windows of some runs: (group, number of the run, window within it), a bucket of suffixes at a time."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    suffixes = Suffixes(text, length)
    n = sizes - length + 1
    run = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    places = np.repeat(np.cumsum(sizes) - sizes, n) + within
    owner = np.zeros(len(text) + 1, np.int64)
    owner[places] = np.arange(len(places))
    lead = suffixes.words[places]
    cuts = np.unique(np.sort(lead)[bucket::bucket]) if len(lead) > bucket else lead[:0]
    which = np.searchsorted(cuts, lead, side="right")
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(len(cuts) + 2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            at = suffixes.sorted(places[order[a:b]])
            same = suffixes.same(at)
            group = np.cumsum(np.append(0, ~same))
            keep = np.append(same, False) | np.append(False, same)
            own = owner[at[keep]]
            yield np.stack((group[keep], run[own], within[own]))


# ---------------------------------------------------------------- runs

_RUN = "kmer long, ctx long, d long, h long, lo long, n int"
_ENTRY = "kmer long, d long, h long, lo long, lead int, text binary"


def _ranges(d: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (d, h, start, stop)], names=["d", "h", "start", "stop"])


def _joined_windows(d: np.ndarray, h: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows as ranges: those that start one after the other in a document make one."""
    o = np.lexsort((at, h, d))
    d, h, at = d[o], h[o], at[o]
    new = np.ones(len(o), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o)) - 1
    return _ranges(d[first], h[first], at[first], at[last[: len(first)]] + length)


def _later(group: np.ndarray, order: list[np.ndarray]) -> np.ndarray:
    """Which rows are not the first of their group, by order; equal in order too counts as the first."""
    o = np.lexsort([*reversed(order), group])
    new = np.append(True, group[o][1:] != group[o][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    differs = np.zeros(len(o), bool)
    for x in order:
        differs |= x[o] != x[o][head]
    out = np.zeros(len(o), bool)
    out[o] = differs
    return out


def _settled(d: np.ndarray, h: np.ndarray, lo: np.ndarray, texts: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    for group, run, within in repeated_windows(texts, length):
        at = lo[run] + within
        late = np.flatnonzero(_later(group, [d[run], h[run], at]))
        if len(late):
            yield _joined_windows(d[run[late]], h[run[late]], at[late], length)


def _place(d: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for a place in a document."""
    with np.errstate(over="ignore"):
        return _mixed(_mixed(d.astype(np.int64).view(np.uint64) * _STEP + h.astype(np.int64).view(np.uint64)) + at.astype(np.uint64) * _BASE)


def alike(runs: DataFrame, keys: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Of runs with equal keys: the first of each kind with the number of its kind, and the ranges of all others."""
    place = ["d", "h", "lo"]
    first = stage(runs.groupBy(*keys).agg(F.min(F.struct(*place, *(c for c in runs.columns if c not in [*keys, *place]))).alias("f"), F.count("*").alias("c")), "first")
    heads = first.where("c > 1").select(*keys, *(F.col(f"f.{c}").alias(f"f{c}") for c in place))
    later = runs.join(heads, keys).where("d <> fd or h <> fh or lo <> flo")
    n = F.length("text") - length + 1 if "text" in runs.columns else F.col("n")
    return first.select(*keys, "f.*"), later.select("d", "h", F.col("lo").alias("start"), (F.col("lo") + n - 1 + length).alias("stop"))


def _crowded(first: DataFrame, key: list[str]) -> DataFrame:
    """Keys of which more than one kind of run is left, with how many."""
    return stage(first.groupBy(*key).agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")


def _halves(entries: DataFrame, step: int, length: int) -> DataFrame:
    """Entries cut by where the anchor lies, at the multiples of `step`, each part with what all windows of it have in common.

    Windows with the anchor at part * step to part * step + step - 1 share length - step + 1 bytes from part * step before the
    anchor on. With the part and those bytes as key, runs that differ there no longer meet.
    """
    lead, n = F.col("lead"), F.length("text") - length + 1  # windows have the anchor at lead, lead - 1, ... lead - n + 1
    part = F.explode(F.sequence(F.expr(f"(lead - (length(text) - {length})) div {step}"), F.expr(f"lead div {step}")))
    skip = F.greatest(lead - (F.col("part") + 1) * step + 1, F.lit(0)).cast("int")
    left = F.least(n, lead - F.col("part") * step + 1) - F.col("skip_")
    cut = entries.withColumn("part", part).withColumn("skip_", skip).withColumn("left_", left.cast("int"))
    cut = cut.select("kmer", "part", "d", "h", (F.col("lo") + F.col("skip_")).alias("lo"), (lead - F.col("skip_")).cast("int").alias("lead"), F.expr(f"substring(text, skip_ + 1, left_ + {length - 1})").alias("text"))
    return cut.withColumn("common", F.expr(f"xxhash64(substring(text, cast(lead - part * {step} as int) + 1, {length - step + 1}))"))


def repeats(docs: DataFrame, length: int, cover: int) -> DataFrame:
    """(d, h, start, stop): byte ranges covered by windows that start earlier elsewhere. docs: d, h, text."""
    spark = docs.sparkSession

    def kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s.kmer for s, _, _ in scans(b["text"].to_pylist(), length, cover)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64))], names=["kmer"])

    often = stage(map_arrow(docs.select("text"), kmers, "kmer long").groupBy("kmer").agg(F.count("*").alias("c")).where("c > 1").select("kmer"), "kmers")
    shared = spark.sparkContext.broadcast(bitmap(often, "kmer", often.count()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds, hs = (b[c].to_numpy(zero_copy_only=False) for c in ("d", "h"))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for s, which, offset in scans(b["text"].to_pylist(), length, cover):
                keep = np.flatnonzero(shared.value.has(s.kmer))
                at = s.start[keep]
                for o, x in zip(out, (s.kmer[keep].view(np.int64), s.contexts(keep).view(np.int64), ds[which[at]], hs[which[at]], offset[at], s.count[keep])):
                    o.append(x)
            flat = [np.concatenate([*o, np.zeros(0, np.int64)]) for o in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in flat[:5]), pa.array(flat[5].astype(np.int32))], names=["kmer", "ctx", "d", "h", "lo", "n"])

    found = stage(map_arrow(docs, runs, _RUN), "runs")
    first, ranges = alike(found, ["kmer", "ctx"], length)
    kinds = _crowded(first, ["kmer"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(*(b[c].to_numpy(zero_copy_only=False) for c in ("d", "h", "lo"))).view(np.int64))], names=["place"])

    asked = stage(map_arrow(first.join(kinds, "kmer").select("d", "h", "lo"), places, "place long"), "asked")
    wanted = spark.sparkContext.broadcast(bitmap(asked, "place", asked.count()))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds, hs = (b[c].to_numpy(zero_copy_only=False) for c in ("d", "h"))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            texts: list[bytes] = []
            for s, which, offset in scans(b["text"].to_pylist(), length, cover):
                doc, at = which[s.start], offset[s.start]
                keep = np.flatnonzero(wanted.value.has(_place(ds[doc], hs[doc], at)))
                begin, n = s.start[keep], s.count[keep]
                raw = s.raw.tobytes()
                texts += [raw[i : i + k + length - 1] for i, k in zip(begin.tolist(), n.tolist())]
                for o, x in zip(out, (s.kmer[keep].view(np.int64), ds[doc[keep]], hs[doc[keep]], at[keep], s.anchors(keep) - begin)):
                    o.append(x)
            flat = [np.concatenate([*o, np.zeros(0, np.int64)]) for o in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in flat[:4]), pa.array(flat[4].astype(np.int32)), pa.array(texts, pa.binary())], names=["kmer", "d", "h", "lo", "lead", "text"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]
        texts: list[bytes] = []
        size = 0
        for b in batches:
            held = [np.concatenate((x, b[c].to_numpy(zero_copy_only=False))) for x, c in zip(held, ("key", "d", "h", "lo"))]
            new = b["text"].to_pylist()
            texts += new
            size += sum(map(len, new))
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last one may go on
            if cut and size > BLOCK_BYTES:
                yield from _settled(*(x[:cut] for x in held[1:]), texts[:cut], length)
                held, texts = [x[cut:] for x in held], texts[cut:]
                size = sum(map(len, texts))
        if len(held[0]):
            yield from _settled(*held[1:], texts, length)

    def settled(rows: DataFrame, keys: list[str]) -> DataFrame:
        keyed = rows.select(F.xxhash64(*keys).alias("key"), "d", "h", "lo", "text")
        return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), settle, "d long, h long, start long, stop long")

    rows = stage(map_arrow(docs, entries, _ENTRY), "entries")
    keys, step = ["kmer"], length - cover + 1
    while True:
        if step == 1:  # one window each, and those alike are settled
            return ranges
        crowded = kinds.where(F.col("kinds") > CROWD).select(*keys)
        if crowded.isEmpty():
            return ranges.union(settled(rows, keys))
        ranges = ranges.union(settled(rows.join(crowded, keys, "left_anti"), keys))
        step = -(-step // 2)
        halves = stage(_halves(rows.join(crowded, keys, "left_semi").select("kmer", "d", "h", "lo", "lead", "text"), step, length).withColumn("ctx", F.sha2("text", 256)), "halves")
        keys = ["kmer", "part", "common"]
        first, more = alike(halves, [*keys, "ctx"], length)
        ranges = ranges.union(more)
        kinds = _crowded(first, keys)
        rows = stage(first.join(kinds, keys).select(*keys, "d", "h", "lo", "lead", "text"), "entries")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, cover: int = COVER, keep_text: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256 (and kept, the bytes that stay, if asked for).

    Documents are in order of id, a null id before all, rows with one id and different texts in order of a hash of the text.
    Rows equal in id and text are one document: each gets its result. Null texts count as empty; texts shorter than `length`
    lose nothing. Strings are compared by 128 bits of hashes. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    with discarding(docs.sparkSession):
        ranges = repeats(keyed.select("d", "h", "text"), length, cover)
        by_doc = stage(ranges.groupBy("d", "h").agg(F.collect_set(F.struct("start", "stop")).alias("r")).select("d", "h", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops")), "ranges", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, sha, kept = [], [], [], [], []
            for t, starts, stops in zip(b["text"].to_pylist(), b["starts"].to_pylist(), b["stops"].to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                size.append(len(raw))
                n = s = 0
                if starts:
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, stops, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    n, s = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                gone.append(n), spans.append(s), sha.append(hashlib.sha256(raw).hexdigest())
                if keep_text:
                    kept.append(raw)
            columns = [b[id_col], *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(sha, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = keyed.join(by_doc, ["d", "h"], "left").select(id_col, "text", "starts", "stops")
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(joined, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
