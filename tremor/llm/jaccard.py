"""Operator 4, n-gram Jaccard join: adaptive multi-match prefixes over shingle sets, and the components of its links.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one node from here on.
2. A node can only be linked if few of its shingles are its own. A part of the hash space (a quarter at 85 percent, a third
   at 80) is enough to rule out most nodes: own shingles there already exceed what a link allows.
3. The rest count how many of them hold each shingle. That count orders shingles, rarest first. A prefix that leaves
   room for l shared shingles must share l with any linked node's. Each node takes the l whose prefix costs least: shingles
   to look through, and candidates expected to reach l.
   How long depends on both sizes, so a pair meets only where the prefixes for its own sizes do.
4. Nodes are first compared, in rounds, to a central node of a crowded prefix shingle. What that links needs no comparison
   within; then candidate pairs across components are counted over their prefixes and verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tremor.llm.common import BINARY, LONG, broadcast_if_small, discarding, extended, map_arrow, numbered, sliced, stage
from tremor.llm.components import components

MOST_MATCHES = 8
VERIFY_COST = 4.0
HEAD_ROUNDS = 2

# ---------------------------------------------------------------- sets

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _shingled(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        short = len(h) < k
        m = 1 if short else len(h) - k + 1
        s = np.full(m, len(h) if short else k, dtype=np.uint64)
        for i in range(len(h) if short else k):
            s = s * _MIX[0] + h[i : i + m]
        s ^= s >> np.uint64(30)
        s *= _MIX[1]
        s ^= s >> np.uint64(27)
        s *= _MIX[2]
        s ^= s >> np.uint64(31)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words split at space and \\t..\\r.

    Arrow splits the texts and numbers their words, so that each different one is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    different, of_word = numbered(split.flatten())
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, different)), "<u8")
    blank = different.index("") if "" in different else -1  # the one word of a text without words
    for lo, hi in pairwise(split.offsets.to_numpy().tolist()):
        which = of_word[lo:hi]
        yield _shingled(hashes[which] if hi - lo > 1 or which[0] != blank else hashes[:0], k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def sample_of(percent: int) -> int:
    """One in how many hashes is looked at first: a part some 1.6 times what a link allows to differ."""
    return max(1, int(100 / (1.6 * max(1, 100 - percent))))


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words: int, part: int) -> DataFrame:
    """(doc_id, n_shingles, sig, g, sample): the set's size, its 128-bit and 64-bit digests and its shingles of one part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            n, sig, g, samples = [], [], [], []
            for s in shingle_sets(b[text_col], words):
                d = hashlib.md5(s.tobytes()).digest()
                n.append(len(s)), sig.append(d), g.append(int.from_bytes(d[:8], "little", signed=True)), samples.append(s[s % np.uint64(part) == 0])
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(g, pa.int64()), _lists(samples)], names=["_id", "n", "sig", "g", "sample"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    fields = extended(picked.select(F.col(id_col).alias("_id")).schema, n=LONG, sig=BINARY, g=LONG, sample=ArrayType(LONG))
    return map_arrow(picked, run, fields)


def _sets_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """(g, n, tokens) of the wanted nodes (rep, g), read from the text of their first document."""
    text = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_text")).join(wanted, "rep").select("g", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            keep_g, keep = [], []
            for g, s in zip(b["g"].to_pylist(), shingle_sets(b["_text"], words)):
                if int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) == g:  # rows may share an id
                    keep_g.append(g), keep.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keep_g, pa.int64()), pa.array([len(s) for s in keep], pa.int64()), _lists(keep)], names=["g", "n", "tokens"])

    return map_arrow(text, run, "g long, n long, tokens array<long>").dropDuplicates(["g"])


# ---------------------------------------------------------------- links


def _spare(n: Column, percent: int) -> Column:
    """How many of its n shingles a node may have that a linked node lacks."""
    return F.floor(n * (100 - percent) / 100).cast("long")


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """The least number of shingles that linked nodes of these sizes share."""
    return F.ceil((na + nb) * percent / (100 + percent)).cast("long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The index: (t, g, n, pos, own, matches), a node's shingles held by others, rarest first, up to its own prefix length.

    own counts the shingles that no other node holds; they come first in the order. Linked nodes of sizes n and m that share
    o shingles at least share l among the first n - o + l of the one and m - o + l of the other. A row is kept only if some
    holder of its shingle may be small enough to make the prefix that long.
    """
    tok = sets.select("g", "n", F.explode("tokens").alias("t"))
    freq = stage(tok.groupBy("t").agg(F.count("*").alias("df"), F.min("n").alias("least")).where("df > 1"), "freq")
    node = Window.partitionBy("g")
    counted = tok.join(freq, "t").withColumn("own", F.col("n") - F.count("*").over(node)).where(F.col("own") <= _spare(F.col("n"), percent))
    order = node.orderBy("df", "t")
    placed = counted.withColumn("pos", F.row_number().over(order) - 1).withColumn("seen", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Costs are those of meeting nodes of the same size: the l whose prefix ends here, its rows, and the pairs that reach l.
    usual = F.col("n") - _overlap(F.col("n"), F.col("n"), percent)
    ends = F.col("own") + F.col("pos") + 1 - usual
    cost = F.col("seen") + VERIFY_COST * (F.col("seen") - F.col("pos") - 1) / ends * F.log2(F.col("n") + 1)
    fits = (ends >= 1) & (ends <= MOST_MATCHES) & (F.col("own") <= usual)
    best = F.coalesce(F.min_by(F.when(fits, ends), F.when(fits, cost)).over(node), F.lit(1))
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100).cast("long"))
    chosen = placed.withColumn("matches", best).where(F.col("own") + F.col("pos") < F.col("n") - _overlap(F.col("n"), smallest, percent) + F.col("matches"))
    return chosen.select("t", "g", "n", *(F.col(c).cast("int").alias(c) for c in ("pos", "own", "matches")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    a = sets.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _close(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= percent * F.greatest(x, y)


def starred(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): every node with the head of its most crowded shingle that is still open.

    The head is, of the holders in another component, one with few shingles of its own for its size: near copies differ
    least from it. One candidate a node, so a round never makes more pairs than there are nodes.
    """
    excess = F.col("own") - F.col("n") * (100 - percent) / (100 + percent)
    row = F.struct(excess.alias("e"), "g", "n", "own", "comp")
    odd = F.xxhash64("comp").bitwiseAND(F.lit(1)) == 1  # two heads, of components of either kind, so that they differ
    heads = rows.groupBy("t").agg(F.min(F.when(odd, row)).alias("h1"), F.min(F.when(~odd, row)).alias("h2"))
    first = F.coalesce(F.least("h1", "h2"), "h1", "h2")
    heads = heads.select("t", first.alias("h"), F.when(first == F.col("h1"), F.col("h2")).otherwise(F.col("h1")).alias("other"))
    met = rows.join(heads, "t").withColumn("to", F.when(F.col("comp") != F.col("h.comp"), F.col("h")).otherwise(F.col("other")))
    differ = F.col("n") + F.col("to.n") - 2 * _overlap(F.col("n"), F.col("to.n"), percent)
    met = met.where(_close(F.col("n"), F.col("to.n"), percent) & (F.col("own") + F.col("to.own") <= differ))
    one = met.groupBy("g").agg(F.max(F.struct("pos", F.col("to.g").alias("to"))).alias("x"))
    return one.select(F.least("g", "x.to").alias("a"), F.greatest("g", "x.to").alias("b")).distinct()


def crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) between components: pairs that share as many prefix shingles as both their prefixes call for."""
    side = lambda s: rows.select("t", *(F.col(c).alias(c[0] + s) for c in ("g", "n", "pos", "own", "matches", "comp")))
    wanted = F.least("ma", "mb")
    room = wanted - _overlap(F.col("na"), F.col("nb"), percent)
    within = (F.col("oa") + F.col("pa") < F.col("na") + room) & (F.col("ob") + F.col("pb") < F.col("nb") + room)
    met = side("a").join(side("b"), "t").where((F.col("ga") < F.col("gb")) & (F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb"), percent) & within)
    counted = met.groupBy("ga", "gb").agg(F.count("*").alias("met"), F.min(wanted).alias("wanted")).where("met >= wanted")
    return counted.select(F.col("ga").alias("a"), F.col("gb").alias("b"))


def _open(index: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of the index with their node's component, of shingles that lie in more than one."""
    tagged = index.withColumn("comp", F.col("g")) if known is None else index.join(known.withColumnRenamed("node", "g"), "g", "left").withColumn("comp", F.coalesce("comp", "g"))
    mixed = tagged.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t")
    return stage(tagged.join(mixed, "t", "left_semi"), "open")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) node pairs whose components are those of all links; every link between other components is there."""
    index = stage(prefixes(sets, percent), "index")
    known, found, rows = None, None, _open(index, None)
    for _ in range(HEAD_ROUNDS):
        new = stage(verified(starred(rows, percent), sets, percent), "links")
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
        known = components(found)
        rows = _open(index, known)
    rest = verified(stage(crossing(rows, percent), "candidates"), sets, percent)
    return rest if found is None else found.union(rest)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id that links reach.

    Sets link when 100 * intersection >= percent * union. Null and empty texts have no shingles and link with nothing; with
    fewer words than a shingle has, the sequence is the one shingle. Repeated rows are copies of each other. Rows without an
    id take the component of their set, which without any id is null and links no further. Shingles are compared by 64-bit
    hashes: a chance of about 1e-13 a pair of documents that one is mistaken. An empty table gives an empty result.
    """
    names = {"id_col": id_col, "text_col": text_col, "words": words}
    with discarding(docs.sparkSession):
        sigs = stage(signatures(docs, **names, part=sample_of(percent)), "signatures", keep=True)
        nodes = stage(sigs.where("n > 0").groupBy("sig").agg(F.min("_id").alias("rep"), F.min("n").alias("n"), F.min("g").alias("g")), "nodes")
        own = sigs.select("g", F.explode("sample").alias("t")).groupBy("t").agg(F.min("g").alias("g"), F.max("g").alias("other")).where("g = other").groupBy("g").agg(F.count("*").alias("own"))
        wanted = nodes.where("rep is not null").join(own, "g", "left").where(F.coalesce("own", F.lit(0)) <= _spare(F.col("n"), percent)).select("rep", "g")
        wanted = stage(wanted, "wanted")
        sets = stage(_sets_of(docs, broadcast_if_small(wanted, wanted.count()), **names), "sets")
        comps = components(links(sets, percent))
        named = nodes.join(comps.select(F.col("node").alias("g"), "comp"), "g", "left").withColumn("comp", F.coalesce("comp", "g"))
        least = named.groupBy("comp").agg(F.min("rep").alias("component"))
        final = stage(named.select("sig", "comp").join(least, "comp").select("sig", "component"), "final", keep=True)
    placed = sigs.select("_id", "n", "sig").join(final, "sig", "left")
    return placed.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents less those of which a linked one has a smaller id; rows that repeat an id share its fate. Texts without words stay."""
    with discarding(docs.sparkSession):
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
        gone = stage(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct(), "gone", keep=True)
    return docs.join(broadcast_if_small(gone, gone.count()), docs[id_col] == gone["_gone"], "left_anti")


__all__ = ["links", "near_duplicates", "one_of_each", "prefixes", "shingle_sets", "signatures", "verified"]
