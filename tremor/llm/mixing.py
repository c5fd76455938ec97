"""Operator 6, mixing sources to target weights, in DataFrame functions only.

Every source is one stream of words, cut into blocks of fixed length. Every output shard has a fixed number of slots, whose
sources are a multinomial draw by the sources' targets; a pseudorandom permutation of the source's block indices, a new one
each time the source is used up, says which block a slot takes; documents and draws meet in a join by block index. The mix
is the text of the drawn blocks, cut at the documents' ends, dealt by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import WORD, broadcast_if_small, buckets_for, stage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
ROUNDS = 16
SLOTS_A_SHARD = 4096
_SPACE = r"\x20\x09-\x0D"
#: A word with the space after it, the first also with the space before it: all of them together are the text.
_PART = rf"(?:^[{_SPACE}]+)?[^{_SPACE}]+[{_SPACE}]*"
_RANGE = 4096  # parts of a range by which what lies in it is looked up
_POINTS = 1 << 40
#: How far from its target, as a share of it, the draw may leave a source.
NEAR = 0.002


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source: its size, rank by code point (null last), weight and target.

    Targets share the sum of all sizes by weight; none exceeds `most` times its source's size, and what that leaves over is
    shared again. Sorted by what a source can give per unit of weight, the capped ones are a prefix, so running sums find
    the common level in one pass. One row a source; the windows without a key see those rows only.
    """
    by = sizes.groupBy(source_col).agg(F.sum(size_col).cast("long").alias("source_size"))
    ranked = by.withColumn("_k", F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("_w", F.element_at(cycle, (F.col("_k") % len(weights) + 1).cast("int")))
    limit = (F.col("source_size") * most).cast("double")
    order = Window.orderBy(limit / F.col("_w"), "_k")
    full = weighed.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("_all"),
        F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_capped"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
    )
    level = (F.col("_all") - F.col("_capped")) / F.col("_rest")
    open_level = F.max(F.when(limit / F.col("_w") >= level, level)).over(Window.partitionBy())
    target = F.when(open_level.isNull() | (limit / F.col("_w") < open_level), limit).otherwise(open_level * F.col("_w"))
    return full.select(source_col, "source_size", "_k", F.col("_w").alias("weight"), target.alias("target"))


def permuted(x: Column, n: Column, *key: Column | int) -> Column:
    """Where x in [0, n) goes under a permutation that the key chooses: a swap-or-not shuffle, a bijection for every n."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]

    def turn(at: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit(1), *keys, r) - at, n)
        return F.when(F.xxhash64(F.lit(2), *keys, r, F.greatest(at, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def draws(sources: DataFrame, total: int, *, seed: int) -> DataFrame:
    """(id, shard, _k) of `total` slots: each draws a source by its share, so that the counts of a shard are multinomial."""
    order = Window.orderBy("_k")
    upto = F.sum("_want").over(order)
    cuts = sources.select("_k", F.floor((upto - F.col("_want")) / F.lit(float(total)) * _POINTS).cast("long").alias("_lo"), F.floor(upto / F.lit(float(total)) * _POINTS).cast("long").alias("_hi")).where("_lo < _hi")
    ranges = cuts.withColumn("_g", F.explode(F.sequence(F.expr(f"_lo div {_POINTS // _RANGE}"), F.expr(f"(_hi - 1) div {_POINTS // _RANGE}"))))
    each = sources.sparkSession.range(total).withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(_POINTS))).withColumn("_g", F.expr(f"_u div {_POINTS // _RANGE}"))
    return each.join(broadcast_if_small(ranges, sources.count() + _RANGE), "_g").where("_u >= _lo and _u < _hi").select("id", F.expr(f"id div {SLOTS_A_SHARD}").alias("shard"), "_k")


def slots(sources: DataFrame, *, block: int = BLOCK_WORDS, most: int = 3, seed: int = 6, near: float = NEAR) -> DataFrame:
    """The mix, one row a slot: output shard, source rank, draw number within the source and block index.

    The slots of a shard draw their sources, so its counts are multinomial. The j-th slot of a source in a shard has as its
    draw number j and the source's slots in earlier shards; a permutation of the source's block indices, a new one each time
    the source is used up, says which block that is. A source of n blocks, size s and target t wants t * n / s slots; what
    it drew beyond (1 + near) times that, or beyond `most` * n, goes to sources that drew less than (1 - near) times theirs.
    """
    n = F.ceil(F.col("source_size") / block).cast("long")
    wanted = sources.where("source_size > 0").select("_k", n.alias("_n"), F.least(F.round(F.col("target") * n / F.col("source_size")).cast("long"), most * n).alias("_want")).where("_want > 0")
    wanted = stage(wanted, "wanted")
    total = wanted.agg(F.sum("_want")).first()[0] or 0
    few = lambda df: broadcast_if_small(df, wanted.count())
    drawn = draws(wanted, total, seed=seed) if total else wanted.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("shard"), "_k")
    # Numbers within a source: counts by shard, summed over groups of shards and then within them, so no window is long.
    by_shard = stage(drawn.groupBy("shard", "_k").agg(F.count("*").alias("_c")).withColumn("_super", F.expr("shard div 1024")), "shards")
    groups = by_shard.groupBy("_k", "_super").agg(F.sum("_c").alias("_s"))
    before = lambda value, *key: F.coalesce(F.sum(value).over(Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = groups.select("_k", "_super", before("_s", "_k", "_super").alias("_groups"))
    firsts = by_shard.select("shard", "_k", "_super", before("_c", "_k", "_super", "shard").alias("_shards")).join(earlier, ["_k", "_super"]).select("shard", "_k", (F.col("_groups") + F.col("_shards")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("shard", "_k").orderBy("id")) - 1
    numbered = drawn.withColumn("_j", within).join(firsts, ["shard", "_k"]).select("id", "shard", "_k", (F.col("_first") + F.col("_j")).alias("draw"))
    # What sources drew too much and too little, as ranges of the slots that change hands.
    counts = wanted.join(by_shard.groupBy("_k").agg(F.sum("_c").alias("_got")), "_k", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    bounded = counts.withColumn("_most", F.least(F.floor(F.col("_want") * (1 + near)).cast("long"), F.col("_n") * most)).withColumn("_least", F.ceil(F.col("_want") * (1 - near)).cast("long"))
    moved = bounded.withColumn("_over", F.greatest(F.col("_got") - F.col("_most"), F.lit(0))).withColumn("_under", F.greatest(F.col("_least") - F.col("_got"), F.lit(0)))
    order = Window.orderBy("_k")
    moved = stage(moved.withColumn("_to", F.sum("_under").over(order)).withColumn("_from", F.sum("_over").over(order) - F.col("_over")), "moved")
    spare, lacking = (moved.agg(F.sum("_over"), F.sum("_under")).first() or (0, 0)) if total else (0, 0)
    kept = numbered.join(few(moved.select("_k", "_most", "_from")), "_k")
    loose = kept.where("draw >= _most").select("shard", (F.col("_from") + F.col("draw") - F.col("_most")).alias("_i"))
    if lacking > spare:  # more shards at the end
        loose = loose.union(wanted.sparkSession.range(spare, lacking).select((F.lit(total + SLOTS_A_SHARD - 1) + F.col("id") - spare).alias("_s"), "id").select(F.expr(f"_s div {SLOTS_A_SHARD}"), "id"))
    takers = moved.where("_under > 0").select("_k", "_got", (F.col("_to") - F.col("_under")).alias("_lo"), F.col("_to").alias("_hi"))
    takers = takers.withColumn("_g", F.explode(F.sequence(F.expr(f"_lo div {_RANGE}"), F.expr(f"(_hi - 1) div {_RANGE}"))))
    topped = loose.withColumn("_g", F.expr(f"_i div {_RANGE}")).join(few(takers), "_g").where("_i >= _lo and _i < _hi").select("shard", "_k", (F.col("_got") + F.col("_i") - F.col("_lo")).alias("draw"))
    mixed = kept.where("draw < _most").select("shard", "_k", "draw").union(topped).join(few(wanted.select("_k", "_n")), "_k")
    index = permuted(F.col("draw") % F.col("_n"), F.col("_n"), F.col("_k"), F.expr("draw div _n"), seed)
    return mixed.select("shard", "_k", "draw", index.alias("block"))


def _drawn(sizes: DataFrame, *, weights: tuple[int, ...], most: int, block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as word ranges, of staged rows (_row, _id, source, size, _hash).

    Gives the rows with their source's rank; the sources; and the ranges, one row a slot and document: shard, source rank,
    draw, and the document's _row with the words [_from, _to) that the slot's block has of it.
    """
    sources = stage(targets(sizes, weights=weights, most=most), "sources")
    n_sources = sources.count()
    ranked = sizes.join(broadcast_if_small(sources, n_sources), sizes["source"].eqNullSafe(sources["source"])).select("_row", "_id", "size", "_hash", "_k")
    salted = ranked.where("size > 0").withColumn("_b", F.pmod(F.xxhash64("_id", "size"), F.lit(buckets_for(sizes.count()))))
    sub = salted.groupBy("_k", "_b").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sub.select("_k", "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_k", "_b").orderBy("_id", "size", "_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = salted.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["_k", "_b"]).withColumn("_start", F.col("_before") + F.col("_in"))
    cut = placed.select("_row", "size", "_k", "_start", F.explode(F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("block") * block - F.col("_start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("_start"), F.col("size"))
    ranges = cut.select("_row", "_k", "block", first.alias("_from"), last.alias("_to")).join(slots(sources, block=block, most=most, seed=seed), ["_k", "block"])
    return ranked, sources, ranges.select("shard", "_k", "draw", "block", "_row", "_from", "_to")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK_WORDS, seed: int = 6) -> DataFrame:
    """Per document: size in words, its source's size and target, and the words of it that the mix takes.

    The words are those of the ranges that mixed_documents cuts. Null and empty texts have size 0 and nothing taken. A null
    source is a source of its own, last in order. Repeated rows are documents of their own. Reruns agree: every choice is a
    hash of ids, ranks and the seed. An empty table gives an empty result.
    """
    text = F.col(text_col)
    sizes = stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_hash")), "sizes")
    ranked, sources, ranges = _drawn(sizes, weights=weights, most=most, block=block, seed=seed)
    taken = ranges.groupBy("_row").agg(F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    about = broadcast_if_small(sources.select("_k", "source_size", "target"), sources.count())
    whole = ranked.join(taken, "_row", "left").join(about, "_k")
    return whole.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK_WORDS, seed: int = 6) -> DataFrame:
    """The text of the drawn blocks, with the columns of the documents it comes from and the length column set anew.

    A row is a range of one document's words: neighbouring blocks that the same pass over the source deals to the same shard
    are one range, so that a document taken whole is one row. The words of a shard lie together, by source and draw.
    """
    text = F.col(text_col)
    keyed = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    sizes = stage(keyed.select("_row", F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_hash")), "sizes")
    _, sources, ranges = _drawn(sizes, weights=weights, most=most, block=block, seed=seed)
    n = sources.select("_k", F.ceil(F.col("source_size") / block).cast("long").alias("_n"))
    passes = ranges.join(broadcast_if_small(n, sources.count()), "_k").withColumn("_pass", F.expr("draw div _n"))
    same = Window.partitionBy("_row", "shard", "_pass").orderBy("block")
    runs = passes.withColumn("_run", F.col("block") - F.row_number().over(same)).groupBy("_row", "shard", "_pass", "_run").agg(F.first("_k").alias("_k"), F.min("draw").alias("draw"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    lists = runs.groupBy("_row").agg(F.collect_list(F.struct("shard", "_k", "draw", "_from", "_to")).alias("_ranges"))
    # The lambda over an array of one evaluates the split once a document, not once a range.
    parts = F.array(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)))
    cut = F.element_at(F.transform(parts, lambda w: F.transform("_ranges", lambda r: F.struct(r["shard"].alias("shard"), r["_k"].alias("_k"), r["draw"].alias("draw"), F.array_join(F.slice(w, (r["_from"] + 1).cast("int"), (r["_to"] - r["_from"]).cast("int")), "").alias("text")))), 1)
    found = keyed.join(lists, "_row").select(*docs.columns, F.explode(cut).alias("_cut"))
    dealt = found.repartition(F.col("_cut.shard")).sortWithinPartitions("_cut.shard", "_cut._k", "_cut.draw")
    out = {text_col: F.col("_cut.text")} | ({length_col: F.length("_cut.text").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return dealt.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])


__all__ = ["mix", "mixed_documents", "permuted", "slots", "targets"]
