"""Operator 5, exact top-k search: M-trees of paged nodes, searched best first.

Inner products become distances by one more coordinate: with M the largest norm, |q - x|^2 = |q|^2 + M^2 - 2 q.x when x is
lengthened to norm M and q by 0. Vectors are dealt to the nearest of some pivots; each part of a pivot's vectors has a tree.
A page stores, for each entry, its distance to the page's routing object and its covering radius, so that most entries are
passed over without computing a distance. A query searches its own part first; what it finds there is the bound with which
it skips whole pivots, and from which the trees of the others start.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import broadcast_if_small, ship, stage

SCALE = 1024
LEAF = 128
FANOUT = 16
PART_ROWS = 8192
QUERY_BLOCK = 2048
PIVOT_ROWS = 2048
LEAST_PIVOTS, MOST_PIVOTS = 8, 1024
#: Components beyond this are measured in a larger unit.
PLAIN = float(1 << 26)
NO_ID = (1 << 63) - 1

PAGES = "c int, s int, page int, leaf boolean, entries array<long>, rows array<long>, vectors binary, radii array<double>, parent_distances array<double>, top double, unit double"
FOUND = "row long, query_id long, vec_row long, vec_id long, score string"


# ---------------------------------------------------------------- numbers


def floored(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles, which hold it exactly (or are infinite, beyond 2^1014)."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def whole(x: np.ndarray) -> list[int]:
    """floor(1024 x) as Python integers, for any finite x."""
    return [int(c) * SCALE if abs(c) >= 1 << 53 else math.floor(c * SCALE) for c in x.tolist()]


def _matrix(rows: list, dim: int) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), dim)


def in_units(x: np.ndarray, unit: float) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return floored(x) if unit == 1.0 else x / unit * SCALE


def unit_of(x: np.ndarray) -> float:
    most = float(np.abs(x).max(initial=0.0))
    return 1.0 if most * SCALE < PLAIN else 2.0 ** min(math.frexp(most)[1], 1023)


def written(score: int) -> str:
    """The score as text that sorts as the score does, however large it is."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}{digits.translate(_NINES)}"


_NINES = str.maketrans("0123456789", "9876543210")


def read_score(text: Column) -> Column:
    """The score that was written; beyond 64 bits, the least or largest long."""
    digits = F.substring(text, 6, 10_000)
    positive = F.substring(text, 1, 1) == "1"
    amount = F.when(positive, digits).otherwise(F.translate(digits, "0123456789", "9876543210"))
    fits = F.length(amount) <= 18
    close = F.when(F.length(amount) == 19, F.when(positive, amount).otherwise(F.concat(F.lit("-"), amount)).try_cast("long"))
    small = F.when(positive, F.when(fits, amount).cast("long")).otherwise(-F.when(fits, amount).cast("long"))
    return F.coalesce(small, close, F.when(positive, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))


# ---------------------------------------------------------------- the index


class Tree:
    """Builds the pages of one part: ids (NO_ID for none), rows and raw vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.row_of, self.x, self.unit = ids, rows, x, unit_of(x)
        own = in_units(x, self.unit)
        norms = (own**2).sum(axis=1)
        self.top = float(norms.max())
        self.points = np.column_stack((own, np.sqrt(np.maximum(self.top - norms, 0.0))))
        self.rows: list[tuple] = []
        self.rng = np.random.default_rng(5)
        self._page(np.arange(len(ids)), None)

    def _to(self, which: np.ndarray, routing: np.ndarray | None) -> np.ndarray:
        return np.zeros(len(which)) if routing is None else np.sqrt(((self.points[which] - routing) ** 2).sum(axis=1))

    def _page(self, which: np.ndarray, routing: np.ndarray | None) -> int:
        """Adds the page of these vectors below a routing object; the number it gets."""
        number = len(self.rows)
        self.rows.append(())
        about = (self.top, self.unit)
        if len(which) <= LEAF:
            self.rows[number] = (number, True, self.ids[which].tolist(), self.row_of[which].tolist(), self.x[which].astype("<f8").tobytes(), [0.0] * len(which), self._to(which, routing).tolist(), *about)
            return number
        pivots = self.points[self.rng.choice(which, size=min(FANOUT, -(-len(which) // LEAF)), replace=False)]
        own = self.points[which]
        near = ((own**2).sum(axis=1)[:, None] - 2 * own @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
        groups = [which[near == k] for k in range(len(pivots))]
        if max(map(len, groups)) == len(which):  # vectors that can't be told apart
            groups = np.array_split(which, len(pivots))
        kept = [(g, p) for g, p in zip(groups, pivots) if len(g)]
        radii = [float(self._to(g, p).max()) for g, p in kept]
        vectors = np.array([p for _, p in kept])
        to_parent = np.zeros(len(kept)) if routing is None else np.sqrt(((vectors - routing) ** 2).sum(axis=1))
        children = [self._page(g, p) for g, p in kept]
        self.rows[number] = (number, False, children, [], vectors.astype("<f8").tobytes(), radii, to_parent.tolist(), *about)
        return number


_PAGE = ["page", "leaf", "entries", "rows", "vectors", "radii", "parent_distances", "top", "unit"]


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    ids = np.array([NO_ID if i is None or i != i else int(i) for i in rows["id"].tolist()], dtype=np.int64)
    x = _matrix(rows["x"].tolist(), len(rows["x"].iloc[0]))
    out = pd.DataFrame(Tree(ids, rows["row"].to_numpy(), x).rows, columns=_PAGE)
    out.insert(0, "c", key[0])
    out.insert(1, "s", key[1])
    return out


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, x, dim): all vectors without a null or non-finite component, as doubles, each row under a number of its own."""
    v = F.col(vector_col)
    x = F.transform(v, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(v.isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").cast("string").alias("id"), x.alias("x"), F.size(v).alias("dim"))


def dealt(vectors: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame, list]:
    """The vectors with cluster c and part s of it; the clusters (c, n, radius, parts); and those that have pivots, as rows.

    Pivots are a bounded number of vectors, by the order of a hash. A vector of a length that no pivot has is in the cluster
    of that length, which no query skips.
    """
    spark = vectors.sparkSession
    ship(spark)
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-vectors.count() // PIVOT_ROWS)))
    drawn = vectors.orderBy(F.xxhash64("x", F.lit(seed)), "row").limit(pivots).select("x", "dim").distinct().orderBy("dim", "x").collect()
    numbered = [(k, r["dim"], list(r["x"])) for k, r in enumerate(drawn)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = {d: ([k for k, e, _ in numbered if e == d], floored(_matrix([x for _, e, x in numbered if e == d], d))) for d in {d for _, d, _ in numbered}}
        for b in batches:
            c, far = np.zeros(len(b), np.int32), np.full(len(b), np.inf)
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in by_dim:
                    c[at] = -1 - d
                    continue
                names, p = by_dim[d]
                y = floored(_matrix(b["x"].iloc[at].tolist(), d))
                with np.errstate(over="ignore", invalid="ignore"):
                    near = np.nan_to_num((p**2).sum(axis=1) - 2 * y @ p.T, nan=0.0).argmin(axis=1)
                    away = np.sqrt(((y - p[near]) ** 2).sum(axis=1))
                c[at], far[at] = np.array(names)[near], np.where(np.isfinite(away), away, np.inf)
            yield b.assign(c=c, far=far)

    placed = stage(vectors.mapInPandas(assign, "row long, id string, x array<double>, dim int, c int, far double"), "assigned")
    clusters = stage(placed.groupBy("c").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "clusters")
    salted = placed.join(broadcast_if_small(clusters.select("c", "parts"), clusters.count()), "c").withColumn("s", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    radii = {r["c"]: r["radius"] for r in clusters.where("c >= 0").collect()}
    return salted.select("row", "id", "x", "dim", "c", "s"), clusters, [(k, d, x, radii[k]) for k, d, x in numbered if k in radii]


def build(placed: DataFrame) -> DataFrame:
    """The index: all pages of the trees of all parts, as rows."""
    return placed.select("row", "id", "x", "c", "s").groupBy("c", "s").applyInPandas(_build, PAGES)


# ---------------------------------------------------------------- searching


class Searcher:
    """One part's pages, read back."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        self.pages = {}
        self.top, self.unit = float(pages["top"].iloc[0]), float(pages["unit"].iloc[0])
        for page, leaf, entries, rows, vectors, radii, dist in zip(*(pages[c] for c in _PAGE[:7])):
            v = np.frombuffer(vectors, "<f8").reshape(len(entries), dim + (not leaf))
            y = floored(v) if leaf else v
            with np.errstate(over="ignore"):
                most = float((y**2).sum(axis=1).max(initial=0.0)) if leaf else 0.0
            self.pages[page] = (bool(leaf), np.asarray(entries, np.int64), np.asarray(rows, np.int64), v, np.asarray(radii), np.asarray(dist), y, most)
        self.computed = 0

    @staticmethod
    def _scores(x: np.ndarray, y: np.ndarray, raw: np.ndarray, whole_raw: np.ndarray, most: float, least: int | None) -> tuple[list[int], list[int]]:
        """(which, score) of the vectors that score `least` or more; in doubles where no sum can reach 2^53, exact either way."""
        if most < float(1 << 104):
            scores = whole_raw @ y
            if least is None:
                return list(range(len(scores))), scores.astype(np.int64).tolist()
            which = np.flatnonzero(scores >= float(least))
            return which.tolist(), scores[which].astype(np.int64).tolist()
        q = whole(x)
        return list(range(len(raw))), [sum(a * b for a, b in zip(q, whole(r))) for r in raw]

    def _reach(self, norm: float, score: int, slack: float) -> float:
        if self.unit == 1.0:
            scaled = float(score) if abs(score) < 1 << 900 else math.copysign(math.inf, score)
        else:
            low = score // int(self.unit) ** 2
            scaled = float(low) if abs(low) < 1 << 900 else math.copysign(math.inf, low)
        squared = norm + self.top - 2.0 * scaled
        return math.inf if squared != squared or squared == math.inf else math.sqrt(max(squared, 0.0)) + slack

    def search(self, row: int, x: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int, int]]:
        """(score, id, row) of the k best rows other than the query's own, of those that reach `floor`; ties to the smaller id."""
        y, q = floored(x), in_units(x, self.unit)
        with np.errstate(over="ignore", invalid="ignore"):
            norm, exact_norm = float((q**2).sum()), float((y**2).sum())
        bounded = math.isfinite(norm) and math.isfinite(self.top)
        slack = 1e-6 * (1.0 + math.sqrt(norm + self.top)) if bounded else math.inf
        longer = np.append(q, 0.0)
        best: list[tuple[int, int, int]] = []  # a heap: (score, -id, -row), the worst first
        reach = self._reach(norm, floor, slack) if bounded and floor is not None else math.inf
        heap: list[tuple[float, int, float]] = [(0.0, 0, math.nan)]
        while heap:
            bound, page, to_routing = heapq.heappop(heap)
            if bound > reach:
                break
            leaf, entries, rows, vectors, radii, dist, y_of, most = self.pages[page]
            if math.isfinite(reach) and to_routing == to_routing:
                maybe = np.flatnonzero(np.abs(to_routing - dist) - radii <= reach)
                if len(maybe) < len(entries):
                    entries, vectors, radii = entries[maybe], vectors[maybe], radii[maybe]
                    if leaf:
                        rows, y_of = rows[maybe], y_of[maybe]
            self.computed += len(entries)
            if not leaf:
                d = np.sqrt(((vectors - longer) ** 2).sum(axis=1)) if bounded else np.zeros(len(entries))
                for low, child, at in zip(np.maximum(d - radii, bound).tolist(), entries.tolist(), d.tolist()):
                    low = low if bounded else 0.0
                    if low <= reach:
                        heapq.heappush(heap, (low, child, at))
                continue
            least = best[0][0] if len(best) == k else floor
            which, scores = self._scores(x, y, vectors, y_of, most * exact_norm, least)
            for s, i, r in zip(scores, entries[which].tolist(), rows[which].tolist()):
                if r == row or (floor is not None and s < floor):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i, -r))
                elif (s, -i, -r) > best[0]:
                    heapq.heapreplace(best, (s, -i, -r))
            if bounded and len(best) == k:
                reach = min(reach, self._reach(norm, best[0][0], slack))
        return [(s, -i, -r) for s, i, r in sorted(best, reverse=True)]


def _search(k: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(pages) and len(queries):
            x = _matrix(queries["x"].tolist(), len(queries["x"].iloc[0]))
            tree = Searcher(pages, x.shape[1])
            for row, q, v, floor in zip(queries["row"].tolist(), queries["id"].tolist(), x, queries["floor"].tolist()):
                found += [(row, int(q), r, None if i == NO_ID else i, written(s)) for s, i, r in tree.search(row, v, k, int(floor) if isinstance(floor, str) else None)]
        return pd.DataFrame(found, columns=["row", "query_id", "vec_row", "vec_id", "score"]).astype({"row": "int64", "query_id": "int64", "vec_row": "int64", "vec_id": "Int64", "score": "object"})

    return run


def _survivors(queries: DataFrame, pivoted: list) -> DataFrame:
    """(row, id, x, floor, c): the clusters that may hold a score of a query's floor or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = {d: ([k for k, e, _, _ in pivoted if e == d], floored(_matrix([x for _, e, x, _ in pivoted if e == d], d)), np.array([r for _, e, _, r in pivoted if e == d])) for d in {p[1] for p in pivoted}}
        for b in batches:
            out = []
            for row, i, x, d, floor in zip(b["row"], b["id"], b["x"], b["dim"], b["floor"]):
                if d not in by_dim:
                    out.append((row, i, x, floor, -1 - d))
                    continue
                names, p, radii = by_dim[d]
                y = floored(np.asarray(x, dtype=np.float64))
                with np.errstate(over="ignore", invalid="ignore"):
                    size = math.sqrt(float((y**2).sum()))
                    most = p @ y + size * radii
                    most += 1e-9 * size * (np.sqrt((p**2).sum(axis=1)) + radii) + 1.0
                least = -math.inf if not isinstance(floor, str) else float(int(floor)) if abs(int(floor)) < 1 << 900 else -math.inf
                out += [(row, i, x, floor, c) for c, m in zip(names, most.tolist()) if not m < least]
            yield pd.DataFrame(out, columns=["row", "id", "x", "floor", "c"])

    return queries.select("row", "id", "x", "dim", "floor").mapInPandas(run, "row long, id string, x array<double>, floor string, c int")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, clusters: DataFrame, pivoted: list, k: int = 10) -> DataFrame:
    """The k best rows of the whole index for each query (row, id, x, dim, c, s).

    First every query meets its own part. Then it meets the parts of those clusters that can hold what it lacks, in blocks of
    queries: each block of a part is a task of its own.
    """
    none = F.lit(None).cast("string")
    home = stage(index.groupBy("c", "s").cogroup(queries.withColumn("floor", none).groupBy("c", "s")).applyInPandas(_search(k), FOUND), "home")
    ranked = _best(home, k)
    floors = ranked.where(F.col("rank") == k).select("row", "score")
    low = read_score(F.col("score"))  # the least long may stand for less, so it is no bound
    lows = queries.join(floors, "row", "left").withColumn("floor", F.when(low > -(1 << 63), low).cast("string")).drop("score")
    asked = _survivors(lows, pivoted).join(broadcast_if_small(clusters.select("c", "parts"), clusters.count()), "c")
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = queries.select("row", F.col("c").alias("own_c"), F.col("s").alias("own_s"))
    others = stage(asked.join(own, "row").where("c <> own_c or s <> own_s").drop("own_c", "own_s"), "asked")
    blocks = stage(others.groupBy("c", "s").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "blocks")
    paged = index.join(blocks, ["c", "s"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    blocked = others.join(blocks, ["c", "s"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    rest = paged.groupBy("c", "s", "block").cogroup(blocked.groupBy("c", "s", "block")).applyInPandas(_search(k), FOUND)
    return _best(ranked.drop("rank").union(rest), k).select("query_id", "rank", "vec_id", read_score(F.col("score")).alias("score"))


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by `every`: the k highest inner products among all other rows.

    Vectors that are null or hold a null or a non-finite number take no part; those of different lengths are not compared;
    empty ones score 0. Rows that repeat an id are rows of their own, as candidates and as queries (each gets its k rows).
    Rows without an id are candidates only, last in ties. Scores are exact, and so is their order; beyond 64 bits they are
    returned as the least or largest long. An empty table gives an empty result.
    """
    all_rows = stage(usable(vectors, id_col=id_col, vector_col=vector_col), "vectors")
    placed, clusters, pivoted = dealt(all_rows)
    placed = stage(placed, "placed")
    index = stage(build(placed), "mtree")
    return search(index, placed.where(F.col("id").isNotNull() & (F.col("id").cast("long") % every == 0)), clusters, pivoted, k)


__all__ = ["Searcher", "Tree", "build", "dealt", "search", "top_k", "usable"]
