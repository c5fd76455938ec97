"""Operator 8, secret scans, in DataFrame functions only: fixed patterns, and a battery of randomness tests.

Positions: `split` and `regexp_extract_all` walk a text alike, so the lengths of what lies between matches and of the
matches give every start and end, in code points.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import discarding, stage

# The contract's patterns, in order of kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more of AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{24,}"  # 24 characters or more of [0-9a-f]+
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

#: What may be an encoded random value: a whole run of the letters that the common encodings use.
LETTERS = "A-Za-z0-9+/_-"
FALSE_DISCOVERIES = 0.1
BINS = 50
#: What the counts of a class a step longer or shorter weigh in a class's own.
NEXT_CLASS = 0.5
_BLOCK = 256

# Alphabets in the order of their codes.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ALPHABETS = {
    "digits": DIGITS, "lower": LOWER, "UPPER": UPPER, "Title": UPPER + LOWER, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_", "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
FITS = {
    "digits": "[0-9]+", "lower": "[a-z]+", "UPPER": "[A-Z]+", "Title": "[A-Z][a-z]+", "hex": "[0-9a-f]+", "HEX": "[0-9A-F]+", "base32": "[A-Z2-7]+", "base36": "[0-9a-z]+", "BASE36": "[0-9A-Z]+",
    "letters": "[A-Za-z]+", "base62": "[A-Za-z0-9]+", "base64": "[A-Za-z0-9+/]+", "base64url": "[A-Za-z0-9_-]+", "mixed": "[A-Za-z0-9+/_-]+",
}
ENCODINGS = list(ALPHABETS)

#: Information of the least value that counts as a secret where it is named: LEAST_VALUE letters of base64.
LEAST_BITS = LEAST_VALUE * 6
#: By encoding, the length from which a random value holds as much.
LEAST_LENGTH = [math.ceil(LEAST_BITS / math.log2(len(a))) for a in ALPHABETS.values()]
RUN = f"[{LETTERS}]{{{min(LEAST_LENGTH)},}}"
_LENGTHS = 21
ONE_CASE = {ENCODINGS.index("lower"): ENCODINGS.index("UPPER"), ENCODINGS.index("UPPER"): ENCODINGS.index("lower")}

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def _running(values: Column, join) -> Column:
    """Running sums, or what else joins two numbers, in blocks: the work grows with the length to the power of 1.5 at most."""
    empty = F.array().cast("array<int>")
    add = lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise(join(F.try_element_at(s, F.lit(-1)), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda i: F.slice(values, (i * _BLOCK + 1).cast("int"), _BLOCK))
    within = F.transform(blocks, lambda b: F.aggregate(b, empty, add))
    upto = lambda w: F.aggregate(F.transform(w, lambda s: F.element_at(s, -1)), empty, add)
    # A lambda over an array of one keeps the running values from being made again for each block.
    carried = lambda w, u: F.transform(w, lambda s, i: F.when(i == 0, s).otherwise(F.transform(s, lambda x: join(F.try_element_at(u, i), x))))
    shifted = F.transform(F.array(within), lambda w: F.element_at(F.transform(F.array(upto(w)), lambda u: carried(w, u)), 1))
    return F.flatten(F.element_at(shifted, 1))


def _sums(widths: Column) -> Column:
    return _running(widths, lambda a, b: a + b)


def _placed(between: Column, matched: Column) -> Column:
    """Structs (start, end) of the matches, from the lengths between them and their own."""
    ends = _sums(F.zip_with(F.slice(between, 1, F.size(matched)), matched, lambda a, b: a + b))
    spans = F.zip_with(ends, matched, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    return F.when(F.size(matched) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(spans)


def _spans(text: Column, pattern: str, kind: int, value: int | None = None) -> Column:
    """Matches of one kind; with `value`, only those whose group of that number is long enough."""
    placed = _placed(_lengths(F.split(text, pattern, -1)), _lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if value is None:
        found = F.transform(placed, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))
    else:
        values = _lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)))
        with_value = F.zip_with(placed, values, lambda p, v: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), v.alias("v")))
        found = F.transform(F.filter(with_value, lambda p: p["v"] >= LEAST_VALUE), lambda p: F.struct(p["start"], p["kind"], p["end"]))
    return F.when(text.rlike(pattern), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(_spans(t, ASSIGN, 0, value=2), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))


def _tail(z: Column) -> Column:
    """Chance that a standard normal is above z, within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _battery(token: Column, alphabet: Column) -> Column:
    """The p-value that the token's letters are independent and uniform over the alphabet: three tests, the least times three."""
    k = F.length(alphabet).cast("double")
    n = F.length(token).cast("double")
    codes = F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    df = k - 1
    chi = F.greatest(squares * k / n - n, F.lit(0.0))
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("products"))
    mean, half = (k - 1) / 2, k / 2
    walked = F.aggregate(
        codes,
        start,
        lambda s, x: F.struct(
            x.alias("last"),
            (s["runs"] + F.when((s["last"] < 0) | ((s["last"] >= half) != (x >= half)), 1.0).otherwise(0.0)).alias("runs"),
            (s["products"] + F.when(s["last"] < 0, 0.0).otherwise((s["last"] - mean) * (x - mean))).alias("products"),
        ),
        lambda s: F.struct((F.abs(s["runs"] - (n + 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"), (F.abs(s["products"]) / ((k * k - 1) / 12) / F.sqrt(n - 1)).alias("serial")),
    )
    return F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), 2 * _tail(walked["runs"]), 2 * _tail(walked["serial"])))


def _encoding(token: Column) -> Column:
    """The number of the narrowest encoding that the token fits."""
    found = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        found = F.when(token.rlike(f"^{FITS[ENCODINGS[i]]}$"), i).otherwise(found)
    return found


def _class(token: Column, encoding: Column) -> Column:
    """The class of encoding and length; null for tokens too short to hold the least information."""
    n = F.length(token)
    least = F.element_at(F.array(*[F.lit(x) for x in LEAST_LENGTH]), encoding + 1)
    return F.when(n >= least, encoding * _LENGTHS + F.least(F.lit(_LENGTHS - 1), F.floor(2 * F.log2(n))).cast("int"))


def _p_value(token: Column, encoding: Column | None = None) -> Column:
    """The battery under the narrowest encoding that the token fits."""
    e = _encoding(token) if encoding is None else encoding
    return F.element_at(F.transform(F.array(F.element_at(F.array(*[F.lit(a) for a in ALPHABETS.values()]), e + 1)), lambda a: _battery(token, a)), 1)


def runs_tested(docs: DataFrame, text_col: str) -> DataFrame:
    """Every distinct run of a text's encoding letters that is long enough: class, p-value, and in how many settings it recurs.

    A run recurs if it has different runs before it and different ones after it at different places, as words do; the secret
    of a copied document keeps its neighbours, and in a near copy at least one of them. How many
    settings a run has is estimated by its different predecessors, 1 for one that does not recur. Counting is by run, with
    neighbours as the least and the greatest of hashes, so it combines before the shuffle; the battery runs once a distinct run.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))
    pairs = F.transform(F.array(tokens), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("run"), F.xxhash64(F.try_element_at(t, F.when(i > 0, i))).alias("after"), F.xxhash64(F.try_element_at(t, i + 2)).alias("before"))))
    each = docs.select(F.explode(F.element_at(pairs, 1)).alias("p")).select("p.run", "p.after", "p.before")
    recurs = (F.min("after") != F.max("after")) & (F.min("before") != F.max("before"))
    runs = each.groupBy("run").agg(F.when(recurs, F.greatest(F.lit(2), F.approx_count_distinct("after", 0.2))).otherwise(1).alias("settings"))
    known = runs.withColumn("encoding", _encoding(F.col("run"))).withColumn("class", _class(F.col("run"), F.col("encoding"))).where("class IS NOT NULL")
    return known.select("run", "class", "settings", _p_value(F.col("run"), F.col("encoding")).alias("p"))


def _falling(n: list[float]) -> list[float]:
    """The density nearest to the counts that never rises: neighbours that rise are levelled."""
    levels: list[list[float]] = []
    for x in n:
        levels.append([x, 1])
        while len(levels) > 1 and levels[-2][0] / levels[-2][1] < levels[-1][0] / levels[-1][1]:
            last = levels.pop()
            levels[-1] = [levels[-1][0] + last[0], levels[-1][1] + last[1]]
    total = sum(n)
    return [s / w / total for s, w in levels for _ in range(int(w))]


def _unlike(letters: dict[str, int], k: int) -> list[float]:
    """Chances at most which a run of class k passes each bin's lower edge, if its letters are drawn as in recurring runs.

    The chi-squared of such letters has a mean and a variance in closed form; its cube root is taken as normal, as in the test.
    """
    alphabet = ALPHABETS[ENCODINGS[k // _LENGTHS]]
    counts = [letters.get(c, 0) for c in alphabet]
    if not sum(counts):
        return [1.0] * BINS
    n, size, df = max(LEAST_LENGTH[k // _LENGTHS], math.ceil(2 ** (k % _LENGTHS / 2))), len(alphabet), len(alphabet) - 1
    two, three = (sum((c / sum(counts)) ** e for c in counts) for e in (2, 3))
    mean = df + (n - 1) * (size * two - 1)
    deviation = size * math.sqrt(4 * n * max(0.0, three - two * two) + 2 * two * two)
    scale = math.sqrt(2 / (9 * df))
    z = ((mean / df) ** (1 / 3) - (1 - 2 / (9 * df))) / scale
    spread = max(1.0, (mean / df) ** (-2 / 3) / (3 * df) / scale * deviation)
    normal = NormalDist()
    return [1.0] + [normal.cdf((normal.inv_cdf(1 - b / BINS / 3) - z) / spread) for b in range(1, BINS)]


def _cut(recur: list[float], once: list[float], own: list[list[int]], unlike: list[float], q: float) -> float | None:
    """The least p-value at which the share of non-random among what is accepted is q at most; None if there is none.

    Shape and share come from `recur` and `once`, which lean on other lengths; what is accepted, from the class itself, as `own`
    gives it by bin: recurring runs, their settings, runs that do not recur.

    Recurring runs count as natural. Only where the battery tells letters like theirs from random ones, so that `unlike` lets
    no more than q pass the first bin, what lies beyond its chances is a random value used in several places.
    """
    tells = unlike[1] <= q
    beyond = lambda n: [min(sum(n[b:]), sum(n) * unlike[b]) if tells else sum(n[b:]) for b in range(BINS)] + [0.0]
    settings, alone = [x[1] for x in own], [x[2] for x in own]
    runs, known = beyond(recur), beyond(settings)
    natural = _falling([runs[b] - runs[b + 1] + (b == 0) for b in range(BINS)])
    share, total = 0.5, sum(once)
    for _ in range(200 if total else 0):  # the share of random ones among runs that do not recur, by expectation and maximisation
        share = sum(n * share / (share + (1 - share) * BINS * f) for n, f in zip(once, natural) if n) / total
    for b in range(BINS // 2):
        accepted = sum(settings[b:]) + sum(alone[b:])
        if accepted and known[b] + (1 - share) * sum(alone) * sum(natural[b:]) <= q * accepted:
            return max(b / BINS, 0.5 / BINS)
    return None


def thresholds(runs: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """By class of encoding and length, the least p-value that is accepted; classes in which nothing can be are left out.

    Random runs have uniform p-values. How those of natural ones lie in a class is seen from runs that recur; runs that do
    not are a mixture of both, and its share is fitted. Where words look as random as keys do, as short ones of one case
    may, no p-value keeps the rate of false discoveries, and the class accepts nothing. A recurring run counts as false in
    each of its settings, unless letters like those of recurring runs would not pass. Counts are of all distinct
    runs of the corpus. For how p-values lie and for the share, each class adds other lengths, halved with every step between
    them, so rare lengths lean on their neighbours; the two encodings of one case, which the battery tests alike, share how
    natural runs lie. At most 14 encodings times 21 lengths times 50 bins reach the driver.
    """
    rows = runs.select("class", "settings", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int").alias("bin"))
    recurs = F.col("settings") > 1
    counts = rows.groupBy("class", "bin").agg(F.count_if(recurs).alias("recur"), F.sum(F.when(recurs, F.col("settings")).otherwise(0)).alias("settings"), F.count_if(~recurs).alias("once"))
    table: dict[int, list[list[int]]] = {}
    for r in counts.collect():
        table.setdefault(r["class"], [[0] * 3 for _ in range(BINS)])[r["bin"]] = [r["recur"], r["settings"], r["once"]]
    seen = runs.where(recurs).select(F.explode(F.split("run", "")).alias("letter")).groupBy("letter").count()
    letters = {r["letter"]: r["count"] for r in seen.collect()}  # at most the 66 of LETTERS
    found = {}
    for k in table:
        near = [(NEXT_CLASS ** abs(k - j), table[j]) for j in sorted(table) if j // _LENGTHS == k // _LENGTHS]
        recur, once = ([sum(w * t[b][i] for w, t in near) for b in range(BINS)] for i in (0, 2))
        other = ONE_CASE.get(k // _LENGTHS)
        for j in (j for j in table if j // _LENGTHS == other):
            recur = [n + NEXT_CLASS ** abs(k % _LENGTHS - j % _LENGTHS) * table[j][b][0] for b, n in enumerate(recur)]
        cut = _cut(recur, once, table[k], _unlike(letters, k), q)
        if cut is not None:
            found[k] = cut
    return found


def _pattern(limits: dict[int, float]) -> str:
    """Whole runs, but for those of letters or digits alone that are shorter than any class of theirs that accepts."""
    passed = []
    for i, name in enumerate(("digits", "lower", "UPPER", "Title")):
        accepts = [k % _LENGTHS for k in limits if k // _LENGTHS == i]
        n = math.ceil(2 ** (min(accepts) / 2)) - 1 if accepts else None
        body, least = ("[A-Z][a-z]", 2) if name == "Title" else (FITS[name][:-1], 1)
        passed.append(f"{body}++" if n is None else f"{body}{{1,{max(1, n - least + 1)}}}+")
    return f"(?<![{LETTERS}])(?!(?:{'|'.join(passed)})(?![{LETTERS}])){RUN}"


def candidates(text: Column, limits: dict[int, float]) -> Column:
    """Structs (start, end) of the runs whose p-value their class accepts."""
    kind = "array<struct<start:int,end:int>>"
    none = F.array().cast(kind)
    if not limits:
        return none
    t, pattern = F.coalesce(text, F.lit("")), _pattern(limits)
    cuts = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    tokens = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    placed = F.zip_with(_placed(_lengths(F.split(t, pattern, -1)), _lengths(tokens)), tokens, lambda p, x: F.struct(p["start"].alias("start"), p["end"].alias("end"), x.alias("token"), _encoding(x).alias("encoding")))
    classed = F.transform(placed, lambda c: F.struct(c["start"], c["end"], c["token"], c["encoding"], F.try_element_at(cuts, _class(c["token"], c["encoding"])).alias("cut")))
    accepted = F.filter(F.filter(classed, lambda c: c["cut"].isNotNull()), lambda c: _p_value(c["token"], c["encoding"]) >= c["cut"])
    return F.when(t.rlike(pattern), F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))).cast(kind)).otherwise(none)


def _all_spans(base: Column, cand: Column) -> Column:
    """Base spans, and candidates that overlap none, by start: one pass over both in order.

    Candidates do not overlap each other, so a base span that starts within one comes right after it in order; of those that
    start before, the furthest end decides.
    """
    as_span = F.transform(cand, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).cast(_SPAN)
    both = F.array_sort(F.concat(base, as_span))
    upto = lambda m: _running(F.transform(m, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest)
    following = lambda m, i: F.try_element_at(m, i + 2)
    clear = lambda m, u: F.filter(m, lambda x, i: (x["kind"] < 3) | ((F.try_element_at(u, i + 1) <= x["start"]) & F.coalesce((following(m, i)["kind"] == 3) | (following(m, i)["start"] >= x["end"]), F.lit(True))))
    kept = F.transform(F.array(both), lambda m: F.element_at(F.transform(F.array(upto(m)), lambda u: clear(m, u)), 1))
    return F.when((F.size(base) == 0) | (F.size(cand) == 0), F.concat(base, as_span)).otherwise(F.element_at(kept, 1))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with `_base` and `_spans`; the corpus's runs are counted first, in a scan of their own."""
    with discarding(docs.sparkSession):
        limits = thresholds(stage(runs_tested(docs, text_col), "runs"))
    text = F.col(text_col)
    found = docs.withColumn("_base", base_spans(text)).withColumn("_cand", candidates(text, limits))
    return found.withColumn("_spans", _all_spans(F.col("_base"), F.col("_cand"))).drop("_cand")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the fixed kinds, a digest of their spans, and all spans as text and as an array.

    Spans count code points, end exclusive. Null texts count as empty; repeated rows are scanned each; of an empty table the
    result is empty. Random candidates that overlap a fixed span are not repeated.
    """
    found = _scanned(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("_id").alias(id_col), *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"), F.col("_spans").alias("span_list")
    )


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for every stretch of overlapping spans.

    The text is cut as UTF-32, where a place is found without walking the letters before it.
    """
    wide = F.encode(text, "UTF-32")
    order = F.lit(bytes([0, 0, 0xFE, 0xFF]))  # says the order of bytes, so that a like letter of the text is kept
    piece = lambda w, a, b: F.decode(F.concat(order, F.substring(w, a * 4 + 1, (b - a) * 4)), "UTF-32")
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    starts = lambda e: F.filter(F.transform(spans, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at(e, i)).alias("a"), s["start"].alias("b"))), lambda p: p["b"] >= p["a"])
    pieces = lambda w, e: F.concat(F.transform(starts(e), lambda p: piece(w, p["a"], p["b"])), F.array(piece(w, F.element_at(e, -1), F.length(text))))
    done = F.transform(F.array(wide), lambda w: F.array_join(F.element_at(F.transform(F.array(ends), lambda e: pieces(w, e)), 1), mark))
    return F.element_at(done, 1)


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark, overlapping spans by one, and the length column set anew.

    Null texts stay null, repeated rows are rows of their own, and an empty table gives an empty one.
    """
    spans = _scanned(docs, text_col)
    text = F.col(text_col)
    clean = spans.withColumn("_done", F.when(F.size("_spans") > 0, _marked(text, F.col("_spans"), mark)).otherwise(text))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_done").alias(c))
        elif c == length_col:
            out.append(F.when(F.size("_spans") > 0, F.length("_done")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return clean.select(*out)


__all__ = ["base_spans", "candidates", "redacted", "runs_tested", "secrets", "thresholds"]
