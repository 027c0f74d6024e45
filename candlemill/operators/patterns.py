"""Harmonic price patterns and the regime measures of the first generation, over bounded windows of candles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.operators.series import chunked

#: Of each template, tried in this order, the least and greatest of AB/XA, BC/AB, CD/AB and AD/XA.
TEMPLATES = [
    ("gartley", (0.580, 0.658), (0.382, 0.886), (1.130, 1.618), (0.746, 0.826)),
    ("bat", (0.382, 0.500), (0.382, 0.886), (1.618, 2.618), (0.846, 0.926)),
    ("butterfly", (0.746, 0.826), (0.382, 0.886), (1.618, 2.240), (1.230, 1.658)),
    ("crab", (0.382, 0.618), (0.382, 0.886), (2.618, 3.618), (1.578, 1.658)),
    ("deep-crab", (0.846, 0.926), (0.382, 0.886), (2.240, 3.618), (1.578, 1.658)),
    ("cypher", (0.382, 0.618), (1.130, 1.414), (1.272, 2.000), (0.746, 0.826)),
]
#: A swing stands out from so many rows on each side; patterns are looked for in so many rows, given at least LEAST of them.
RADIUS, WINDOW, LEAST = 5, 256, 30
_SWING = "struct<price: double, up: boolean>"


def _by():
    return Window.partitionBy("sym").orderBy("ts")


def swings(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """df (sym, ts, high, low) with swing: an array of (price, up), the row's high and then its low where they are strictly
    beyond those of radius rows before and as many after; null where neither is."""
    sides = [_by().rowsBetween(-radius, -1), _by().rowsBetween(1, radius)]
    whole = reduce(lambda a, b: a & b, (F.count(F.lit(1)).over(w) == radius for w in sides))
    top = reduce(lambda a, b: a & b, (F.col("high") > F.max("high").over(w) for w in sides))
    low = reduce(lambda a, b: a & b, (F.col("low") < F.min("low").over(w) for w in sides))
    point = lambda c, up: F.struct(F.col(c).cast("double").alias("price"), F.lit(up).alias("up"))
    found = F.array_compact(F.array(F.when(whole & top, point("high", True)), F.when(whole & low, point("low", False))))
    return df.withColumn("swing", F.when(F.size(found) > 0, found))


def zigzag(points: Column, keep: int) -> Column:
    """The last keep of an array of swings after merging: of a run of one kind the most extreme stays, the first of equal ones."""

    def step(line: Column, s: Column) -> Column:
        last = F.element_at(line, -1)
        more = F.when(s["up"], s["price"] > last["price"]).otherwise(s["price"] < last["price"])
        merged = F.when(more, F.concat(F.slice(line, F.lit(1), F.size(line) - 1), F.array(s))).otherwise(line)
        longer = F.concat(F.when(F.size(line) >= keep, F.slice(line, 2, keep - 1)).otherwise(line), F.array(s))
        return F.when(F.size(line) == 0, F.array(s)).when(last["up"] == s["up"], merged).otherwise(longer)

    return F.aggregate(points, F.array().cast(f"array<{_SWING}>"), step)


def _fit(value: Column, low: Column, high: Column) -> Column:
    """1 in the middle of a range, 0 at its edges."""
    return 1 - F.least(F.abs(value - (low + high) / 2) / ((high - low) / 2), F.lit(1.0))


def match_templates(df: DataFrame) -> DataFrame:
    """df with columns x, a, b, c, d (prices of five turns): adds pattern, the first template that the legs' ratios fit, and
    quality, how near the middle of its ranges they lie; rows that fit none go."""
    span = lambda p, q: F.abs(F.col(p) - F.col(q))
    df = df.where((span("x", "a") >= 1e-10) & (span("a", "b") >= 1e-10) & (span("b", "c") >= 1e-10))
    ratios = [span("a", "b") / span("x", "a"), span("b", "c") / span("a", "b"), span("c", "d") / span("a", "b"), span("a", "d") / span("x", "a")]
    df = df.withColumns({f"_r{k}": r for k, r in enumerate(ratios)})
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*(F.lit(lo) for lo, _ in limits)).alias("lo"), F.array(*(F.lit(hi) for _, hi in limits)).alias("hi")) for name, *limits in TEMPLATES))
    inside = lambda t: reduce(lambda p, q: p & q, (F.col(f"_r{k}").between(t["lo"][k], t["hi"][k]) for k in range(4)))
    hit = F.get(F.filter(table, inside), F.lit(0))
    df = df.withColumn("_hit", hit).where(F.col("_hit").isNotNull())
    quality = sum((_fit(F.col(f"_r{k}"), F.col("_hit")["lo"][k], F.col("_hit")["hi"][k]) for k in range(4)), F.lit(0.0)) / 4
    return df.withColumns({"pattern": F.col("_hit")["name"], "quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))}).drop("_hit", *(f"_r{k}" for k in range(4)))


def harmonics(candles: DataFrame, *, radius: int = RADIUS, window: int = WINDOW, recent: int = 3) -> DataFrame:
    """sym, ts, back, pattern, bullish, quality: at each candle the harmonic patterns that its close completes.

    X, A, B and C are turns in a row of the zigzag of the last window rows (back: how many turns came after C, below recent),
    the close is D; bullish if X is a low. A swing is known radius rows after it; nothing later is read.
    """

    def add(df: DataFrame) -> DataFrame:
        df = swings(df, radius)
        known = F.flatten(F.collect_list("swing").over(_by().rowsBetween(-(window - 1 - radius), -radius)))
        count = F.count(F.lit(1)).over(_by().rowsBetween(-(window - 1), 0))
        df = df.withColumns({"_known": known, "_rows": count})
        # the zigzag is worked out once for all rows that know the same swings
        changed = F.size("_known") != F.coalesce(F.size(F.lag("_known").over(_by())), F.lit(-1))
        changed = changed | ~F.coalesce(F.col("_known") == F.lag("_known").over(_by()), F.lit(False))
        df = df.withColumn("_line", F.when(changed, zigzag(F.col("_known"), recent + 3)))
        return df.withColumn("_line", F.last("_line", ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0))).drop("_known", "swing")

    turns = chunked(candles.select("sym", "ts", "high", "low", "close"), add, before=window + radius, after=radius)
    turns = turns.where((F.col("_rows") >= LEAST) & (F.size("_line") >= 4))
    legs = F.transform(F.sequence(F.lit(0), F.least(F.lit(recent - 1), F.size("_line") - 4)), lambda k: F.struct(k.alias("back"), F.slice("_line", F.size("_line") - 3 - k, 4).alias("p")))
    rows = turns.select("sym", "ts", F.col("close").cast("double").alias("d"), F.explode(legs).alias("l"))
    prices = {name: F.col("l.p")[k]["price"] for k, name in enumerate("xabc")}
    found = match_templates(rows.withColumns(prices).withColumn("bullish", ~F.col("l.p")[0]["up"]))
    return found.select("sym", "ts", F.col("l.back").cast("int").alias("back"), "pattern", "bullish", "quality")


# --- regime ---------------------------------------------------------------------------------------------------------

#: Of each measure its zones, the first that holds counts.
ZONES: dict[str, list[tuple[str, str]]] = {
    "variance-ratio": [("vr > 1.3", "vr-momentum"), ("vr < 0.7", "vr-mean-revert"), ("vr is not null", "vr-neutral")],
    "td-count": [("abs(td) >= 9", "td-exhausted"), ("abs(td) >= 7", "td-mature"), ("abs(td) >= 4", "td-building"), ("td is not null", "td-inactive")],
    "aroon-up": [("up > 80 and down < 30", "aroon-strong-up"), ("down > 80 and up < 30", "aroon-strong-down"), ("up < 20 and down < 20", "aroon-stale"), ("up is not null", "aroon-consolidating")],
    "fractal-dim": [("katz < 1.3", "trending-geometry"), ("katz > 1.7", "mean-reverting-geometry"), ("katz is not null", "random-walk-geometry")],
    "entropy-rate": [("conditional_entropy < 0.7", "low-entropy-rate"), ("conditional_entropy is not null", "high-entropy-rate")],
    "gr-bvalue": [("b_value < 1", "heavy-tails"), ("b_value is not null", "light-tails")],
}
_ADD = lambda s, x: s + x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), _ADD)


def _slope(x: Column, y: Column) -> Column:
    """Least-squares slope of two arrays; null where all x agree."""
    n, sx, sy = F.size(x), _sum(x), _sum(y)
    spread = n * _sum(F.transform(x, lambda v: v * v)) - sx * sx
    return F.when(F.abs(spread) > 1e-10, (n * _sum(F.zip_with(x, y, lambda a, b: a * b)) - sx * sy) / spread)


def regime_extras(candles: DataFrame, *, window: int = 60, steps: int = 5, period: int = 25) -> DataFrame:
    """sym, ts and, over the last window rows (at least 20, else null): vr, td, up, down, katz, conditional_entropy, b_value.

    Returns are logarithmic; where a close of the window isn't positive the measures that need them are null. vr: second
    moment of steps-step sums over steps times that of single ones. td: closes in a row beyond the fourth before, signed. up, down: place of the
    last extreme among period + 1 rows, in percent. katz: Katz's fractal dimension. conditional_entropy: of the class of a
    return (up, down, flat) given the one before, in units of ln 3, from counts of pairs. b_value: how fast the number of
    larger moves falls with their size, from the four inner quintiles.
    """
    last = lambda n, end=0: _by().rowsBetween(-(n - 1), end)

    def add(df: DataFrame) -> DataFrame:
        before = F.lag("close").over(_by())
        ret = F.when((F.col("close") > 0) & (before > 0), F.log(F.when(F.col("close") > 0, F.col("close")) / F.when(before > 0, before)))
        df = df.withColumns({"_ret": ret, "_n": F.count(F.lit(1)).over(last(window))})
        kind = F.when(F.col("_ret") > 0.0001, 2).when(F.col("_ret") < -0.0001, 0).when(F.col("_ret").isNotNull(), 1)
        df = df.withColumn("_kind", kind)
        # a pair of returns needs three closes: the window holds window - 2 pairs
        df = df.withColumn("_pair", 3 * F.lag("_kind").over(_by()) + F.col("_kind"))
        pairs = {f"_p{k}": F.count(F.when(F.col("_pair") == k, 1)).over(last(window - 2)) for k in range(9)}
        listed = {"_c": F.collect_list("close").over(last(window)), "_r": F.collect_list("_ret").over(last(window - 1)), "_h": F.collect_list("high").over(last(period + 1)), "_l": F.collect_list("low").over(last(period + 1))}
        return df.withColumns(pairs | listed)

    df = chunked(candles.select("sym", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close"))), add, before=window + 1)
    df = df.where(F.col("_n") >= 20)
    whole = F.size("_r") == F.size("_c") - 1
    r, c = F.col("_r"), F.col("_c")
    df = df.withColumn("_var", F.when(whole, _sum(F.transform(r, lambda x: x * x)) / F.size(r)))
    sums = F.transform(F.sequence(F.lit(1), F.size(r) - steps + 1), lambda i: _sum(F.slice(r, i, steps)))
    df = df.withColumn("_sums", F.when(F.col("_var") > 1e-20, sums))
    vr = _sum(F.transform("_sums", lambda x: x * x)) / F.size("_sums") / steps / F.when(F.col("_var") > 1e-20, F.col("_var"))
    sign = F.transform(F.sequence(F.lit(5), F.size(c)), lambda i: F.signum(F.get(c, i - 1) - F.get(c, i - 5)).cast("int"))
    td = F.aggregate(sign, F.lit(0), lambda n, s: F.when(s == 0, 0).when(s > 0, F.when(n > 0, n + 1).otherwise(1)).otherwise(F.when(n < 0, n - 1).otherwise(-1)))
    place = lambda a, top: 100.0 * (F.size(a) - F.array_position(F.reverse(a), top(a))) / (F.size(a) - 1)
    moves = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.sqrt((F.get(c, i) - F.get(c, i - 1)) * (F.get(c, i) - F.get(c, i - 1)) + 1))
    df = df.withColumns({"_path": _sum(moves), "_far": F.aggregate(c, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x - F.get(c, F.lit(0)))))})
    log_n = F.log(F.size(c).cast("double"))
    safe = lambda x: F.when(x > 1e-10, x)
    spread = log_n + F.log(safe(F.col("_far")) / safe(F.col("_path")))
    katz = log_n / F.when(spread != 0, spread)
    enough = whole & (F.size(r) >= 20)
    firsts = [sum((F.col(f"_p{3 * i + j}") for j in range(3)), F.lit(0)) for i in range(3)]
    total = sum(firsts, F.lit(0))
    terms = [F.when(F.col(f"_p{3 * i + j}") > 0, -F.col(f"_p{3 * i + j}") / total * F.log(F.when(F.col(f"_p{3 * i + j}") > 0, F.col(f"_p{3 * i + j}") / F.when(firsts[i] > 0, firsts[i])))).otherwise(0.0) for i in range(3) for j in range(3)]
    df = df.withColumn("_a", F.when(enough, F.array_sort(F.transform(r, lambda x: F.abs(x)))))
    marks = F.filter(F.transform(F.array(*map(F.lit, range(1, 5))), lambda k: F.get("_a", F.floor(F.size("_a") * k / 5).cast("int"))), lambda t: t >= 1e-10)
    df = df.withColumn("_marks", marks)
    above = F.transform("_marks", lambda t: F.log(F.size(F.filter("_a", lambda x: x >= t)).cast("double")))
    df = df.withColumn("_slope", F.when(F.size("_marks") >= 3, _slope(F.transform("_marks", lambda t: F.log(t)), above)))
    out = {
        "vr": vr, "td": td, "up": place(F.col("_h"), F.array_max), "down": place(F.col("_l"), F.array_min), "katz": F.greatest(F.lit(1.0), F.least(F.lit(2.0), katz)),
        "conditional_entropy": F.when(enough, sum(terms, F.lit(0.0)) / math.log(3.0)), "b_value": -F.col("_slope"),
    }
    out["katz"] = F.when(katz.isNotNull(), out["katz"])
    return df.select("sym", "ts", *(v.alias(k) for k, v in out.items()))


def zone_facts(measures: DataFrame, zones: dict[str, list[tuple[str, str]]] = ZONES) -> DataFrame:
    """sym, ts, indicator, zone: of each indicator the first zone whose condition holds."""
    pick = lambda rules: reduce(lambda c, rule: c.when(F.expr(rule[0]), F.lit(rule[1])), rules[1:], F.when(F.expr(rules[0][0]), F.lit(rules[0][1])))
    each = F.array(*(F.struct(F.lit(name).alias("indicator"), pick(rules).alias("zone")) for name, rules in zones.items()))
    return measures.select("sym", "ts", F.explode(each).alias("f")).select("sym", "ts", "f.*").where("zone is not null")
