"""Predicates between indicators: which of a pair is above, which crosses, touches or bounces off which, what zone it is in, and
how many bars ago a cross happened. Tables of names drive them; a candle's fields are a map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.operators import folds, indicators
from candlemill.operators.series import chunked

#: A field's name, and what it is of a candle with indicators. A field of 0 isn't known yet, but for DERIVED ones.
FIELDS: dict[str, str] = {
    "open": "open", "high": "high", "low": "low", "close": "close", "sma20": "sma20", "sma50": "sma50", "sma200": "sma200",
    "bb-upper": "bb_upper", "bb-lower": "bb_lower", "macd-line": "macd_line", "macd-signal": "macd_signal", "macd-hist": "macd_hist",
    "dmi-plus": "plus_di", "dmi-minus": "minus_di", "adx": "adx", "rsi": "rsi", "atr": "atr", "stoch-k": "stoch_k", "stoch-d": "stoch_d",
    "tenkan-sen": "tenkan_sen", "kijun-sen": "kijun_sen", "cloud-top": "cloud_top", "cloud-bottom": "cloud_bottom",
    "senkou-span-a": "senkou_a", "senkou-span-b": "senkou_b", "keltner-upper": "kelt_upper", "keltner-lower": "kelt_lower",
    "candle-range": "high - low", "candle-body": "abs(close - open)", "upper-wick": "high - greatest(close, open)", "lower-wick": "least(close, open) - low",
}
DERIVED = ("candle-range", "candle-body", "upper-wick", "lower-wick")
#: The pairs that are compared; a prev- field is of the candle before.
PAIRS: list[tuple[str, str]] = [
    ("close", "sma20"), ("close", "sma50"), ("close", "sma200"), ("close", "bb-upper"), ("close", "bb-lower"), ("sma20", "sma50"), ("sma50", "sma200"),
    ("macd-line", "macd-signal"), ("dmi-plus", "dmi-minus"),
    ("high", "prev-high"), ("low", "prev-low"), ("open", "prev-close"), ("close", "prev-close"), ("close", "prev-open"),
    ("open", "sma20"), ("open", "sma50"), ("open", "sma200"), ("open", "bb-upper"), ("open", "bb-lower"), ("high", "bb-upper"), ("low", "bb-lower"),
    ("close", "open"), ("upper-wick", "candle-body"), ("lower-wick", "candle-body"), ("upper-wick", "lower-wick"), ("candle-range", "atr"),
    ("candle-body", "candle-range"), ("high", "sma200"), ("low", "sma200"),
    ("close", "tenkan-sen"), ("close", "kijun-sen"), ("close", "cloud-top"), ("close", "cloud-bottom"), ("tenkan-sen", "kijun-sen"), ("close", "senkou-span-a"), ("close", "senkou-span-b"),
    ("stoch-k", "stoch-d"), ("close", "keltner-upper"), ("close", "keltner-lower"), ("bb-upper", "keltner-upper"),
]
#: Zones of a field, as a condition on x.
ZONES: list[tuple[str, str, str]] = [
    ("rsi", "overbought", "x > 70"), ("rsi", "oversold", "x < 30"), ("rsi", "above-midline", "x > 50"), ("rsi", "below-midline", "x <= 50"),
    ("adx", "strong-trend", "x > 25"), ("adx", "weak-trend", "x < 20"), ("dmi-plus", "strong-trend", "x > 25"), ("dmi-plus", "weak-trend", "x < 20"),
    ("dmi-minus", "strong-trend", "x > 25"), ("dmi-minus", "weak-trend", "x < 20"), ("macd-line", "positive", "x > 0"), ("macd-line", "negative", "x <= 0"),
    ("macd-hist", "positive", "x > 0"), ("macd-hist", "negative", "x <= 0"),
]
#: Crosses that stay facts for HORIZON candles.
REMEMBERED, HORIZON = [("sma50", "sma200"), ("macd-line", "macd-signal")], 12
_FOLDS = ("atr", "atr_ratio", "rsi", "macd_hist", *folds.LINES, "plus_di", "minus_di", "adx", "kelt_upper", "kelt_lower")


def _by():
    return Window.partitionBy("sym").orderBy("ts")


def fields(candles: DataFrame) -> DataFrame:
    """sym, ts, i, touch (how near counts as touching) and the maps now and before: a field's value by name, of this candle
    and of the one before (null at the first)."""

    def add(df: DataFrame) -> DataFrame:
        df = indicators.ichimoku(indicators.stochastic(indicators.sma(df)))
        mid, spread = indicators.mean(F.col("close"), 20), indicators.spread(F.col("close"), 20)
        long = indicators.last(52)
        df = df.withColumns({
            "bb_upper": mid + 2 * spread, "bb_lower": mid - 2 * spread, "senkou_a": (F.col("tenkan_sen") + F.col("kijun_sen")) / 2,
            "senkou_b": (F.max("high").over(long) + F.min("low").over(long)) / 2,
        })
        entries = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.expr(f"cast({e} as double)") for e in FIELDS.values())))
        df = df.withColumn("now", entries).withColumn("before", F.lag("now").over(_by()))
        return df.select("sym", "ts", "i", "own", (F.greatest("atr_ratio", F.lit(0.001)) * 0.1).alias("touch"), "now", "before")

    return chunked(folds.fold(candles, _FOLDS), add, before=202)


def _known(of: Column, name: Column, derived: Column) -> Column:
    v = of[name]
    return F.when(derived | (v != 0), v)


def comparisons(rich: DataFrame, pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """rich: of fields. sym, ts, predicate (above, below, crosses-above, crosses-below, touches, bounces-off), a, b.

    b counts as above a where they are equal. Where a field is unknown nothing holds; where it was unknown a candle before
    only above and below do, as for pairs with a prev- field. Bouncing is touching now and before, at a growing distance.
    """
    derived = lambda name: F.lit(name in DERIVED)
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b.removeprefix("prev-")).alias("field"), F.lit(b).alias("b"), F.lit(b.startswith("prev-")).alias("prev"), derived(a).alias("da"), derived(b).alias("db")) for a, b in pairs))
    df = rich.select("sym", "ts", "touch", "now", "before", F.explode(table).alias("p")).select("sym", "ts", "touch", "now", "before", "p.*")
    now_b = F.when(F.col("prev"), F.col("before")[F.col("field")]).otherwise(_known(F.col("now"), F.col("field"), F.col("db")))
    df = df.withColumns({"x": _known(F.col("now"), F.col("a"), F.col("da")), "y": now_b}).where("x is not null and y is not null")
    was = {n: F.when(~F.col("prev"), _known(F.col("before"), F.col(c), F.col(k))) for n, c, k in (("wx", "a", "da"), ("wy", "field", "db"))}
    df = df.withColumns(was)
    # without a candle before, a touch still counts; with one whose fields are unknown, it doesn't
    tells = ~F.col("prev") & (F.col("before").isNull() | (F.col("wx").isNotNull() & F.col("wy").isNotNull()))
    near = tells & (F.abs(F.col("x") - F.col("y")) < F.col("touch"))
    bounced = near & (F.abs(F.col("wx") - F.col("wy")) < F.col("touch")) & (F.abs(F.col("x") - F.col("y")) > F.abs(F.col("wx") - F.col("wy")))
    events = F.array(
        F.when(F.col("x") > F.col("y"), "above").otherwise("below"), F.when((F.col("wx") < F.col("wy")) & (F.col("x") >= F.col("y")), "crosses-above"),
        F.when((F.col("wx") > F.col("wy")) & (F.col("x") <= F.col("y")), "crosses-below"), F.when(near, "touches"), F.when(bounced, "bounces-off"),
    )
    return df.select("sym", "ts", F.explode(F.array_compact(events)).alias("predicate"), "a", "b")


def zones(rich: DataFrame) -> DataFrame:
    """sym, ts, predicate (at), a, b: the zones that a candle's fields are in."""
    holds = F.array(*(F.when(F.expr(rule.replace("x", f"now['{name}']")), F.struct(F.lit(name).alias("a"), F.lit(zone).alias("b"))) for name, zone, rule in ZONES))
    return rich.select("sym", "ts", F.explode(F.array_compact(holds)).alias("z")).select("sym", "ts", F.lit("at").alias("predicate"), "z.a", "z.b")


def since(rich: DataFrame, pairs: list[tuple[str, str]] = REMEMBERED, horizon: int = HORIZON) -> DataFrame:
    """sym, ts, predicate (crosses-above, crosses-below), a, b, bars: the crosses of the last horizon candles.

    A cross goes to the candles that follow it, and they meet it by an equal join on the series and the number of the row.
    """
    one = lambda a, b, up: (F.col("before")[a] < F.col("before")[b]) & (F.col("now")[a] >= F.col("now")[b]) if up else (F.col("before")[a] > F.col("before")[b]) & (F.col("now")[a] <= F.col("now")[b])
    known = lambda a, b: reduce(lambda p, q: p & q, (F.col(m)[c] != 0 for m in ("now", "before") for c in ((a, b) if a.startswith("sma") else (a,))))
    crossed = F.array_compact(F.array(*(F.when(known(a, b) & one(a, b, up), F.struct(F.lit("crosses-above" if up else "crosses-below").alias("predicate"), F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs for up in (True, False))))
    events = rich.select("sym", "i", F.explode(crossed).alias("e")).select("sym", "i", "e.*")
    later = events.withColumn("bars", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("i", F.col("i") + F.col("bars"))
    return later.join(rich.select("sym", "ts", "i"), ["sym", "i"]).select("sym", "ts", "predicate", "a", "b", "bars")
