"""Candles to named facts in long form: (sym, ts, module, name, kind, value, lo, hi).

A module is a list of (name, kind, value expression, lo, hi). Expressions are SQL over the enriched candle's columns, null
where a fact doesn't arise, rounded half away from zero. Kinds: scaled, whose bounds follow the fact's own history (see
scaled); log, between lo and hi; reciprocal, a log between 1 / hi and hi; circular, with period hi; pair, two circular
facts bound to each other: value and lo hold the first and the second one's value.

Prices are above 0; where a close is 0, facts that divide by it don't arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.scalars import bucket, half_away

#: Least angle that two vectors of 10,000 dimensions tell apart; a scaled fact is held in steps of it.
NOISE_FLOOR = 0.05


def _r(x: str, digits: int = 2) -> str:
    """SQL for x rounded half away from zero on the scaled double."""
    p = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {p}.0D + 0.5D) / {p}.0D)"


def _clamped(x: str) -> str:
    return f"greatest(-1.0D, least(1.0D, {x}))"


def _of_close(x: str, digits: int = 4) -> str:
    return f"case when close <> 0 then {_r(f'(({x}) / close)', digits)} end"


def _percent(x: str) -> str:
    """In hundredths of the close, clamped."""
    return f"case when close <> 0 then {_r(_clamped(f'({x}) / (close * 0.01D)'))} end"


def _of_range(x: str, flat: str) -> str:
    return f"case when high > low then {_r(f'(({x}) / (high - low))')} else {flat} end"


def _scaled(name: str, value: str) -> tuple:
    return name, "scaled", value, 0.0, 0.0


def _log(name: str, value: str, lo: float, hi: float) -> tuple:
    return name, "log", value, lo, hi


def _reciprocal(name: str, value: str, n: float) -> tuple:
    return name, "reciprocal", value, 1.0 / n, n


def _circular(name: str, column: str, period: float) -> tuple:
    return name, "circular", f"round({column})", 0.0, period


_CLOUD = "(close - (cloud_top + cloud_bottom) / 2)"
MODULES: dict[str, list[tuple[str, str, str, float, float]]] = {
    "time": [
        _circular("minute", "minute", 60), _circular("hour", "hour", 24), _circular("day-of-week", "day_of_week", 7), _circular("day-of-month", "day_of_month", 31), _circular("month-of-year", "month_of_year", 12),
        *((f"{a}-x-{b}", "pair", f"round({c})", d, 0.0) for a, c, b, d in (("minute", "minute", "hour", "round(hour)"), ("hour", "hour", "day-of-week", "round(day_of_week)"), ("day-of-week", "day_of_week", "month-of-year", "round(month_of_year)"))),
    ],
    "exit-time": [_circular("hour", "hour", 24), _circular("day-of-week", "day_of_week", 7)],
    "oscillators": [
        _scaled("rsi", _r("rsi")), _scaled("cci", _r("(cci / 300)")), _scaled("mfi", _r("(mfi / 100)")), _scaled("williams-r", _r("((williams_r + 100) / 100)")),
        *(_reciprocal(f"roc-{n}", _r(f"(1 + roc_{n})"), 2.0) for n in (1, 3, 6, 12)),
    ],
    "divergence": [
        _scaled("rsi-divergence-bull", f"case when rsi_divergence_bull > 0 then {_r('rsi_divergence_bull')} end"), _scaled("rsi-divergence-bear", f"case when rsi_divergence_bear > 0 then {_r('rsi_divergence_bear')} end"),
        _scaled("divergence-spread", f"case when rsi_divergence_bull > 0 or rsi_divergence_bear > 0 then {_r('(rsi_divergence_bull - rsi_divergence_bear)')} end"),
    ],
    "fibonacci": [*(_scaled(f"range-pos-{n}", _r(f"range_pos_{n}")) for n in (12, 24, 48)), *(_scaled(f"fib-dist-{k}", _r(f"(range_pos_48 - 0.{k}D)")) for k in (236, 382, 500, 618, 786))],
    "persistence": [_scaled("hurst", _r("hurst")), _scaled("autocorrelation", _r("autocorrelation")), _scaled("adx", _r("(adx / 100)"))],
    "stochastic": [_scaled("stoch-k", _r("(stoch_k / 100)")), _scaled("stoch-d", _r("(stoch_d / 100)")), _scaled("stoch-kd-spread", _r("(stoch_k / 100 - stoch_d / 100)")), _scaled("stoch-cross-delta", _r(_clamped("stoch_cross_delta")))],
    "regime": [
        _scaled("kama-er", _r("kama_er")), _scaled("choppiness", _r("(choppiness / 100)")), _scaled("dfa-alpha", _r("(dfa_alpha / 2)")), _reciprocal("variance-ratio", _r("greatest(variance_ratio, 0.001D)"), 10.0),
        _scaled("entropy-rate", _r("entropy_rate")), _scaled("aroon-up", _r("(aroon_up / 100)")), _scaled("aroon-down", _r("(aroon_down / 100)")), _scaled("fractal-dim", _r("(fractal_dim - 1)")),
    ],
    "timeframe": [
        _scaled("tf-1h-trend", _r("tf_1h_body")), _scaled("tf-1h-ret", _r("tf_1h_ret", 4)), _scaled("tf-4h-trend", _r("tf_4h_body")), _scaled("tf-4h-ret", _r("tf_4h_ret", 4)), _scaled("tf-agreement", _r("tf_agreement")),
        _scaled("tf-5m-1h-align", _of_close("sign(tf_1h_body) * (close - open)")),
    ],
    "momentum": [
        *(_scaled(f"close-sma{n}", _of_close(f"close - sma{n}")) for n in (20, 50, 200)), _scaled("macd-hist", _of_close("macd_hist")), _scaled("di-spread", _r("((plus_di - minus_di) / 100)")),
        _log("atr-ratio", _r("greatest(atr_ratio, 0.001D)", 4), 0.001, 0.5),
    ],
    "flow": [
        _reciprocal("obv-slope", "exp(obv_slope_12)", 10.0), _scaled("vwap-distance", _r("vwap_distance", 4)), _scaled("buying-pressure", _of_range("close - low", "0.5D")), _scaled("selling-pressure", _of_range("high - close", "0.5D")),
        _reciprocal("volume-ratio", "exp(volume_accel)", 10.0), _scaled("body-ratio", _of_range("abs(close - open)", "0.0D")),
    ],
    "ichimoku": [
        _scaled("cloud-position", f"case when close <> 0 then {_r(_clamped(f'(case when cloud_top > cloud_bottom then {_CLOUD} / greatest(cloud_top - cloud_bottom, close * 0.001D) else {_CLOUD} / (close * 0.01D) end)'))} end"),
        _log("cloud-thickness", f"case when close <> 0 then {_r('greatest((cloud_top - cloud_bottom) / close, 0.0001D)', 4)} end", 0.0001, 0.5), _scaled("tk-cross-delta", _r(_clamped("tk_cross_delta"))),
        _scaled("tk-spread", _percent("tenkan_sen - kijun_sen")), _scaled("tenkan-dist", _percent("close - tenkan_sen")), _scaled("kijun-dist", _percent("close - kijun_sen")),
    ],
    "keltner": [
        _scaled("bb-pos", _r("bb_pos")), _log("bb-width", _r("greatest(bb_width, 0.001D)", 4), 0.001, 0.5), _scaled("kelt-pos", _r("kelt_pos")), _scaled("squeeze", _r("squeeze")),
        _scaled("kelt-upper-dist", _of_close("close - kelt_upper")), _scaled("kelt-lower-dist", _of_close("close - kelt_lower")),
    ],
    "price-action": [
        _log("range-ratio", _r("greatest(range_ratio, 0.001D)", 4), 0.001, 0.5), _scaled("gap", _r(_clamped("gap / 0.05D"), 4)), _log("consecutive-up", _r("greatest(1.0D + consecutive_up, 1.0D)"), 1.0, 20.0), _log("consecutive-down", _r("greatest(1.0D + consecutive_down, 1.0D)"), 1.0, 20.0),
        _scaled("body-ratio-pa", _of_range("abs(close - open)", "0.0D")), _scaled("upper-wick", _of_range("high - greatest(open, close)", "0.0D")), _scaled("lower-wick", _of_range("least(open, close) - low", "0.0D")),
    ],
    "standard": [
        *(_log(f"since-{n}", _r(f"greatest(cast(since_{c} as double), 1.0D)"), 1.0, 100.0) for n, c in (("rsi-extreme", "rsi_extreme"), ("vol-spike", "vol_spike"), ("large-move", "large_move"))),
        *(_scaled(f"dist-from-{n}", _of_close(f"close - {c}")) for n, c in (("high", "window_high"), ("low", "window_low"), ("midpoint", "(window_high + window_low) / 2"), ("sma200", "sma200"))),
        _log("session-depth", "cast(1 + session_rows as double)", 1.0, 100.0),
    ],
}
#: Which modules a lens reads; all market lenses read the time, too.
LENSES = {
    "dow-trend": ("momentum", "persistence", "regime", "timeframe"), "dow-volume": ("flow", "standard", "keltner"), "dow-cycle": ("oscillators", "keltner", "momentum", "standard", "timeframe"),
    "dow-generalist": ("momentum", "persistence", "regime", "timeframe", "flow", "standard", "keltner", "oscillators"),
    "pring-impulse": ("oscillators", "momentum", "persistence"), "pring-confirmation": ("flow", "oscillators", "divergence", "timeframe"), "pring-regime": ("regime", "persistence", "keltner"),
    "pring-generalist": ("oscillators", "momentum", "persistence", "flow", "divergence", "timeframe", "regime", "keltner"),
    "wyckoff-effort": ("flow", "price-action", "oscillators", "standard"), "wyckoff-persistence": ("persistence", "regime", "momentum", "oscillators"),
    "wyckoff-position": ("momentum", "standard", "regime", "divergence", "fibonacci"),
}
REGIME_LENSES = {"core": ("regime", "exit-time"), "full": ("regime", "exit-time", "phase-current", "phase-scalar")}


def facts(enriched: DataFrame, modules: tuple[str, ...] = tuple(MODULES)) -> DataFrame:
    """One row for each fact, bounds of scaled ones included; all modules come from one pass over the candles."""
    number = lambda x: F.expr(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    rows = [
        F.struct(F.lit(m).alias("module"), F.lit(n).alias("name"), F.lit(k).alias("kind"), number(e).alias("value"), number(lo).alias("lo"), number(hi).alias("hi"))
        for m in modules
        for n, k, e, lo, hi in MODULES[m]
    ]
    long = enriched.select("sym", "ts", F.explode(F.array(*rows)).alias("f")).select("sym", "ts", "f.*").where("value is not null")
    return scaled(long)


def tracked(value: Column, names: list[str], order: list[str]) -> tuple[Column, Column]:
    """(n, level): the number of the value in its history, and the moving mean of absolute values with weight 1 / max(n, 100).

    The first hundred have the weight 0.01, so the level is a geometric sum; from then on n times the level grows by
    each value. Both are running sums, no recursion is left.
    """
    by = Window.partitionBy(*names).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(by)
    early = F.sum(F.when(F.col("_n") <= 100, 0.01 * F.abs(value) * F.pow(F.lit(0.99), -F.col("_n")))).over(upto)
    late = F.sum(F.when(F.col("_n") > 100, F.abs(value)).otherwise(0.0)).over(upto)
    level = F.pow(F.lit(0.99), F.least(F.col("_n"), F.lit(100))) * early
    return n, F.when(F.col("_n") <= 100, level).otherwise((100 * level + late) / F.col("_n"))


def scale_of(level: Column) -> Column:
    """Twice the level, at least 0.001, in cents: it may be 0.00. Values come in cents, so halves of cents are exact: the noise of sums is rounded off first."""
    return half_away(F.greatest(F.round(2 * level, 10), F.lit(0.001)), 2)


def scaled(long: DataFrame) -> DataFrame:
    """Facts of kind scaled: bounds -s and s, and the value in steps of s * NOISE_FLOOR, from the scale of its history."""
    n, level = tracked(F.col("value"), ["sym", "module", "name"], ["ts"])
    df = long.withColumn("_n", n).withColumn("_s", scale_of(level))
    is_scaled = F.col("kind") == "scaled"
    held = bucket(F.col("value"), F.col("_s") * NOISE_FLOOR)
    return df.select(
        "sym", "ts", "module", "name", "kind", F.when(is_scaled, held).otherwise(F.col("value")).alias("value"), F.when(is_scaled, -F.col("_s")).otherwise(F.col("lo")).alias("lo"), F.when(is_scaled, F.col("_s")).otherwise(F.col("hi")).alias("hi")
    )


def lens_facts(all_facts: DataFrame) -> DataFrame:
    """Facts by lens: a join with the table of lenses, which has a row for each lens and module."""
    spark = all_facts.sparkSession
    rows = [(lens, m) for lens, ms in LENSES.items() for m in ("time", *ms)] + [(lens, m) for lens, ms in REGIME_LENSES.items() for m in ms]
    return all_facts.join(F.broadcast(spark.createDataFrame(rows, "lens string, module string")), "module")


def standard(df: DataFrame, window: int = 48) -> DataFrame:
    """Columns over the last window rows: rows since the last extreme rsi (above 80, below 20), volume spike (volume_accel > 2)
    and large move (|roc_1| > 0.02), this row being 1, the number of rows where there was none; highest, lowest, rows."""
    by = Window.partitionBy("sym").orderBy("ts")
    w = by.rowsBetween(-(window - 1), 0)
    df = df.withColumn("_i", F.row_number().over(by))
    since = lambda c: F.coalesce(F.col("_i") - F.max(F.when(c, F.col("_i"))).over(w) + 1, F.count("*").over(w))
    return df.withColumns({
        "since_rsi_extreme": since((F.col("rsi") > 80) | (F.col("rsi") < 20)), "since_large_move": since(F.abs(F.col("roc_1")) > 0.02), "since_vol_spike": since(F.col("volume_accel") > 2),
        "window_high": F.max("high").over(w), "window_low": F.min("low").over(w), "session_rows": F.count("*").over(w),
    }).drop("_i")


def phase_current(labels: DataFrame) -> DataFrame:
    """Facts of each candle's phase: its label as a name, and its duration, scaled by its history."""
    label = F.when(F.col("phase_label") == "Transition", F.concat(F.lit("phase-transition-"), F.lower("phase_direction"))).otherwise(F.concat(F.lit("phase-"), F.lower("phase_label")))
    each = labels.select("sym", "ts", F.explode(F.array(
        F.struct(label.alias("name"), F.lit("atom").alias("kind"), F.lit(1.0).alias("value")),
        F.struct(F.lit("phase-duration").alias("name"), F.lit("scaled").alias("kind"), F.col("phase_duration").cast("double").alias("value")),
    )).alias("f"))
    return scaled(each.select("sym", "ts", F.lit("phase-current").alias("module"), "f.*", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))


def phase_scalars(records: DataFrame) -> DataFrame:
    """Per closed phase, as the history stands then: trends of the mean closes of the last two valleys and of the last two
    peaks, and the ratios of range and of duration of the last two phases, whatever their labels; null where there are no two."""
    by = Window.partitionBy("sym").orderBy("start_candle", "end_candle")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("sym", "label").orderBy("start_candle", "end_candle")
    over = lambda a, b, digits: F.when(b > 0, half_away(a / F.when(b > 0, b), digits))
    width = F.col("close_max") - F.col("close_min")
    before = F.lag("close_avg").over(same)
    marked = records.withColumn("_trend", F.struct(over(F.col("close_avg") - before, before, 4).alias("v")))
    kept = lambda label: F.last(F.when((F.col("label") == label) & F.col("_pair"), F.col("_trend")), True).over(upto)["v"]
    out = marked.withColumn("_pair", before.isNotNull())
    return out.select(
        "sym", "label", "start_candle", kept("Valley").alias("valley_trend"), kept("Peak").alias("peak_trend"),
        over(width, F.lag(width).over(by), 2).alias("range_trend"), over(F.col("duration").cast("double"), F.lag(F.col("duration").cast("double")).over(by), 2).alias("spacing_trend"),
    )


TRADE_ATOMS = (
    ("exit-excursion", "log", "greatest(excursion, 0.0001D)", 0.0001, 0.5), ("exit-retracement", "linear", "retracement", -1.0, 1.0), ("exit-age", "log", "greatest(age, 1.0D)", 1.0, 100.0), ("exit-peak-age", "log", "greatest(peak_age, 1.0D)", 1.0, 100.0), ("exit-signaled", "linear", "signaled", -1.0, 1.0),
    ("exit-trail-distance", "log", "greatest(trail_distance, 0.0001D)", 0.0001, 0.5), ("exit-stop-distance", "log", "greatest(stop_distance, 0.0001D)", 0.0001, 0.5), ("exit-r-multiple", "log", "greatest(r_multiple, 0.0001D)", 0.0001, 10.0), ("exit-heat", "linear", "least(heat, 1.0D)", -1.0, 1.0),
    ("exit-trail-cushion", "linear", "cushion", -1.0, 1.0), ("phases-since-entry", "log", "greatest(cast(phases_since as double), 1.0D)", 1.0, 100.0), ("phases-survived", "log", "greatest(cast(phases_survived as double), 1.0D)", 1.0, 100.0), ("entry-vs-phase-avg", "linear", "entry_vs_phase_avg", -1.0, 1.0),
)
#: The core lens reads the first five atoms, the full one all.
CORE_ATOMS = 5


def trade_state(papers: DataFrame) -> DataFrame:
    """papers (sym, at, paper, direction, entry, price, extreme, trail_level, signaled, trail_distance, stop_distance, and
    phases_since, phases_survived, phase_avg): what the thirteen atoms are made of, at each row of each open paper."""
    by = Window.partitionBy("sym", "paper").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    df = papers.withColumns({"_i": F.row_number().over(by), "excursion": F.abs(F.col("extreme") - F.col("entry")) / F.when(F.col("entry") != 0, F.col("entry"))})
    df = df.withColumn("age", (F.col("_i") - 1).cast("double"))
    # The last row so far whose price is the extreme: the extreme's own prices repeat it exactly.
    df = df.withColumn("_at", F.last(F.when(F.abs(F.col("price") - F.col("extreme")) < 1e-10, F.col("_i")), True).over(upto))
    moved = F.col("excursion") > 0.0001
    span = F.col("extreme") - F.col("entry")
    df = df.withColumns({
        "peak_age": F.coalesce(F.col("_i") - F.col("_at"), F.lit(0)).cast("double"),
        "retracement": F.when(moved, F.least(F.abs((F.col("extreme") - F.col("price")) / F.when(span != 0, span)), F.lit(1.0))).otherwise(0.0),
        "r_multiple": F.when(F.col("stop_distance") > 0.0001, F.col("excursion") / F.when(F.col("stop_distance") > 0.0001, F.col("stop_distance"))).otherwise(0.0),
        "cushion": F.when(moved, F.least(F.abs(F.col("price") - F.col("trail_level")) / F.abs(F.when(span != 0, span)), F.lit(1.0))).otherwise(0.0),
        "entry_vs_phase_avg": F.coalesce((F.col("entry") - F.col("phase_avg")) / F.when(F.col("entry") != 0, F.col("entry")), F.lit(0.0)),
    })
    left = F.greatest(F.col("excursion") - F.col("retracement") * F.col("excursion"), F.lit(0.0))
    return df.withColumn("heat", F.when(left > 0.0001, F.col("trail_distance") / F.when(left > 0.0001, left)).otherwise(1.0)).drop("_i", "_at")


def trade_atoms(state: DataFrame, full: bool = True) -> DataFrame:
    """(sym, at, paper, place, name, kind, value, lo, hi): the atoms of each row of trade_state."""
    chosen = TRADE_ATOMS if full else TRADE_ATOMS[:CORE_ATOMS]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.expr(e).cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (n, k, e, lo, hi) in enumerate(chosen, 1)]
    return state.select("sym", "at", "paper", F.explode(F.array(*rows)).alias("a")).select("sym", "at", "paper", "a.*")
