"""Rhythms: an indicator's last values as one vector, for every indicator that a lens reads, and for a portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators.vocabulary import LENSES, REGIME_LENSES

#: Of each module the indicators, as SQL over the enriched candle, with the bounds of the value and of its change.
SPECS: dict[str, list[tuple[str, str, float, float, float]]] = {
    "momentum": [*((f"close-sma{n}", f"(close - sma{n}) / greatest(sma{n}, 0.01D)", -r, r, c) for n, r, c in ((20, 0.1, 0.05), (50, 0.2, 0.1), (200, 0.5, 0.1))), ("macd-hist", "macd_hist", -500, 500, 100), ("plus-di", "plus_di", 0, 100, 10), ("minus-di", "minus_di", 0, 100, 10), ("atr-ratio", "atr_ratio", 0, 0.05, 0.01)],
    "oscillators": [
        ("rsi", "rsi", 0, 100, 10), ("stoch-k", "stoch_k", 0, 100, 10), ("williams-r", "williams_r", -100, 0, 10), ("cci", "cci", -300, 300, 50), ("mfi", "mfi", 0, 100, 10),
        *((f"roc-{n}", f"roc_{n}", -r, r, c) for n, r, c in ((1, 0.05, 0.02), (3, 0.1, 0.03), (6, 0.15, 0.05), (12, 0.2, 0.05))),
    ],
    "flow": [("obv-slope", "obv_slope_12", -2, 2, 1), ("volume-accel", "volume_accel", 0, 3, 1), ("vwap-distance", "vwap_distance", -0.05, 0.05, 0.02)],
    "persistence": [("hurst", "hurst", 0, 1, 0.2), ("autocorrelation", "autocorrelation", -1, 1, 0.3), ("adx", "adx", 0, 100, 10)],
    "regime": [
        ("kama-er", "kama_er", 0, 1, 0.2), ("choppiness", "choppiness", 0, 100, 10), ("dfa-alpha", "dfa_alpha", 0, 2, 0.3), ("variance-ratio", "variance_ratio", 0, 3, 0.5), ("entropy-rate", "entropy_rate", 0, 1, 0.2), ("aroon-up", "aroon_up", 0, 100, 10), ("aroon-down", "aroon_down", 0, 100, 10),
        ("fractal-dim", "fractal_dim", 1, 2, 0.2),
    ],
    "keltner": [("bb-pos", "bb_pos", -0.5, 1.5, 0.3), ("bb-width", "bb_width", 0, 0.2, 0.05), ("kelt-pos", "kelt_pos", -0.5, 1.5, 0.3), ("squeeze", "squeeze", 0, 2, 0.3)],
    "timeframe": [("tf-1h-ret", "tf_1h_ret", -0.05, 0.05, 0.02), ("tf-4h-ret", "tf_4h_ret", -0.1, 0.1, 0.03), ("tf-agreement", "tf_agreement", -1, 1, 0.3)],
    "divergence": [("rsi-div-bull", "rsi_divergence_bull", 0, 1, 0.3), ("rsi-div-bear", "rsi_divergence_bear", 0, 1, 0.3)],
    "price-action": [("range-ratio", "range_ratio", 0, 5, 1), ("gap", "gap", -0.05, 0.05, 0.02), ("consecutive-up", "consecutive_up", 0, 10, 2), ("consecutive-down", "consecutive_down", 0, 10, 2)],
    "fibonacci": [(f"range-pos-{n}", f"range_pos_{n}", 0, 1, 0.2) for n in (12, 24, 48)],
    "phase": [("phase-duration", "phase_duration", 0, 200, 50)],
}
#: The same for a portfolio's snapshots.
PORTFOLIO = [("avg-paper-age", "avg_age", 0, 500, 100), ("avg-time-pressure", "avg_tp", 0, 1, 0.2), ("avg-unrealized-residue", "avg_unrealized", -0.1, 0.1, 0.05), ("grace-rate", "grace_rate", 0, 1, 0.2), ("active-positions", "active", 0, 500, 100)]


def specs(spark: SparkSession) -> DataFrame:
    """(lens, name, lo, hi, delta): the indicators of each lens; the full regime lens has the phase's duration, too."""
    rows = [(lens, n, float(lo), float(hi), float(c)) for lens, ms in {**LENSES, **REGIME_LENSES}.items() for m in (*ms, *(["phase"] if lens == "full" else [])) for n, _, lo, hi, c in SPECS.get(m, [])]
    return spark.createDataFrame(rows, "lens string, name string, lo double, hi double, delta double")


def _rhythms(df: DataFrame, keys: tuple[str, str], listed: list[tuple[str, str, float, float, float]], d: int) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.expr(e).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(float(c)).alias("delta")) for n, e, lo, hi, c in listed))
    long = df.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.*")
    last = F.collect_list("value").over(Window.partitionBy(keys[0], "name").orderBy(keys[1]).rowsBetween(-(V.capacity(d) + 2), 0))
    return long.withColumn("_l", last).select(*keys, "name", V.rhythm(F.col("_l"), F.col("lo"), F.col("hi"), F.col("delta"), d, F.col("name")).alias("rhythm"))


def indicator_rhythms(enriched: DataFrame, d: int) -> DataFrame:
    """(sym, ts, name, rhythm) of every indicator; lenses join them by name."""
    return _rhythms(enriched, ("sym", "ts"), [x for listed in SPECS.values() for x in listed], d)


def snapshots(states: DataFrame, rows: DataFrame, horizon: int) -> DataFrame:
    """states: of papers.trailing; rows (sym, at): of the papers alive at each row the mean age, its share of the horizon and the
    mean directed gain, and the share of grace among those that have left."""
    sign = F.when(F.col("direction") == "Up", 1.0).otherwise(-1.0)
    alive = states.where("resolved_at is null or at < resolved_at")
    age = F.col("at") - F.col("opened")
    now = alive.groupBy("sym", "at").agg(F.avg(age).alias("avg_age"), F.avg(age / horizon).alias("avg_tp"), F.avg(sign * (F.col("price") - F.col("entry")) / F.col("entry")).alias("avg_unrealized"), F.count("*").alias("active"))
    left = states.where("at = resolved_at").groupBy("sym", "at").agg(F.count("*").alias("_n"), F.sum(F.col("grace").cast("int")).alias("_g"))
    upto = Window.partitionBy("sym").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    done = rows.join(left, ["sym", "at"], "left").withColumns({"_n": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_g": F.coalesce(F.sum("_g").over(upto), F.lit(0))})
    rate = F.when(F.col("_n") > 0, F.col("_g") / F.when(F.col("_n") > 0, F.col("_n"))).otherwise(0.0)
    return now.join(done, ["sym", "at"]).select("sym", "at", "avg_age", "avg_tp", "avg_unrealized", rate.alias("grace_rate"), "active")


def portfolio_rhythms(snaps: DataFrame, d: int) -> DataFrame:
    return _rhythms(snaps, ("sym", "at"), PORTFOLIO, d)
