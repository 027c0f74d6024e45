"""Windowed indicators: every function adds columns to candles (sym, ts, open, high, low, close, volume).

All are bounded frames over one ordering, so Spark plans one exchange on sym and one sort for any number of them.
Warm-up follows the engine that they come from: partial means, and defaults while a window isn't full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.scalars import ratio


def _by():
    return Window.partitionBy("sym").orderBy("ts")


def last(n: int):
    return _by().rowsBetween(-(n - 1), 0)


def full(n: int) -> Column:
    return F.count("*").over(last(n)) == n


def mean(c: Column, n: int) -> Column:
    return F.avg(c).over(last(n))


def spread(c: Column, n: int) -> Column:
    """Population standard deviation, 0 for one row."""
    return F.coalesce(F.stddev_pop(c).over(last(n)), F.lit(0.0))


def previous(c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(_by())


def sma(df: DataFrame) -> DataFrame:
    return df.withColumns({f"sma{n}": mean(F.col("close"), n) for n in (20, 50, 200)})


def bollinger(df: DataFrame) -> DataFrame:
    m, s = mean(F.col("close"), 20), spread(F.col("close"), 20)
    return df.withColumns({"bb_width": ratio(4 * s, m), "bb_pos": ratio(F.col("close") - (m - 2 * s), 4 * s, 0.5)})


def stochastic(df: DataFrame) -> DataFrame:
    hi, lo = F.max(F.col("high")).over(last(14)), F.min(F.col("low")).over(last(14))
    df = df.withColumns({"_full": full(14), "_hi": hi, "_lo": lo})
    k = F.when(F.col("_full"), ratio(100 * (F.col("close") - F.col("_lo")), F.col("_hi") - F.col("_lo"), 50.0))
    df = df.withColumn("_k", k)
    will = F.when(F.col("_full"), ratio(-100 * (F.col("_hi") - F.col("close")), F.col("_hi") - F.col("_lo"), -50.0)).otherwise(-50.0)
    df = df.withColumns({"stoch_k": F.coalesce("_k", F.lit(50.0)), "stoch_d": F.coalesce(F.avg("_k").over(last(3)), F.lit(50.0)), "williams_r": will})
    d = F.col("stoch_k") - F.col("stoch_d")
    return df.withColumn("stoch_cross_delta", d - F.coalesce(previous(d), F.lit(0.0))).drop("_full", "_hi", "_lo", "_k")


def cci(df: DataFrame) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", tp)
    df = df.withColumns({"_m": mean(F.col("_tp"), 20), "_all": F.collect_list("_tp").over(last(20)), "_full": full(20)})
    md = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / F.size("_all")
    return df.withColumn("cci", F.when(F.col("_full"), ratio(F.col("_tp") - F.col("_m"), 0.015 * md)).otherwise(0.0)).drop("_tp", "_m", "_all", "_full")


def mfi(df: DataFrame) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", tp).withColumn("_p", previous(F.col("_tp")))
    flow = F.col("_tp") * F.col("volume")
    up = F.when(F.col("_p").isNotNull(), F.when(F.col("_tp") > F.col("_p"), flow).otherwise(0.0))
    down = F.when(F.col("_p").isNotNull(), F.when(F.col("_tp") > F.col("_p"), 0.0).otherwise(flow))
    df = df.withColumns({"_u": F.coalesce(F.sum(up).over(last(14)), F.lit(0.0)), "_d": F.coalesce(F.sum(down).over(last(14)), F.lit(0.0))})
    return df.withColumn("mfi", F.when(F.col("_d") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(F.col("_u"), F.col("_d"))))).drop("_tp", "_p", "_u", "_d")


def slope(y: Column, n: int) -> Column:
    return F.coalesce(F.regr_slope(y, F.col("_i")).over(last(n)), F.lit(0.0))


def obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - previous(F.col("close"))), F.lit(0.0)) * F.col("volume")
    df = df.withColumns({"_s": step, "_i": F.row_number().over(_by()).cast("double")})
    df = df.withColumn("_obv", F.sum("_s").over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumns({"obv_slope_12": slope(F.col("_obv"), 12), "volume_accel": F.col("volume") / F.when(mean(F.col("volume"), 20) == 0, 1.0).otherwise(mean(F.col("volume"), 20))}).drop("_s", "_i", "_obv")


def roc(df: DataFrame) -> DataFrame:
    """roc_12 is 0 throughout: the engine keeps twelve closes, one too few. roc_12_whole is what it would be."""
    change = lambda n: F.coalesce(ratio(F.col("close") - previous(F.col("close"), n), previous(F.col("close"), n)), F.lit(0.0))
    return df.withColumns({**{f"roc_{n}": F.when(previous(F.col("close"), n).isNull(), 0.0).otherwise(change(n)) for n in (1, 3, 6)}, "roc_12": F.lit(0.0), "roc_12_whole": F.when(previous(F.col("close"), 12).isNull(), 0.0).otherwise(change(12))})


def range_position(df: DataFrame) -> DataFrame:
    pos = lambda n: ratio(F.col("close") - F.min(F.col("low")).over(last(n)), F.max(F.col("high")).over(last(n)) - F.min(F.col("low")).over(last(n)), 0.5)
    return df.withColumns({f"range_pos_{n}": pos(n) for n in (12, 24, 48)})


def timeframe(df: DataFrame) -> DataFrame:
    out = {}
    for name, n in (("1h", 12), ("4h", 48)):
        first = F.first(F.col("close")).over(last(n))
        out[f"tf_{name}_ret"] = ratio(F.col("close") - first, first)
        out[f"tf_{name}_body"] = ratio(F.abs(F.col("close") - first), F.max(F.col("close")).over(last(n)) - F.min(F.col("close")).over(last(n)))
    df = df.withColumns(out)
    five = F.coalesce(F.signum(F.col("close") - previous(F.col("close"))), F.lit(0.0))
    a, b = F.signum("tf_1h_ret"), F.signum("tf_4h_ret")
    return df.withColumn("tf_agreement", (five * a + five * b + a * b) / 3)


def ichimoku(df: DataFrame) -> DataFrame:
    mid = lambda n: (F.max(F.col("high")).over(last(n)) + F.min(F.col("low")).over(last(n))) / 2
    df = df.withColumns({"tenkan_sen": mid(9), "kijun_sen": mid(26), "_b": mid(52)})
    a = (F.col("tenkan_sen") + F.col("kijun_sen")) / 2
    df = df.withColumns({"cloud_top": F.greatest(a, "_b"), "cloud_bottom": F.least(a, "_b"), "_s": F.col("tenkan_sen") - F.col("kijun_sen")})
    return df.withColumn("tk_cross_delta", F.col("_s") - F.coalesce(previous(F.col("_s")), F.lit(0.0))).drop("_b", "_s")


def vwap(df: DataFrame) -> DataFrame:
    ever = _by().rowsBetween(Window.unboundedPreceding, 0)
    v = ratio(F.sum(F.col("close") * F.col("volume")).over(ever), F.sum(F.col("volume")).over(ever))
    return df.withColumn("_v", v).withColumn("vwap_distance", ratio(F.col("close") - F.col("_v"), F.col("close"))).drop("_v")


def efficiency(df: DataFrame) -> DataFrame:
    """Kaufman's ratio over ten closes: 0.5 until there are ten, 1 where nothing moved."""
    df = df.withColumn("_d", F.abs(F.col("close") - previous(F.col("close"))))
    moved, net = F.sum("_d").over(last(9)), F.abs(F.col("close") - F.first(F.col("close")).over(last(10)))
    return df.withColumn("kama_er", F.when(full(10), ratio(net, moved, 1.0)).otherwise(0.5)).drop("_d")


def entropy(df: DataFrame) -> DataFrame:
    """Shannon entropy, in nats, of returns in five bins over thirty closes; 1 below five returns."""
    df = df.withColumn("_p", previous(F.col("close"))).withColumn("_r", F.when(F.col("_p").isNotNull(), ratio(F.col("close") - F.col("_p"), F.col("_p"))))
    bin_ = F.when(F.col("_r") < -0.005, 0).when(F.col("_r") < -0.001, 1).when(F.col("_r") < 0.001, 2).when(F.col("_r") < 0.005, 3).when(F.col("_r").isNotNull(), 4)
    df = df.withColumn("_bin", bin_)
    df = df.withColumns({"_n": F.count("_bin").over(last(29)), **{f"_c{i}": F.sum((F.col("_bin") == i).cast("int")).over(last(29)) for i in range(5)}})
    h = reduce(lambda a, b: a + b, (F.when(F.col(f"_c{i}") > 0, -(F.col(f"_c{i}") / F.col("_n")) * F.log(F.col(f"_c{i}") / F.col("_n"))).otherwise(0.0) for i in range(5)))
    return df.withColumn("entropy_rate", F.when(F.col("_n") >= 5, h).otherwise(1.0)).drop("_p", "_r", "_bin", "_n", *(f"_c{i}" for i in range(5)))


def aroon(df: DataFrame) -> DataFrame:
    """100 times the place of the last extreme among 25 rows, over 24; 50 until there are 25."""
    df = df.withColumns({"_h": F.collect_list(F.col("high")).over(last(25)), "_l": F.collect_list(F.col("low")).over(last(25))})
    place = lambda a, top: (25 - F.array_position(F.reverse(a), top(a))) / 24.0 * 100
    out = {name: F.when(F.size(a) == 25, place(a, top)).otherwise(50.0) for name, a, top in (("aroon_up", "_h", F.array_max), ("aroon_down", "_l", F.array_min))}
    return df.withColumns(out).drop("_h", "_l")


def price_action(df: DataFrame) -> DataFrame:
    return df.withColumns({"range_ratio": ratio(F.col("high"), F.col("low"), 1.0), "gap": F.coalesce(ratio(F.col("open") - previous(F.col("close")), previous(F.col("close"))), F.lit(0.0))})


def streaks(df: DataFrame) -> DataFrame:
    """Strict runs; a tie leaves both counts as they are. A run's count is the number of its moves since the last opposite one."""
    df = df.withColumn("_m", F.coalesce(F.signum(F.col("close") - previous(F.col("close"))), F.lit(0.0)))
    upto = _by().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_downs": F.sum((F.col("_m") < 0).cast("int")).over(upto), "_ups": F.sum((F.col("_m") > 0).cast("int")).over(upto)})
    inside = lambda g: Window.partitionBy("sym", g).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"consecutive_up": F.sum((F.col("_m") > 0).cast("int")).over(inside("_downs")), "consecutive_down": F.sum((F.col("_m") < 0).cast("int")).over(inside("_ups"))}).drop("_m", "_downs", "_ups")


def variance_ratio(df: DataFrame) -> DataFrame:
    """Variance of five-step log returns over five times that of one-step ones, over thirty closes; 1 below ten."""
    df = df.withColumn("_c", F.collect_list(F.col("close")).over(last(30)))
    logs = lambda step: F.transform(F.sequence(F.lit(1), F.size("_c") - step), lambda i: F.when((F.get("_c", i - 1) > 0) & (F.get("_c", i - 1 + step) > 0), F.log(F.when(F.get("_c", i - 1 + step) > 0, F.get("_c", i - 1 + step)) / F.when(F.get("_c", i - 1) > 0, F.get("_c", i - 1)))).otherwise(0.0))
    df = df.withColumns({"_one": F.when(F.size("_c") >= 10, logs(1)), "_five": F.when(F.size("_c") >= 10, logs(5))})
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    df = df.withColumns({"_m1": avg("_one"), "_m5": avg("_five")})
    var = lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - F.col(m)) * (x - F.col(m))) / F.size(a)
    return df.withColumn("variance_ratio", F.when(F.col("_one").isNull(), 1.0).otherwise(ratio(var("_five", "_m5"), 5 * var("_one", "_m1"), 1.0))).drop("_c", "_one", "_five", "_m1", "_m5")


def autocorrelation(df: DataFrame) -> DataFrame:
    """Lag-1 covariance of up to 48 closes over n - 1 pairs, by their population variance; 0 below three."""
    df = df.withColumns({"_c": F.collect_list(F.col("close")).over(last(48)), "_m": mean(F.col("close"), 48), "_v": F.var_pop(F.col("close")).over(last(48))})
    cov = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: (F.get("_c", i - 1) - F.col("_m")) * (F.get("_c", i) - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / (F.size("_c") - 1)
    return df.withColumn("autocorrelation", F.when(F.size("_c") >= 3, ratio(cov, F.col("_v"))).otherwise(0.0)).drop("_c", "_m", "_v")


def time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"minute": F.minute("ts").cast("double"), "hour": F.hour("ts").cast("double"), "day_of_week": ((F.dayofweek("ts") + 5) % 7).cast("double"), "day_of_month": F.dayofmonth("ts").cast("double"), "month_of_year": F.month("ts").cast("double")})


def batch_columns(df: DataFrame) -> DataFrame:
    """Columns of the batch builder: trend consistency, whole-window range position, look-ahead label."""
    rose = (F.col("close") > previous(F.col("close"))).cast("int")
    out = {f"trend_consistency_{n}": F.when(F.row_number().over(_by()) > n, F.sum("_rose").over(last(n)) / n).otherwise(0.5) for n in (6, 12, 24)}
    pos = ratio(F.col("close") - F.min(F.col("low")).over(last(12)), F.max(F.col("high")).over(last(12)) - F.min(F.col("low")).over(last(12)), 0.5)
    ahead = F.lead(F.col("close"), 10).over(_by())
    move = ratio(ahead - F.col("close"), F.col("close"))
    out |= {"range_position_12": F.when(full(12), pos).otherwise(0.5), "label": F.when(ahead.isNull(), "Noise").when(move > 0.005, "Buy").when(move < -0.005, "Sell").otherwise("Noise")}
    return df.withColumn("_rose", rose).withColumns(out).drop("_rose")


ALL = (sma, bollinger, stochastic, cci, mfi, obv, roc, range_position, timeframe, ichimoku, vwap, efficiency, entropy, aroon, price_action, streaks, variance_ratio, autocorrelation)


def enrich(df: DataFrame) -> DataFrame:
    """All windowed indicators."""
    return reduce(lambda d, f: f(d), ALL, df)
