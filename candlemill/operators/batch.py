"""Columns and facts of the batch builder: whole-window frames, look-back over all steps, and divergences of segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.scalars import clamp
from candlemill.operators.indicators import full, last, previous
from candlemill.operators.learning import pelt


def change(c: Column, n: int) -> Column:
    """Against n rows before; 0 while there are none, or where that is 0."""
    before = previous(c, n)
    return F.coalesce(F.when(before != 0, (c - before) / F.when(before != 0, before)), F.lit(0.0))


def timeframe_columns(df: DataFrame) -> DataFrame:
    """High, low, return and body of the last 12 and 48 rows: the body is measured from the first row's open. Until a window is
    full high and low are the row's own and the body is 0."""
    out = {}
    for name, n in (("1h", 12), ("4h", 48)):
        hi, lo = F.max(F.col("high")).over(last(n)), F.min(F.col("low")).over(last(n))
        body = F.abs(F.col("close") - F.first(F.col("open")).over(last(n))) / F.when(hi - lo > 1e-10, hi - lo)
        out |= {f"tf_{name}_high": F.when(full(n), hi).otherwise(F.col("high")), f"tf_{name}_low": F.when(full(n), lo).otherwise(F.col("low")), f"tf_{name}_ret": change(F.col("close"), n), f"tf_{name}_body": F.when(full(n), F.coalesce(body, F.lit(0.0))).otherwise(0.0)}
    return df.withColumns(out)


def atr_changes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"atr_roc_{n}": change(F.col("atr"), n) for n in (6, 12)})


def exit_facts(df: DataFrame) -> DataFrame:
    """(sym, ts, module, name, kind, value, scale, zone) from atr_ratio, atr_roc_6, atr_roc_12, squeeze, trend_consistency_*, adx, rsi, macd_hist,
    stoch_k and cci. Scalars have a value and a scale, zones and bare facts a name only."""
    steady = (F.col("trend_consistency_6") + F.col("trend_consistency_12") + F.col("trend_consistency_24")) / 3
    half = lambda c: clamp(F.col(c), -1.0, 1.0) * 0.5 + 0.5
    unit = lambda c: clamp(c, 0.0, 1.0)
    a6 = F.col("atr_roc_6")
    volatility = F.when(a6 > 0.3, "vol-expanding-fast").when(a6 > 0.1, "vol-expanding").when(a6 < -0.2, "vol-contracting-fast").when(a6 < -0.05, "vol-contracting").otherwise("vol-stable")
    structure = F.when((F.col("adx") > 40) & (steady > 0.6), "structure-strong").when((F.col("adx") > 25) & (steady > 0.5), "structure-moderate").when(F.col("adx") < 15, "structure-absent").otherwise("structure-weak")
    timing = F.when((F.col("rsi") > 70) & (F.col("stoch_k") > 80), "timing-overbought").when((F.col("rsi") < 30) & (F.col("stoch_k") < 20), "timing-oversold").otherwise("timing-neutral")
    scalars = [
        ("volatility", "atr-regime", F.greatest(F.col("atr_ratio"), F.lit(1e-10)), 0.1), ("volatility", "atr-ratio", F.greatest(1 + a6, F.lit(0.01)), 2.0), ("volatility", "atr-accel-6", half("atr_roc_6"), 1.0), ("volatility", "atr-accel-12", half("atr_roc_12"), 1.0),
        *(("structure", f"exit-trend-consistency-{n}", unit(F.col(f"trend_consistency_{n}")), 1.0) for n in (6, 12, 24)), ("structure", "exit-adx-strength", F.greatest(F.col("adx"), F.lit(1.0)), 100.0), ("structure", "exit-structure-quality", unit(steady), 1.0),
        ("timing", "exit-momentum-rsi", unit(F.col("rsi") / 100), 1.0), ("timing", "exit-momentum-macd", clamp(F.col("macd_hist"), -500.0, 500.0) / 500 * 0.5 + 0.5, 1.0), ("timing", "exit-stoch-k", unit(F.col("stoch_k") / 100), 1.0), ("timing", "exit-cci-magnitude", F.greatest(F.abs(F.col("cci")), F.lit(1.0)), 300.0),
    ]
    zones = [("volatility", "vol-regime", "zone", volatility), ("volatility", "squeeze-state", "bare", F.when(F.col("squeeze") < 1, "squeeze-active").otherwise("squeeze-off")), ("structure", "exit-structure", "zone", structure), ("timing", "exit-timing", "zone", timing)]
    none = F.lit(None)
    row = lambda m, n, k, v, s, z: F.struct(F.lit(m).alias("module"), F.lit(n).alias("name"), F.lit(k).alias("kind"), v.cast("double").alias("value"), s.cast("double").alias("scale"), z.cast("string").alias("zone"))
    rows = [row(m, n, "scalar", v, F.lit(s), none) for m, n, v, s in scalars] + [row(m, n, k, none, none, z) for m, n, k, z in zones]
    return df.select("sym", "ts", F.explode(F.array(*rows)).alias("f")).select("sym", "ts", "f.*")


def dual_distances(entries: DataFrame, steps: int = 20, most: float = 0.1) -> DataFrame:
    """entries (id, entry, path: later closes): for buying and for selling the trailing distance, of steps up to most, with the largest
    residue, ties to the smaller. A close first moves the trail and then meets it."""
    tried = entries.where("size(path) > 0 and entry > 0").withColumn("d", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i * most / steps)))

    def residue(sign: int) -> Column:
        far = F.greatest if sign > 0 else F.least
        start = F.struct(F.col("entry").alias("far"), F.col("entry").alias("exit"), F.lit(False).alias("done"))

        def walk(s, x):
            top = far(s["far"], x)
            level = top * (1 - sign * F.col("d"))
            return F.when(s["done"], s).otherwise(F.struct(top.alias("far"), x.alias("exit"), (x <= level if sign > 0 else x >= level).alias("done")))

        return sign * (F.aggregate("path", start, walk)["exit"] - F.col("entry")) / F.col("entry")

    each = tried.select("id", "d", residue(1).alias("buy"), residue(-1).alias("sell"))
    return each.groupBy("id").agg(*(a for k in ("buy", "sell") for a in (F.max_by("d", F.struct(k, -F.col("d"))).alias(f"{k}_distance"), F.max(k).alias(f"{k}_residue"))))


def segment_divergences(df: DataFrame, horizon: int = 240) -> DataFrame:
    """df (sym, ts, close, rsi), closes above 0: in each window of horizon rows the segments of log closes; where two peaks (segments
    that rise, then fall) in a row rise in price and fall in rsi: bearish; troughs, the mirror image: bullish."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        c, r = pdf["close"].to_numpy(float), pdf["rsi"].to_numpy(float)
        out = []
        if len(c) >= 10 and (c > 0).all():
            logs = np.log(c)
            cuts = [0, *pelt(logs), len(c)]
            ways = [int(np.sign(m) * (abs(m) > 1e-10)) for m in (logs[b - 1] - logs[a] for a, b in zip(cuts, cuts[1:], strict=False))]
            for kind, way in (("bearish", 1), ("bullish", -1)):
                turns = [cuts[i + 1] - 1 for i in range(len(ways) - 1) if (ways[i], ways[i + 1]) == (way, -way)] if len(ways) >= 3 else []
                out += [(kind, b, len(c) - 1 - b) for a, b in zip(turns, turns[1:], strict=False) if way * (c[b] - c[a]) > 0 and way * (r[b] - r[a]) < 0]
        f = pd.DataFrame(out, columns=["kind", "at", "candles_ago"])
        return f.assign(sym=pdf["sym"].iloc[0], win=pdf["win"].iloc[0])[["sym", "win", "kind", "at", "candles_ago"]]

    at = F.row_number().over(Window.partitionBy("sym").orderBy("ts")) - 1
    w = df.withColumn("at", at).withColumn("win", F.floor(F.col("at") / horizon)).select("sym", "win", "at", "close", "rsi")
    return w.groupBy("sym", "win").applyInPandas(run, "sym string, win long, kind string, at long, candles_ago long")
