"""Harmonic patterns, regime measures, predicates and chunks of long series against scalar versions."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlemill.operators import folds, patterns, predicates, series


def candles(spark, closes, wick=0.5, sym="s"):
    ts = pd.date_range("2024-01-01", periods=len(closes), freq="1h")
    pdf = pd.DataFrame({"sym": sym, "ts": ts, "open": closes, "high": np.asarray(closes, float) + wick, "low": np.asarray(closes, float) - wick, "close": np.asarray(closes, float), "volume": 1.0})
    return spark.createDataFrame(pdf, "sym string, ts timestamp, open double, high double, low double, close double, volume double").repartition(3)


def path(*turns, step=8):
    """Straight lines between turns."""
    out = [float(turns[0])]
    for a, b in zip(turns, turns[1:], strict=False):
        out += np.linspace(a, b, step + 1)[1:].tolist()
    return out


def brute_zigzag(high, low, radius):
    n, points = len(high), []
    for i in range(radius, n - radius):
        around = [j for j in range(i - radius, i + radius + 1) if j != i]
        if all(high[j] < high[i] for j in around):
            points.append((high[i], True))
        if all(low[j] > low[i] for j in around):
            points.append((low[i], False))
    line = []
    for price, up in points:
        if line and line[-1][1] == up:
            if (price > line[-1][0]) if up else (price < line[-1][0]):
                line[-1] = (price, up)
        else:
            line.append((price, up))
    return line


def brute_harmonics(high, low, close, window, radius=5, recent=3):
    out = []
    for t in range(29, len(close)):
        start = max(0, t - window + 1)
        if t - start + 1 < 30:
            continue
        line = brute_zigzag(high[start : t + 1], low[start : t + 1], radius)
        for back in range(min(recent, max(0, len(line) - 3))):
            four = line[len(line) - 4 - back : len(line) - back]
            x, a, b, c = (p for p, _ in four)
            d = close[t]
            if min(abs(a - x), abs(b - a), abs(c - b)) < 1e-10:
                continue
            r = [abs(b - a) / abs(a - x), abs(c - b) / abs(b - a), abs(d - c) / abs(b - a), abs(a - d) / abs(a - x)]
            for name, *limits in patterns.TEMPLATES:
                if all(lo <= v <= hi for v, (lo, hi) in zip(r, limits, strict=True)):
                    fit = [1 - min(1.0, abs(v - (lo + hi) / 2) / ((hi - lo) / 2)) for v, (lo, hi) in zip(r, limits, strict=True)]
                    out.append((t, back, name, not four[0][1], round(sum(fit) / 4, 9)))
                    break
    return out


def found(spark, closes, **how):
    rows = patterns.harmonics(candles(spark, closes), **how).collect()
    return sorted((int((r.ts - pd.Timestamp("2024-01-01")).total_seconds() // 3600), r.back, r.pattern, r.bullish, round(r.quality, 9)) for r in rows)


def test_harmonics_find_a_planted_gartley_and_nothing_in_other_ratios(spark):
    x, a, b, c, d = 100.5, 199.5, 138.7, 191.5, 121.9  # with wicks: 100, 200, 138.2, 192; the close nears 121.4
    got = found(spark, path(150, x, a, b, c, d, step=8))
    assert got and {g[2:4] for g in got} == {("gartley", True)}
    mirrored = found(spark, [300 - p for p in path(150, x, a, b, c, d, step=8)])
    assert mirrored and {g[2:4] for g in mirrored} == {("gartley", False)}
    assert found(spark, path(120, 100, 150, 140, 145, 130, step=8)) == []
    assert found(spark, []) == [] and found(spark, [1.0] * 60) == []


def test_harmonics_equal_a_scalar_walk_and_do_not_look_ahead(spark):
    g = random.Random(11)
    turns = [100.0]
    for k in range(60):
        turns.append(turns[-1] + (1 if k % 2 else -1) * g.uniform(4, 30))
    closes = path(*turns, step=7)
    want = brute_harmonics([p + 0.5 for p in closes], [p - 0.5 for p in closes], closes, 90)
    assert sorted(want) == found(spark, closes, window=90) and want
    cut = 250
    assert found(spark, closes[:cut], window=90) == [w for w in sorted(want) if w[0] < cut]


def test_chunks_of_a_series_change_nothing(spark):
    g = np.random.default_rng(4)
    closes = (100 + g.normal(size=700).cumsum() + 8 * np.sin(np.arange(700) / 7)).tolist()
    df = candles(spark, closes)
    numbered = series.numbered(df, slot=F.floor(F.unix_seconds("ts") / 86_400)).toPandas().sort_values("ts")
    assert numbered["i"].tolist() == list(range(700))
    plain = patterns.chunked
    for f in (lambda d: patterns.harmonics(d, window=90), patterns.regime_extras):
        whole = f(df).toPandas().sort_values(["sym", "ts"]).reset_index(drop=True)
        patterns.chunked = lambda d, g, before, after=0: plain(d, g, before, after, size=100)
        try:
            cut = f(df).toPandas().sort_values(["sym", "ts"]).reset_index(drop=True)
        finally:
            patterns.chunked = plain
        pd.testing.assert_frame_equal(whole, cut)


def test_a_long_series_is_folded_in_chunks(spark):
    g = np.random.default_rng(9)
    closes = (500 + g.normal(size=9000).cumsum()).tolist()
    df = candles(spark, closes, wick=1.5)
    columns = tuple(c for c in folds.COLUMNS if c not in ("hurst", "dfa_alpha", "fractal_dim", "rsi_divergence_bull", "rsi_divergence_bear"))
    want = folds.series(df.toPandas(), columns).reset_index(drop=True)
    got = folds.fold(df, columns, size=1000).toPandas().sort_values("ts").reset_index(drop=True)
    pd.testing.assert_frame_equal(got.drop(columns="squeeze"), want.drop(columns="squeeze"), rtol=1e-10, atol=1e-12)
    pd.testing.assert_series_equal(got["squeeze"], want["squeeze"], rtol=1e-8)  # a running deviation of pandas, itself inexact
    chunks = series.copies(series.numbered(df, total="n"), folds.WARM, 0, 1000, "n").groupBy("chunk").count().toPandas()
    assert chunks["count"].max() <= 1000 + folds.WARM and len(chunks) == 9  # no task has the series


def brute_regime(closes, high, low):
    n = len(closes)
    r = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
    var = sum(x * x for x in r) / len(r)
    five = [sum(r[i : i + 5]) for i in range(len(r) - 4)]
    td = 0
    for i in range(4, n):
        td = 0 if closes[i] == closes[i - 4] else (td + 1 if td > 0 else 1) if closes[i] > closes[i - 4] else (td - 1 if td < 0 else -1)
    hh, ll = high[-26:], low[-26:]
    place = lambda a, f: 100 * max(i for i, v in enumerate(a) if v == f(a)) / (len(a) - 1)
    kinds = [2 if x > 1e-4 else 0 if x < -1e-4 else 1 for x in r]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    ent = -sum(pairs.count(p) / len(pairs) * math.log(pairs.count(p) / sum(q[0] == p[0] for q in pairs)) for p in set(pairs)) / math.log(3) if len(r) >= 20 else None
    m = sorted(map(abs, r))
    marks = [m[len(m) * k // 5] for k in range(1, 5)]
    marks = [t for t in marks if t >= 1e-10]
    b = -np.polyfit([math.log(t) for t in marks], [math.log(sum(x >= t for x in m)) for t in marks], 1)[0] if len(r) >= 20 and len(marks) >= 3 else None
    steps = sum(math.sqrt((b - a) ** 2 + 1) for a, b in zip(closes, closes[1:], strict=False))
    far = max(abs(c - closes[0]) for c in closes)
    katz = min(2.0, max(1.0, math.log(n) / (math.log(n) + math.log(far / steps))))
    return sum(x * x for x in five) / len(five) / 5 / var, td, place(hh, max), place(ll, min), katz, ent, b


def test_regime_measures_equal_a_scalar_version(spark):
    g = np.random.default_rng(3)
    closes = np.exp(g.standard_t(3, size=150).cumsum() * 0.01 + 4)
    got = patterns.regime_extras(candles(spark, closes.tolist())).toPandas().sort_values("ts").reset_index(drop=True)
    assert len(got) == 131
    for t in range(19, 150):
        w = closes[max(0, t - 59) : t + 1].tolist()
        want = brute_regime(w, [c + 0.5 for c in w], [c - 0.5 for c in w])
        row = got.iloc[t - 19]
        for a, b in zip(want, (row.vr, row.td, row.up, row.down, row.katz, row.conditional_entropy, row.b_value), strict=True):
            assert (a is None and (b is None or math.isnan(b))) or abs(a - b) < 1e-9
    flat = patterns.regime_extras(candles(spark, [5.0] * 40)).toPandas()
    assert flat["vr"].isna().all() and flat["b_value"].isna().all() and (flat["td"] == 0).all()
    negative = patterns.regime_extras(candles(spark, [-1.0, 2.0] * 20)).toPandas()
    assert negative["conditional_entropy"].isna().all() and negative["katz"].notna().any()


def test_predicates_of_planted_moves(spark):
    closes = [10.0] * 30 + [10.0 + 0.4 * k for k in range(1, 40)] + [25.6 - 0.5 * k for k in range(1, 60)]
    rich = predicates.fields(candles(spark, closes))
    got = predicates.comparisons(rich, [("close", "sma20"), ("close", "prev-close"), ("upper-wick", "lower-wick")]).toPandas()
    hour = (got["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds() // 3600
    of = lambda p, a, b: sorted(hour[(got.predicate == p) & (got.a == a) & (got.b == b)].astype(int))
    sma = pd.Series(closes).rolling(20, min_periods=1).mean()
    assert of("crosses-below", "close", "sma20") == [i for i in range(1, len(closes)) if closes[i - 1] > sma[i - 1] and closes[i] <= sma[i]]
    assert of("above", "close", "prev-close") == [i for i in range(1, len(closes)) if closes[i] > closes[i - 1]]
    assert of("crosses-above", "close", "prev-close") == [] and of("touches", "close", "prev-close") == []
    assert set(of("touches", "upper-wick", "lower-wick")) == set(range(len(closes)))  # wicks agree
    back = predicates.since(rich, [("sma20", "sma50")], horizon=12).toPandas()
    assert (back.groupby(["predicate", "ts"]).size() == 1).all() and set(back["bars"]) == set(range(1, 13))
