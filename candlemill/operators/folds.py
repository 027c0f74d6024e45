"""Order-dependent recursions: one grouped pass over each series computes every one of them.

A row needs the previous row's output, so no window frame expresses these. A long series is cut into chunks of time, each
folded behind WARM rows that come before it. What a fold remembers shrinks by 13/14 a row at least, so WARM rows leave less
of a wrong start than a double can hold (1e-22), behind the 2016 rows of the longest window; the columns equal those of one pass to about
1e-14 of their size. (The one exception is held: after WARM rows without any movement ADX starts anew.)
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from candlemill.operators.series import CHUNK, copies, numbered

#: Rows folded ahead of a chunk: those of the longest window and as many as make a fold forget its start.
WARM = 2016 + 700
COLUMNS = ("ema20", "atr", "rsi", "macd_hist", "plus_di", "minus_di", "adx", "kelt_upper", "kelt_lower", "kelt_pos", "squeeze", "atr_ratio", "choppiness", "atr_median", "hurst", "dfa_alpha", "fractal_dim", "rsi_divergence_bull", "rsi_divergence_bear")


def seeded(x: np.ndarray, period: int, keep: float, add: float, skip: int = 0) -> np.ndarray:
    """0 until period inputs have come, then their mean, then keep * before + add * input; the first skip rows give no input."""
    out = np.zeros(len(x))
    value, seed, n = 0.0, 0.0, 0
    for i in range(skip, len(x)):
        n += 1
        if n < period:
            seed += x[i]
        elif n == period:
            value = (seed + x[i]) / period
        else:
            value = keep * value + add * x[i]
        out[i] = value
    return out


def ema(x: np.ndarray, period: int, skip: int = 0) -> np.ndarray:
    a = 2.0 / (period + 1)
    return seeded(x, period, 1.0 - a, a, skip)


def wilder(x: np.ndarray, period: int, skip: int = 0) -> np.ndarray:
    return seeded(x, period, (period - 1) / period, 1.0 / period, skip)


def divide(a: np.ndarray, b: np.ndarray, default: float = 0.0) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1.0), default)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    """100 while the mean loss is 0, so through warm-up."""
    d = np.diff(close, prepend=close[:1])
    gain, loss = wilder(np.maximum(d, 0.0), period, 1), wilder(np.maximum(-d, 0.0), period, 1)
    return np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + divide(gain, loss)))


def macd(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histogram, line and signal. The signal starts when both averages are ready; until then it is 0, and so is the line that is shown."""
    line = ema(close, 12) - ema(close, 26)
    signal = ema(line, 9, 25)
    return line - signal, np.where(np.arange(len(close)) >= 25, line, 0.0), signal


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = wilder(true_range(high, low, close), period, 1)
    p, m = (100.0 * divide(wilder(x, period, 1), tr) for x in (plus, minus))
    ready = (np.arange(len(close)) >= period) & (tr > 0) & (p + m > 0)
    dx = 100.0 * divide(np.abs(p - m), p + m)
    adx = np.zeros(len(close))
    adx[ready] = wilder(dx[ready], period)
    held = np.maximum.accumulate(np.where(ready, np.arange(len(close)), -1))  # where there is no new one the last one stays
    return p, m, np.where(held >= 0, adx[np.maximum(held, 0)], 0.0)


def hurst(c: np.ndarray) -> float:
    if len(c) < 8:
        return 0.5
    r = divide(np.diff(c), c[:-1])
    walk, s = np.cumsum(r - r.mean()), r.std()
    if s == 0 or walk.max() == walk.min():
        return 0.5
    return math.log((walk.max() - walk.min()) / s) / math.log(len(r))


def detrended(profile: np.ndarray, size: int) -> float:
    """Root mean square about the line of each whole segment."""
    k = len(profile) // size
    y = profile[: k * size].reshape(k, size)
    x = np.arange(size) - (size - 1) / 2
    rest = y - y.mean(axis=1, keepdims=True)
    rest = rest - (rest @ x / (x @ x))[:, None] * x
    return math.sqrt(float((rest**2).mean()))


def dfa_alpha(c: np.ndarray) -> float:
    if len(c) < 16:
        return 0.5
    profile = np.r_[0.0, np.cumsum(c - c.mean())]
    f4, f8 = detrended(profile, 4), detrended(profile, 8)
    return 0.5 if f4 <= 0 or f8 <= 0 else math.log(f8 / f4) / math.log(2.0)


def fractal_dim(c: np.ndarray) -> float:
    """Higuchi's curve lengths at steps 1 and 4, clamped to [1, 2]."""
    n = len(c)
    if n < 10:
        return 1.5

    def length(k: int) -> float:
        each = []
        for m in range(k):
            moves = np.abs(np.diff(c[m::k]))
            if len(moves):
                each.append(moves.sum() * (n - 1) / (len(moves) * k) / k)
        return float(np.mean(each))

    one, four = length(1), length(4)
    return 1.5 if one <= 0 or four <= 0 else min(2.0, max(1.0, math.log(one / four) / math.log(4.0)))


def divergence(price: np.ndarray, strength: np.ndarray) -> tuple[float, float]:
    """Bull: the later half makes a lower low in price but a higher one in strength; bear: the mirror image."""
    n = len(price)
    if n < 5:
        return 0.0, 0.0
    h = n // 2
    a, b = price[:h], price[h:]
    p, q = strength[:h], strength[h:]
    bull = abs((b.min() - a.min()) - (q.min() - p.min())) if b.min() < a.min() and q.min() > p.min() else 0.0
    bear = abs((b.max() - a.max()) - (q.max() - p.max())) if b.max() > a.max() and q.max() < p.max() else 0.0
    return bull, bear


def rolling(x: np.ndarray, n: int, f) -> np.ndarray:
    return np.array([f(x[max(0, i - n + 1) : i + 1]) for i in range(len(x))])


#: The lines behind macd_hist, for those who ask for them.
LINES = ("macd_line", "macd_signal")


def series(pdf: pd.DataFrame, columns: Sequence[str] = COLUMNS) -> pd.DataFrame:
    """Recursive columns of one series, in time order; the costly ones only where asked for."""
    pdf = pdf.sort_values("ts", kind="stable")
    h, l, c = (pdf[x].to_numpy(float) for x in ("high", "low", "close"))
    tr = true_range(h, l, c)
    e, a = ema(c, 20), wilder(tr, 14)
    out = {"ema20": e, "atr": a, "atr_ratio": divide(a, c)}
    if {"kelt_upper", "kelt_lower", "kelt_pos", "squeeze"} & {*columns}:
        upper, lower = e + 2 * a, e - 2 * a
        window = pdf["close"].rolling(20, min_periods=1)
        mean, spread = window.mean().to_numpy(), window.std(ddof=0).fillna(0.0).to_numpy()
        out |= {"kelt_upper": upper, "kelt_lower": lower, "kelt_pos": divide(c - lower, upper - lower, 0.5), "squeeze": divide(divide(4 * spread, mean), divide(upper - lower, c))}
    if {"rsi", "rsi_divergence_bull", "rsi_divergence_bear"} & {*columns}:
        out["rsi"] = rsi(c)
    if {"macd_hist", *LINES} & {*columns}:
        out |= dict(zip(("macd_hist", *LINES), macd(c), strict=True))
    if {"plus_di", "minus_di", "adx"} & {*columns}:
        out |= dict(zip(("plus_di", "minus_di", "adx"), directional(h, l, c), strict=True))
    if "choppiness" in columns:
        reach = pdf["high"].rolling(12, min_periods=1).max().to_numpy() - pdf["low"].rolling(12, min_periods=1).min().to_numpy()
        total = pd.Series(a).rolling(14, min_periods=1).sum().to_numpy()
        out["choppiness"] = np.where((np.arange(len(c)) >= 13) & (reach > 0) & (total > 0), 100.0 * np.log(np.where((reach > 0) & (total > 0), divide(total, reach), 1.0)) / math.log(14.0), 50.0)
    if "atr_median" in columns:
        out["atr_median"] = pd.Series(a).rolling(2016, min_periods=1).median().to_numpy()
    for name, n, f in (("hurst", 48, hurst), ("dfa_alpha", 48, dfa_alpha), ("fractal_dim", 30, fractal_dim)):
        if name in columns:
            out[name] = rolling(c, n, f)
    if {"rsi_divergence_bull", "rsi_divergence_bear"} & {*columns}:
        both = np.array([divergence(c[max(0, i - 19) : i + 1], out["rsi"][max(0, i - 19) : i + 1]) for i in range(len(c))]).reshape(-1, 2)
        out |= {"rsi_divergence_bull": both[:, 0], "rsi_divergence_bear": both[:, 1]}
    return pdf[[*CANDLE]].assign(**{name: out[name] for name in columns})


CANDLE = ("sym", "ts", "open", "high", "low", "close", "volume")


def fold(candles: DataFrame, columns: Sequence[str] = COLUMNS, size: int = CHUNK) -> DataFrame:
    """Candles with recursive columns; a series of more than size rows is folded in chunks."""

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.set_index("ts")["own"].sort_index(kind="stable").to_numpy()
        return series(pdf, columns)[own]

    schema = "sym string, ts timestamp, open double, high double, low double, close double, volume double, " + ", ".join(f"{c} double" for c in columns)
    return copies(numbered(candles.select(*CANDLE), total="n"), WARM, 0, size, "n").groupBy("sym", "chunk").applyInPandas(chunk, schema)


class Phases:
    """The zig-zag labeler's state: Rising or Falling about an extreme, and the open phase's statistics."""

    def __init__(self):
        self.rising, self.extreme, self.label, self.direction, self.generation = False, None, "Valley", "None", 0
        self.phase, self.start, self.closes, self.volumes = "Valley", 0, [], []

    def step(self, i: int, close: float, volume: float, smoothing: float) -> dict | None:
        """The record of the phase that ends here, if one does; its boundary row counts in both phases."""
        if self.extreme is None:
            self.extreme, self.start, self.closes, self.volumes = close, i, [close], [volume]
            return None
        self.closes.append(close)
        self.volumes.append(volume)
        sign = 1.0 if self.rising else -1.0
        self.extreme = max(self.extreme * sign, close * sign) * sign
        if (self.extreme - close) * sign > smoothing:
            self.rising, self.extreme, sign = not self.rising, close, -sign
        near = (self.extreme - close) * sign <= smoothing / 2
        was = self.direction
        self.label = ("Peak" if self.rising else "Valley") if near else "Transition"
        self.direction = "None" if near else "Up" if self.rising else "Down"
        if self.label == self.phase:
            return None
        c = self.closes
        done = {"label": self.phase, "direction": was, "start_candle": self.start, "end_candle": i, "duration": len(c), "close_min": min(c), "close_max": max(c), "close_avg": sum(c) / len(c), "close_open": c[0], "close_final": c[-1], "volume_avg": sum(self.volumes) / len(c)}
        self.phase, self.start, self.closes, self.volumes = self.label, i, [close], [volume]
        self.generation += 1
        return done


def label_phases(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candle: label, direction, count of the open phase, generation. pdf needs ts, close, volume and atr."""
    pdf = pdf.sort_values("ts", kind="stable")
    state, rows = Phases(), []
    for i, (c, v, a) in enumerate(zip(pdf["close"], pdf["volume"], pdf["atr"], strict=True)):
        state.step(i, c, v, 2.0 * a)
        rows.append((state.label, state.direction, len(state.closes), state.generation))
    labels = pd.DataFrame(rows, columns=["phase_label", "phase_direction", "phase_duration", "phase_generation"], index=pdf.index)
    return pdf[["sym", "ts", "close"]].join(labels)


def phases(folded: DataFrame) -> DataFrame:
    """folded: the output of fold."""
    return folded.select("sym", "ts", "close", "volume", "atr").groupBy("sym").applyInPandas(label_phases, "sym string, ts timestamp, close double, phase_label string, phase_direction string, phase_duration long, phase_generation long")


def phase_records(folded: DataFrame) -> DataFrame:
    """A row for each closed phase."""

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        state, out = Phases(), []
        for i, (c, v, a) in enumerate(zip(pdf["close"], pdf["volume"], pdf["atr"], strict=True)):
            if (done := state.step(i, c, v, 2.0 * a)) is not None:
                out.append({"sym": pdf["sym"].iloc[0]} | done)
        return pd.DataFrame(out, columns=["sym", "label", "direction", "start_candle", "end_candle", "duration", "close_min", "close_max", "close_avg", "close_open", "close_final", "volume_avg"])

    return folded.select("sym", "ts", "close", "volume", "atr").groupBy("sym").applyInPandas(close, "sym string, label string, direction string, start_candle long, end_candle long, duration long, close_min double, close_max double, close_avg double, close_open double, close_final double, volume_avg double")
