"""Structured Streaming twins: candles by watermark, recursions and the ledger with keyed state.

Inputs may come late up to the watermark; state per key is a few numbers, so it grows with the number of series alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlemill.operators.folds import Phases


def stream_candles(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly candles by event_type, each emitted once when the watermark passes its end."""
    w = F.window("ts", "1 hour")
    key = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).groupBy(F.col("event_type").alias("sym"), w.alias("w"))
        .agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


FOLD_STATE = "n long, close double, seed double, atr double, gain_seed double, gain double, loss_seed double, loss double, ema_seed double, ema double"
FOLD_OUT = "sym string, ts timestamp, close double, ema20 double, atr double, rsi double"


def _seeded(n: int, period: int, seed: float, value: float, x: float, keep: float, add: float) -> tuple[float, float]:
    """One step of the seeded recursion: (sum so far, value)."""
    if n < period:
        return seed + x, 0.0
    return (seed, (seed + x) / period) if n == period else (seed, keep * value + add * x)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last, s_atr, atr, s_gain, gain, s_loss, loss, s_ema, ema = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
        n += 1
        t = r.high - r.low if n == 1 else max(r.high - r.low, abs(r.high - last), abs(r.low - last))
        s_atr, atr = _seeded(n, 14, s_atr, atr, t, 13 / 14, 1 / 14)
        s_ema, ema = _seeded(n, 20, s_ema, ema, r.close, 19 / 21, 2 / 21)
        if n > 1:
            s_gain, gain = _seeded(n - 1, 14, s_gain, gain, max(r.close - last, 0.0), 13 / 14, 1 / 14)
            s_loss, loss = _seeded(n - 1, 14, s_loss, loss, max(last - r.close, 0.0), 13 / 14, 1 / 14)
        last = r.close
        yield pd.DataFrame([(key[0], r.ts, r.close, ema, atr, 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss))], columns=["sym", "ts", "close", "ema20", "atr", "rsi"])
    state.update((n, last, s_atr, atr, s_gain, gain, s_loss, loss, s_ema, ema))


def stream_folds(candles: DataFrame) -> DataFrame:
    """ema20, atr and rsi of each candle as it comes; a micro-batch is put in time order before it is folded."""
    return candles.groupBy("sym").applyInPandasWithState(_fold, FOLD_OUT, FOLD_STATE, "append", GroupStateTimeout.NoTimeout)


PAPER_STATE = "papers array<struct<paper_id: long, entry_candle: long, entry_price: double>>, issued long"
PAPER_OUT = "owner long, paper_id long, resolved_at long, state string, residue double"


def stream_ledger(requests: DataFrame, horizon: int = 288, fee_bps: float = 35.0, notional: float = 10_000.0) -> DataFrame:
    """requests (owner, event_id, candle, price, kind): outcomes as papers end, by the rules of the batch ledger."""

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        papers, issued = ([tuple(p) for p in state.get[0]], state.get[1]) if state.exists else ([], 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["candle", "event_id"], kind="stable").itertuples():
            for p in [p for p in papers if r.candle >= p[1] + horizon]:
                papers.remove(p)
                out.append((key[0], p[0], r.candle, "Violence", None))
            if r.kind == "Submit":
                issued += 1
                papers.append((issued, r.candle, r.price))
            elif r.kind == "Exit":
                for p in papers:
                    gain = (notional * (1 - fee_bps / 1e4) / p[2] if p[2] > 0 else 0.0) * r.price * (1 - fee_bps / 1e4) - notional
                    if gain > 0:
                        papers.remove(p)
                        out.append((key[0], p[0], r.candle, "Grace", gain))
                        break
        state.update((papers, issued))
        yield pd.DataFrame(out, columns=["owner", "paper_id", "resolved_at", "state", "residue"]).astype({"residue": "float64"})

    return requests.groupBy("owner").applyInPandasWithState(settle, PAPER_OUT, PAPER_STATE, "append", GroupStateTimeout.NoTimeout)


def run_phases(closes: list[tuple[float, float, float]]) -> list[str]:
    """Labels for (close, volume, atr) in order: the state machine that a keyed stream carries."""
    state, out = Phases(), []
    for i, (c, v, a) in enumerate(closes):
        state.step(i, c, v, 2.0 * a)
        out.append(state.label)
    return out
