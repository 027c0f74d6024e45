"""Rhythms of phases and as-of joins against scalar versions."""

import random

import numpy as np
import pandas as pd

from candlemill.operators import folds, phase_rhythm, series
from tests.test_patterns import candles

D = 10_000


def wave(n, seed=7):
    g = np.random.default_rng(seed)
    return (200 + 25 * np.sin(np.arange(n) / 9) + g.normal(size=n).cumsum() * 0.5).tolist()


def scalar_rhythm(rows, atoms, d, max_age=2016, budget=100):
    """rows: the records closed so far, in order; facts as they are defined, a record at a time."""
    now = rows[-1]["end_candle"]
    history = list(rows)
    while now - history[0]["start_candle"] > max_age:
        history = history[1:]
    if len(history) < 4:
        return atoms["phase-rhythm"] * atoms["phase-rhythm-empty"], len(history)
    rel = lambda a, b: (a - b) / abs(b) if abs(b) > 0.0001 else 0.0
    move = lambda r: (r["close_final"] - r["close_open"]) / r["close_open"] if r["close_open"] > 0 else 0.0
    span = lambda r: (r["close_max"] - r["close_min"]) / r["close_avg"] if r["close_avg"] > 0 else 0.0
    kind = lambda r: r["label"].lower() if r["label"] != "Transition" else {"Up": "transition-up", "Down": "transition-down", "None": "transition"}[r["direction"]]
    gauge = lambda v, lo, hi: np.where(np.arange(1, d + 1) <= np.floor(min(max((v - lo) / (hi - lo), 0), 1) * d + 0.5), 1, -1)
    bundles = []
    for i, r in enumerate(history):
        facts = [atoms["phase"].astype(int) * atoms[kind(r)]]
        put = lambda name, v, lo, hi: facts.append(atoms[name] * gauge(v, lo, hi))  # noqa: B023, E731
        put("rec-duration", r["duration"], 0, 200), put("rec-move", move(r), -0.1, 0.1), put("rec-range", span(r), 0, 0.1), put("rec-volume", r["volume_avg"], 0, 10000)
        if i:
            p = history[i - 1]
            put("prior-duration-delta", rel(r["duration"], p["duration"]), -2, 2), put("prior-move-delta", move(r) - move(p), -0.1, 0.1), put("prior-volume-delta", rel(r["volume_avg"], p["volume_avg"]), -2, 2)
        alike = [p for p in history[:i] if kind(p) == kind(r)]
        if alike:
            p = alike[-1]
            put("same-move-delta", move(r) - move(p), -0.1, 0.1), put("same-duration-delta", rel(r["duration"], p["duration"]), -2, 2), put("same-volume-delta", rel(r["volume_avg"], p["volume_avg"]), -2, 2)
        bundles.append(np.sign(sum(facts)))
    bundles = bundles[-(budget + 3) :]
    three = [a * np.roll(b, 1) * np.roll(c, 2) for a, b, c in zip(bundles, bundles[1:], bundles[2:], strict=False)]
    pairs = [a * b for a, b in zip(three, three[1:], strict=False)][-budget:]
    return np.sign(sum(pairs)) * atoms["phase-rhythm"], len(history)


def test_rhythms_equal_a_scalar_fold_at_full_width_and_forget(spark):
    df = candles(spark, wave(2700), wick=1.0)
    records = folds.phase_records(folds.fold(df, ("atr",)))
    rows = [r.asDict() for r in records.orderBy("start_candle").collect()]
    assert len(rows) > 150 and any(rows[-1]["end_candle"] - r["start_candle"] > 2016 for r in rows)
    atoms = phase_rhythm._atoms(records, D)
    got = {r.end_candle: (np.frombuffer(r.rhythm, np.int8), r.phases) for r in phase_rhythm.rhythms(records, D).collect()}
    for n in [1, 2, 3, 4, 5, 6, 50, 104, 105, len(rows) - 1, len(rows)]:
        want, phases = scalar_rhythm(rows[:n], atoms, D)
        vector, count = got[rows[n - 1]["end_candle"]]
        assert count == phases and (vector == want).all()


def test_no_later_phase_leaks_into_a_candle(spark):
    closes = wave(500, 3)
    whole, cut = (candles(spark, c, wick=1.0) for c in (closes, closes[:320]))

    def at(df):
        records = folds.phase_records(folds.fold(df, ("atr",)))
        return phase_rhythm.at_candles(df, phase_rhythm.rhythms(records, 256), ["phases", "rhythm"]).toPandas().sort_values("ts").reset_index(drop=True)

    a, b = at(whole), at(cut)
    pd.testing.assert_frame_equal(a.iloc[: len(b)], b)
    assert b["rhythm"].isna().any() and b["phases"].max() > 4 and b["rhythm"].nunique() > 4


def test_as_of_equals_a_scalar_search_over_chunks(spark):
    g = random.Random(1)
    rows = [(s, g.randrange(400)) for s in ("a", "b", None) for _ in range(120)]
    events = [(s, g.randrange(400), g.randrange(9)) for s in ("a", None, "c") for _ in range(9)] + [("a", 390, 1), ("a", 390, 7)]
    left = spark.createDataFrame(rows, "sym string, i long").repartition(3)
    right = spark.createDataFrame(events, "sym string, i long, v int").repartition(2)
    for size in (7, 1000):
        got = sorted((str(r.sym), r.i, r.v if r.v is not None else -1) for r in series.as_of(left, right, ["v"], size=size).collect())
        want = []
        for s, i in rows:
            past = [(j, v) for t, j, v in events if t == s and j <= i]
            want.append((str(s), i, max(past)[1] if past else -1))
        assert got == sorted(want)


def test_phase_means_reach_over_phases_of_any_length_and_forget(spark):
    """A phase of 6,000 candles: the mean holds to its end, where a span of rows would have run out."""
    rows = [("s", "Valley", 0, 10, 5.0), ("s", "Peak", 10, 6010, 9.0), ("s", "Valley", 6010, 6020, 2.0), ("s", "Peak", 6020, 6030, 4.0)]
    records = spark.createDataFrame(rows, "sym string, label string, start_candle long, end_candle long, close_avg double")
    means = {r.end_candle: r.phase_avg for r in phase_rhythm.means(records, size=500).collect()}
    assert means == {10: 5.0, 6010: None, 6020: 2.0, 6030: 3.0}  # a phase older than the memory at its own end leaves nothing
    live = spark.createDataFrame([("s", i) for i in (0, 10, 5900, 6009, 6010, 6025, 9000)], "sym string, at long")
    got = {r.at: r.phase_avg for r in series.as_of(live, phase_rhythm.means(records).withColumnRenamed("end_candle", "at"), ["phase_avg"], at="at", size=500).collect()}
    assert got == {0: None, 10: 5.0, 5900: 5.0, 6009: 5.0, 6010: None, 6025: 2.0, 9000: 3.0}
