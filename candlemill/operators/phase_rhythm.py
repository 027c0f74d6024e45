"""The rhythm of phases: each closed phase as a vector of facts about itself, the phase before and the last one of its kind;
three neighbours bound to a trigram, two trigrams to a pair, the last pairs bundled. A candle reads the rhythm of what had
closed by then."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.functions import vectors as V
from candlemill.operators.series import CHUNK, as_of, copies, numbered

#: Candles after which a phase leaves the history, pairs in a rhythm, phases that it needs at least.
MAX_AGE, BUDGET, LEAST = 2016, 100, 4
#: The facts of a phase in order, with the bounds of their thermometers.
FACTS: list[tuple[str, float, float]] = [
    ("rec-duration", 0.0, 200.0), ("rec-move", -0.1, 0.1), ("rec-range", 0.0, 0.1), ("rec-volume", 0.0, 10000.0),
    ("prior-duration-delta", -2.0, 2.0), ("prior-move-delta", -0.1, 0.1), ("prior-volume-delta", -2.0, 2.0),
    ("same-move-delta", -0.1, 0.1), ("same-duration-delta", -2.0, 2.0), ("same-volume-delta", -2.0, 2.0),
]
NAMES = [name.replace("-", "_") for name, _, _ in FACTS]
LABELS = ("valley", "peak", "transition-up", "transition-down", "transition")


def _relative(a: Column, b: Column) -> Column:
    """The change from b to a by b's size, 0 where b is next to nothing."""
    size = F.abs(b)
    return F.when(size > 0.0001, (a - b) / F.when(size > 0.0001, size)).when(b.isNotNull(), 0.0)


def histories(records: DataFrame, max_age: int = MAX_AGE, size: int = CHUNK) -> DataFrame:
    """sym, end_candle and, as of each closed phase, history: of the phases in memory (those that began at most max_age candles
    before it closed) their kind and facts, oldest first. A fact about a phase that is out of memory is null.

    records: of folds.phase_records. A phase's memory reaches max_age candles back, so chunks of candles with as many before
    them hold all that their phases remember; no task needs a whole series.
    """
    kind = F.when(F.col("label") != "Transition", F.lower("label")).when(F.col("direction") == "Up", "transition-up").when(F.col("direction") == "Down", "transition-down").otherwise("transition")
    own = records.select(
        "sym", "start_candle", "end_candle", F.col("start_candle").alias("i"), kind.alias("kind"), F.col("duration").cast("double").alias("duration"),
        F.when(F.col("close_open") > 0, (F.col("close_final") - F.col("close_open")) / F.when(F.col("close_open") > 0, F.col("close_open"))).otherwise(0.0).alias("move"),
        F.when(F.col("close_avg") > 0, (F.col("close_max") - F.col("close_min")) / F.when(F.col("close_avg") > 0, F.col("close_avg"))).otherwise(0.0).alias("range"), F.col("volume_avg").alias("volume"),
    )
    df = copies(own, max_age, 0, size)
    before, alike = Window.partitionBy("sym", "chunk").orderBy("start_candle"), Window.partitionBy("sym", "chunk", "kind").orderBy("start_candle")
    lagged = {f"_{n}_{c}": F.lag(c).over(w) for n, w in (("p", before), ("s", alike)) for c in ("start_candle", "duration", "move", "volume")}
    df = df.withColumns(lagged)
    c = F.col
    values = [
        c("duration"), c("move"), c("range"), c("volume"),
        _relative(c("duration"), c("_p_duration")), c("move") - c("_p_move"), _relative(c("volume"), c("_p_volume")),
        c("move") - c("_s_move"), _relative(c("duration"), c("_s_duration")), _relative(c("volume"), c("_s_volume")),
    ]
    entry = F.struct(c("start_candle"), c("kind"), c("_p_start_candle").alias("prior"), c("_s_start_candle").alias("same"), *(v.alias(n) for v, n in zip(values, NAMES, strict=True)))
    df = df.withColumn("_all", F.collect_list(entry).over(before.rangeBetween(-max_age, 0))).where("own").withColumn("_cut", F.col("end_candle") - max_age)
    known = lambda r, n: F.when(F.lit(True) if n.startswith("rec") else r["prior" if n.startswith("prior") else "same"] >= F.col("_cut"), r[n])
    kept = F.transform(F.filter("_all", lambda r: r["start_candle"] >= F.col("_cut")), lambda r: F.struct(r["kind"].alias("kind"), *(known(r, n).alias(n) for n in NAMES)))
    return df.select("sym", "end_candle", kept.alias("history"))


def means(records: DataFrame, max_age: int = MAX_AGE, size: int = CHUNK) -> DataFrame:
    """sym, end_candle, phase_avg: as of each closed phase, the mean of close_avg over the phases in memory."""
    df = copies(records.select("sym", "start_candle", "end_candle", "close_avg", F.col("start_candle").alias("i")), max_age, 0, size)
    near = Window.partitionBy("sym", "chunk").orderBy("start_candle").rangeBetween(-max_age, 0)
    df = df.withColumn("_all", F.collect_list(F.struct("start_candle", "close_avg")).over(near)).where("own")
    kept = F.filter("_all", lambda r: r["start_candle"] >= F.col("end_candle") - max_age)
    return df.select("sym", "end_candle", F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, r: s + r["close_avg"]) / F.nullif(F.size(kept), F.lit(0))).alias("phase_avg"))


def _atoms(df: DataFrame, d: int) -> dict[str, np.ndarray]:
    """The atoms of all names, one row of them."""
    names = ["phase", "phase-rhythm", "phase-rhythm-empty", *LABELS, *(n for n, _, _ in FACTS)]
    row = df.sparkSession.range(1).select(*(V.atom(F.lit(n), d).alias(n) for n in names)).first()
    return {n: np.array(row[n], dtype=np.int8) for n in names}


def bundle(kind: str, facts: np.ndarray, atoms: dict[str, np.ndarray]) -> np.ndarray:
    """One phase's facts, NaN where there is none, as a vector."""
    d = len(atoms["phase"])
    total = (atoms["phase"] * atoms[kind]).astype(np.int16)
    for value, (name, lo, hi) in zip(facts, FACTS, strict=True):
        if not np.isnan(value):
            filled = int(np.floor(min(max((value - lo) / (hi - lo), 0.0), 1.0) * d + 0.5))
            total[:filled] += atoms[name][:filled]
            total[filled:] -= atoms[name][filled:]
    return np.sign(total).astype(np.int8)


def encode(bundles: np.ndarray, atoms: dict[str, np.ndarray], budget: int = BUDGET) -> np.ndarray:
    """The rhythm of a history's bundles; below LEAST phases the sentinel under the rhythm's name."""
    if len(bundles) < LEAST:
        return atoms["phase-rhythm"] * atoms["phase-rhythm-empty"]
    last = bundles[-(budget + 3) :]
    three = last[:-2] * np.roll(last[1:-1], 1, axis=1) * np.roll(last[2:], 2, axis=1)
    return (np.sign((three[:-1] * three[1:])[-budget:].sum(axis=0, dtype=np.int32)) * atoms["phase-rhythm"]).astype(np.int8)


def rhythms(records: DataFrame, d: int = 10_000, budget: int = BUDGET) -> DataFrame:
    """sym, end_candle, phases (in memory) and rhythm (signs as bytes) as of each closed phase."""
    atoms = _atoms(records, d)

    @pandas_udf("binary")
    def vector(kinds: pd.Series, facts: pd.Series) -> pd.Series:
        known: dict[tuple[str, bytes], np.ndarray] = {}  # neighbouring histories share all but a phase
        out = []
        for kind, rows in zip(kinds, facts, strict=True):
            own = []
            for k, row in zip(kind, rows, strict=True):
                row = np.asarray(row, dtype=float)
                if (key := (k, row.tobytes())) not in known:
                    if len(known) > 2048:
                        known.clear()
                    known[key] = bundle(k, row, atoms)
                own.append(known[key])
            out.append(encode(np.array(own, dtype=np.int8), atoms, budget).tobytes())
        return pd.Series(out)

    h = histories(records)
    last = F.slice("history", F.greatest(F.lit(1), F.size("history") - (budget + 2)), budget + 3)
    h = h.withColumn("_last", last)
    numbers = F.transform("_last", lambda r: F.array(*(F.coalesce(r[n], F.lit(float("nan"))) for n in NAMES)))
    return h.select("sym", "end_candle", F.size("history").alias("phases"), vector(F.transform("_last", lambda r: r["kind"]), numbers).alias("rhythm"))


def at_candles(candles: DataFrame, of_records: DataFrame, values: list[str]) -> DataFrame:
    """sym, ts and the values of the last phase that had closed by each candle; null before the first."""
    rows = numbered(candles.select("sym", "ts"))
    events = of_records.select("sym", F.col("end_candle").alias("i"), *values)
    return as_of(rows, events, values).drop("i")
