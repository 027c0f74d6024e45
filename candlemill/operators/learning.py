"""Learners and statistics: sizing, curves, gates, change points, prototypes, subspaces, weighted stops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.operators.series import numbered

#: Fixed values of sizing: bins of a curve, the least accuracy that enters it, resolved predictions before a curve or a band counts.
BINS, LEAST_ACCURACY, LEAST_POINTS, LEAST_RESOLVED = 20, 0.505, 3, 500
BAND_FROM, BAND_TO, BAND_WIDTH, BAND_ROWS, BAND_ACCURACY = 3, 18, 4, 200, 0.51


def by_conviction(resolved: DataFrame) -> DataFrame:
    """resolved with _i, a row's place in its sym by conviction and id, and _n, the rows of the sym; counted in slots of conviction."""
    slot = F.floor(F.col("conviction") * 4096)
    return numbered(resolved.withColumn("_o", F.struct("conviction", "id")), key="sym", order="_o", out="_i", total="_n", slot=slot).drop("_o")


def conviction_bins(resolved: DataFrame, least: int = 10) -> DataFrame:
    """resolved (sym, id, conviction, correct): twenty bins of equal size by conviction, the last with the remainder; none where
    they would be smaller than least."""
    r = by_conviction(resolved)
    size = F.floor(F.col("_n") / BINS)
    r = r.where(size >= least).withColumn("bin", F.least(F.floor(F.col("_i") / size), F.lit(BINS - 1)).cast("int"))
    return r.groupBy("sym", "bin").agg(F.count("*").alias("n"), F.avg("conviction").alias("x"), F.avg(F.col("correct").cast("int")).alias("acc"))


def curve_fit(bins: DataFrame) -> DataFrame:
    """Least squares of ln(acc - 0.5) on x over the bins above LEAST_ACCURACY, three at least: acc = 0.5 + a exp(b x)."""
    usable = bins.where(F.col("acc") > LEAST_ACCURACY).withColumn("y", F.log(F.col("acc") - 0.5))
    g = usable.groupBy("sym").agg(F.regr_intercept("y", "x").alias("c"), F.regr_slope("y", "x").alias("b"), F.count("*").alias("bins"), F.var_pop("x").alias("v"))
    flat = F.col("v") * F.col("bins") * F.col("bins") > 1e-10
    return g.where((F.col("bins") >= LEAST_POINTS) & flat).select("sym", F.exp("c").alias("a"), "b", "bins")


def win_rate(conviction: Column, a: Column, b: Column) -> Column:
    return F.least(0.5 + a * F.exp(b * conviction), F.lit(0.95))


def half_kelly(rate: Column, move_threshold: Column | float) -> Column:
    """Half the edge over the move threshold; null without an edge."""
    edge = 2 * rate - 1
    return F.when(edge > 0, edge / 2 / move_threshold)


def conviction_threshold(a: Column, b: Column, least_edge: float) -> Column:
    """Where the curve reaches least_edge, if that lies between 0 and 1."""
    x = F.log((F.lit(least_edge) - 0.5) / a) / F.when(b > 0, b)
    return F.when((x > 0) & (x < 1), x)


def quantile_threshold(resolved: DataFrame, q: float) -> DataFrame:
    """sym, threshold: the conviction at place q n, cut to a whole number."""
    place = F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)
    return by_conviction(resolved).where(F.col("_i") == place).select("sym", F.col("conviction").alias("threshold"))


def signal_weight(df: DataFrame, move: str) -> DataFrame:
    """weight: a move's size over the mean size so far."""
    upto = Window.partitionBy("sym").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("weight", F.abs(F.col(move)) / F.when(F.avg(F.abs(F.col(move))).over(upto) > 0, F.avg(F.abs(F.col(move))).over(upto)))


def proven_band(resolved: DataFrame, dims: int) -> DataFrame:
    """resolved (sym, conviction, correct): per sym the band [k, k + 4) of sigmas, 1 / sqrt(dims) each, with the best accuracy among
    those of 200 rows and more; the first of equal ones; only above 0.51. A row's bands follow from its value: the range
    join is an explode."""
    sigma = 1.0 / math.sqrt(dims)
    at = F.floor(F.col("conviction") / sigma).cast("int")
    near = F.sequence(F.greatest(F.lit(BAND_FROM), at - BAND_WIDTH - 1), F.greatest(F.least(F.lit(BAND_TO - 1), at + 1), F.greatest(F.lit(BAND_FROM), at - BAND_WIDTH - 1)))
    many = resolved.groupBy("sym").agg(F.count("*").alias("_many")).where(F.col("_many") >= LEAST_RESOLVED).select("sym")
    rows = resolved.withColumn("k", F.explode(near))
    rows = rows.where((F.col("k") < BAND_TO) & (F.col("conviction") >= F.col("k") * F.lit(sigma)) & (F.col("conviction") < (F.col("k") + BAND_WIDTH) * F.lit(sigma)))
    bands = rows.groupBy("sym", "k").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("acc")).where(F.col("n") >= BAND_ROWS)
    best = bands.join(many, "sym", "left_semi").groupBy("sym").agg(F.max_by(F.struct("k", "n", "acc"), F.struct("acc", -F.col("k"))).alias("s"))
    return best.select("sym", (F.col("s.k") * F.lit(sigma)).alias("low"), ((F.col("s.k") + BAND_WIDTH) * F.lit(sigma)).alias("high"), F.col("s.n").alias("n"), F.col("s.acc").alias("accuracy")).where(F.col("accuracy") > BAND_ACCURACY)


def broker_gate(graces: Column, violences: Column, expected: Column, cold: int = 50) -> Column:
    """Open while either count is cold, then while the expected value is above one half."""
    return (graces < cold) | (violences < cold) | (expected > 0.5)


def engram_gate(df: DataFrame, by: str, epoch: str, correct: str, least: float = 0.55) -> DataFrame:
    """Counters start anew with every epoch of a learner (by): its accuracy, whether it is good enough for a snapshot, and the
    snapshots taken so far."""
    g = df.groupBy(by, epoch).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy")).withColumn("snapshot", F.col("accuracy") >= least)
    return g.withColumn("snapshots", F.sum(F.col("snapshot").cast("int")).over(Window.partitionBy(by).orderBy(epoch)))


def grade_predictions(df: DataFrame, horizon: int) -> DataFrame:
    """(sym, ts, close, guess Up / Down): right or wrong by the close horizon rows later; a flat move stays open."""
    later = F.lead("close", horizon).over(Window.partitionBy("sym").orderBy("ts"))
    move = F.signum(later - F.col("close"))
    return df.withColumn("grade", F.when(move == 0, "open").when(move.isNull(), "open").when((move > 0) == (F.col("guess") == "Up"), "right").otherwise("wrong"))


def window_size(n: Column, low: int = 12, high: int = 2016) -> Column:
    """A deterministic log-uniform window length for a counter."""
    u = (F.shiftrightunsigned(F.xxhash64(n), 11).cast("double")) / float(1 << 53)
    return F.floor(F.lit(float(low)) * F.pow(F.lit(high / low), u) + 0.5).cast("int")


def learned_stop(memories: DataFrame, similarity: Column, default: float = 0.015, most: int = 1000) -> DataFrame:
    """memories (query, i, distance, weight) and the likeness of each to its query: the mean distance by likeness and weight, which
    counts 0.01 at least, over the last most memories; what isn't similar counts nothing, and without any the default holds."""
    m = memories.withColumn("_s", similarity)
    m = m.withColumn("_back", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("i")))).where(F.col("_back") <= most)
    w = F.when(F.col("_s") > 0, F.col("_s") * F.greatest(F.col("weight"), F.lit(0.01)))
    g = m.groupBy("query").agg(F.sum(w * F.col("distance")).alias("d"), F.sum(w).alias("w"), F.count(w).alias("used"))
    return g.select("query", F.when(F.col("w") >= 1e-10, F.col("d") / F.when(F.col("w") >= 1e-10, F.col("w"))).otherwise(F.lit(default)).alias("distance"), "used")


def prototypes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Sum vector of each class: positions are summed by a grouped aggregate."""
    sums = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("prototype"), F.max("n").alias("experience"))


def reckon(df: DataFrame, protos: DataFrame, vector: str, similarity) -> DataFrame:
    """Class of the most similar prototype, and the margin to the next one. protos (label, prototype): a row a class, which all
    rows are joined with as one array."""
    one = protos.agg(F.array_sort(F.collect_list(F.struct("label", "prototype"))).alias("_p"))
    scored = F.array_sort(F.transform("_p", lambda p: F.struct((-similarity(F.col(vector), p["prototype"])).alias("s"), p["label"].alias("label"))))
    top = df.crossJoin(F.broadcast(one)).withColumn("_s", scored).where(F.size("_s") > 0)
    return top.withColumns({"guess": F.col("_s")[0]["label"], "cosine": -F.col("_s")[0]["s"], "margin": F.get("_s", F.lit(1))["s"] - F.col("_s")[0]["s"]}).drop("_s", "_p")


def anomaly(df: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """df with residual: how far each vector lies from its class's mean and k leading directions.

    Every task sends one matrix of moments a class; they are added up a class, whose directions its rows are joined with.
    """
    parts = f"{key} string, n long, s binary, p binary"

    def moments(batches):
        sums: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            x = np.array(b.column(1).to_pylist(), float)
            for name in set(keys):
                own = x[[i for i, v in enumerate(keys) if v == name]]
                n, s, p = sums.get(name, (0, 0.0, 0.0))
                sums[name] = n + len(own), s + own.sum(axis=0), p + own.T @ own
        for name, (n, s, p) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], [key, "n", "s", "p"])

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, p = pdf["n"].sum(), sum(np.frombuffer(x) for x in pdf["s"]), sum(np.frombuffer(x) for x in pdf["p"])
        mean = s / n
        _, vectors = np.linalg.eigh(p.reshape(len(s), len(s)) / n - np.outer(mean, mean))
        return pd.DataFrame([{key: pdf[key].iloc[0], "mean": mean.tolist(), "axes": vectors[:, ::-1][:, :k].T.ravel().tolist()}])

    each = df.select(F.col(key).cast("string").alias(key), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(moments, parts)
    spaces = each.groupBy(key).applyInPandas(directions, f"{key} string, mean array<double>, axes array<double>").withColumnRenamed(key, "_key")

    @pandas_udf("double")
    def residual(v: pd.Series, mean: pd.Series, axes: pd.Series) -> pd.Series:
        x = np.array(v.to_list(), float) - np.array(mean.to_list(), float)
        a = np.array(axes.to_list(), float).reshape(len(x), -1, x.shape[1])
        along = np.einsum("nkd,nd->nk", a, x)
        return pd.Series(np.sqrt(np.maximum((x * x).sum(axis=1) - (along * along).sum(axis=1), 0.0)))

    return df.join(spaces, F.col(key).cast("string") == F.col("_key")).withColumn("residual", residual(F.col(vector).cast("array<double>"), "mean", "axes")).drop("_key", "mean", "axes")


def least_gain(x: np.ndarray) -> float:
    """What a further change point must gain: 2 variance ln n; out of reach where nothing varies."""
    v = float(np.mean((x - x.mean()) ** 2)) if len(x) > 1 else 0.0
    return 2.0 * v * math.log(len(x)) if v >= 1e-20 else 1e10


def pelt(x: np.ndarray, penalty: float | None = None) -> list[int]:
    """Change points in the mean by dynamic programming with pruning; none below three values."""
    n = len(x)
    if n < 3:
        return []
    penalty = least_gain(x) if penalty is None else penalty
    s, q = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
    best, last, open_ = np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(1, int)
    for t in range(1, n + 1):
        each = best[open_] + (q[t] - q[open_] - (s[t] - s[open_]) ** 2 / (t - open_))
        k = int(np.argmin(each))
        best[t], last[t] = each[k] + penalty, open_[k]
        open_ = np.append(open_[each <= best[t] + penalty], t)
    out, t = [], n
    while last[t] > 0:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def change_points(candles: DataFrame, horizon: int = 240) -> DataFrame:
    """Segments of each window of horizon closes: where they start, their length and mean; the last one's direction is that from
    its first to its last close, None below five closes or where nothing moved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("at", kind="stable")["close"].to_numpy(float)
        cuts = [0, *pelt(c), len(c)]
        change = c[-1] - c[cuts[-2]]
        way = "None" if len(c) < 5 or abs(change) < 1e-10 else "Up" if change > 0 else "Down"
        return pd.DataFrame({"sym": pdf["sym"].iloc[0], "win": pdf["win"].iloc[0], "start": cuts[:-1], "length": np.diff(cuts), "mean": [c[a:b].mean() for a, b in zip(cuts, cuts[1:], strict=False)], "direction": [None] * (len(cuts) - 2) + [way]})

    at = F.row_number().over(Window.partitionBy("sym").orderBy("ts")) - 1
    windows = candles.withColumn("at", at).withColumn("win", F.floor(F.col("at") / horizon)).select("sym", "win", "at", "close")
    return windows.groupBy("sym", "win").applyInPandas(run, "sym string, win long, start long, length long, mean double, direction string")
