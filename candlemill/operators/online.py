"""Online learning: a low-rank sketch that follows a stream of vectors, values decoded from bundles of outcomes, and class
prototypes whose experience decays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlemill.operators.series import numbered

# --- subspace ------------------------------------------------------------------------------------------------------


class Directions:
    """A frequent-directions sketch: of the rows seen so far at most 2 * ell rows, whose products differ from theirs by at most
    lost in any direction, and lost is at most their squared mass over ell.

    axes are the k leading directions as of the last time that the sketch was full; before, there are none. Two sketches
    merge into one with the same bound, their losses added up.
    """

    def __init__(self, ell: int, k: int, rows: np.ndarray | None = None, axes: np.ndarray | None = None, lost: float = 0.0):
        self.ell, self.k, self.lost = ell, k, lost
        self.rows = [] if rows is None else list(rows)
        self.axes = axes

    def residual(self, x: np.ndarray) -> float:
        """How long the part of x is that the axes don't explain."""
        along = 0.0 if self.axes is None else float(((self.axes @ x) ** 2).sum())
        return float(np.sqrt(max(float(x @ x) - along, 0.0)))

    def update(self, x: np.ndarray) -> None:
        self.rows.append(x)
        if len(self.rows) >= 2 * self.ell:
            self.shrink()

    def shrink(self) -> None:
        _, s, v = np.linalg.svd(np.array(self.rows), full_matrices=False)
        cut = float(s[self.ell - 1] ** 2) if len(s) >= self.ell else 0.0
        self.lost += cut
        left = np.sqrt(np.maximum(s**2 - cut, 0.0))
        keep = left > 0
        self.rows, self.axes = list(left[keep, None] * v[keep]), v[: self.k]

    def merge(self, other: Directions) -> Directions:
        out = Directions(self.ell, self.k, np.array([*self.rows, *other.rows]), self.axes if other.axes is None else other.axes, self.lost + other.lost)
        if len(out.rows) >= 2 * self.ell or (self.axes is not None and other.axes is not None):
            out.shrink()
        return out

    def packed(self) -> tuple[bytes, bytes, float]:
        return np.array(self.rows).tobytes(), b"" if self.axes is None else self.axes.tobytes(), self.lost

    @classmethod
    def unpacked(cls, ell: int, k: int, d: int, rows: bytes, axes: bytes, lost: float) -> Directions:
        shaped = lambda b: np.frombuffer(b).reshape(-1, d)
        return cls(ell, k, shaped(rows) if rows else None, shaped(axes) if axes else None, lost)


_RESIDUAL = "id long, residual double"
_SKETCH = "rows binary, axes binary, lost double"


def _follow(space: Directions, pdf: pd.DataFrame) -> pd.DataFrame:
    """Residuals of rows in order, each before the sketch takes it in."""
    out = []
    for i, v in zip(pdf["id"], pdf["v"], strict=True):
        x = np.asarray(v, dtype=float)
        out.append((i, space.residual(x)))
        space.update(x)
    return pd.DataFrame(out, columns=["id", "residual"])


def subspace_residuals(df: DataFrame, *, key: str, id_col: str, vector: str, ell: int = 16, k: int = 8, size: int = 4096) -> DataFrame:
    """key, id, residual: how far each vector is from the subspace of the vectors of its key with smaller ids.

    Rows of a key are cut into chunks of size. Every chunk is sketched on its own; the sketches before a chunk, 2 * ell rows
    each, are merged as they stream by; and each chunk starts from what came before it. So no task reads more than a chunk
    of rows, and a key of one chunk gets exactly what a stream would. Null ids and vectors take no part.
    """
    rows = df.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = numbered(rows, key="key", order="id", slot=F.floor(F.col("id") / 10_000)).withColumn("chunk", F.floor(F.col("i") / size)).drop("i")
    kind = rows.schema["key"].dataType.simpleString()

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        space = Directions(ell, k)
        _follow(space, pdf.sort_values("id", kind="stable"))
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["chunk"].iloc[0], len(pdf["v"].iloc[0]), *space.packed())], columns=["key", "chunk", "d", "rows", "axes", "lost"])

    schema = f"key {kind}, chunk long, d int, {_SKETCH}"
    sketches = rows.groupBy("key", "chunk").applyInPandas(sketch, schema)

    def before(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, space = object(), None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != now:
                    now, space = r.key, Directions(ell, k)
                out.append((r.key, r.chunk + 1, r.d, *space.merge(Directions.unpacked(ell, k, r.d, r.rows, r.axes, r.lost)).packed()))
                space = Directions.unpacked(ell, k, r.d, *out[-1][3:])
            yield pd.DataFrame(out, columns=["key", "chunk", "d", "rows", "axes", "lost"])

    starts = sketches.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(before, schema)

    def follow(_, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "residual": pd.Series(dtype=float)})
        space = Directions(ell, k)
        if len(start):
            s = start.iloc[0]
            space = Directions.unpacked(ell, k, int(s["d"]), s["rows"], s["axes"], float(s["lost"]))
        return _follow(space, pdf.sort_values("id", kind="stable")).assign(key=pdf["key"].iloc[0])[["key", "id", "residual"]]

    return rows.groupBy("key", "chunk").cogroup(starts.groupBy("key", "chunk")).applyInPandas(follow, f"key {kind}, {_RESIDUAL}")


def stream_residuals(rows: DataFrame, ell: int = 16, k: int = 8) -> DataFrame:
    """The streaming twin: rows (key string, id, v); the state of a key is its sketch. A micro-batch is put in order of id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("id", kind="stable")
        d = len(pdf["v"].iloc[0])
        space = Directions.unpacked(ell, k, d, *state.get) if state.exists else Directions(ell, k)
        out = _follow(space, pdf)
        state.update(space.packed())
        yield out.assign(key=key[0])[["key", "id", "residual"]]

    return rows.groupBy("key").applyInPandasWithState(step, f"key string, {_RESIDUAL}", _SKETCH, "append", GroupStateTimeout.NoTimeout)


# --- values out of bundles -----------------------------------------------------------------------------------------


def level(value: Column, low: float, high: float, d: int, log: bool = False) -> Column:
    """How many of d places a thermometer fills for a value; a logarithmic one takes 1e-300 for what isn't positive."""
    scaled = (lambda x: F.log(F.greatest(x, F.lit(1e-300)))) if log else (lambda x: x)
    a, b = scaled(F.lit(float(low))), scaled(F.lit(float(high)))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (scaled(value) - a) / (b - a))) * d + 0.5).cast("int")


def accumulate(df: DataFrame, names: list[str], value: Column, outcome: Column, weight: Column, low: float, high: float, d: int = 1024, log: bool = False) -> DataFrame:
    """Bundles of outcomes: names, outcome, level, weight. A value is encoded as a thermometer of d places and counts 1 + weight.

    Vectors of one level are the same, so a bundle is its weights by level: at most d + 1 rows, whatever was observed.
    """
    rows = df.select(*names, outcome.alias("outcome"), level(value, low, high, d, log).alias("level"), (1 + weight).alias("weight")).where("level is not null and weight is not null")
    return rows.groupBy(*names, "outcome", "level").agg(F.sum("weight").alias("weight"))


def extract(bundles: DataFrame, names: list[str], low: float, high: float, steps: int, d: int = 1024, log: bool = False, outcome: str = "Grace") -> DataFrame:
    """names, value, cosine: of steps values from low to high the one whose vector is most like the outcome's bundle, the first of equals.

    A place of the bundle is 1 where the levels that reach it outweigh the others, -1 where they are outweighed, else 0. Places
    1 to p are 1, the next z are 0, so each candidate's cosine follows from p and z.
    """
    own = bundles.where(F.col("outcome") == outcome)
    down = Window.partitionBy(*names).orderBy(F.desc("level"))
    reach = own.withColumns({"_t": F.sum("weight").over(down.rowsBetween(Window.unboundedPreceding, 0)), "_w": F.sum("weight").over(Window.partitionBy(*names))})
    ends = reach.groupBy(*names).agg(F.coalesce(F.max(F.when(2 * F.col("_t") > F.col("_w"), F.col("level"))), F.lit(0)).alias("_p"), F.coalesce(F.max(F.when(2 * F.col("_t") >= F.col("_w"), F.col("level"))), F.lit(0)).alias("_pz"))
    swept = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("value", F.lit(float(low)) + F.col("step") * ((high - low) / (steps - 1)))
    m, p, pz = level(F.col("value"), low, high, d, log), F.col("_p"), F.col("_pz")
    dot = (2 * F.least(m, p) - p) + (d - pz) - 2 * F.greatest(F.lit(0), m - pz)
    size = F.sqrt((p + d - pz).cast("double")) * float(d) ** 0.5
    scored = swept.withColumn("cosine", F.when(p + d - pz > 0, dot / F.when(size > 0, size)).otherwise(0.0))
    best = scored.groupBy(*names).agg(F.max(F.struct("cosine", (-F.col("step")).alias("_s"), "value")).alias("_b"))
    return best.select(*names, F.col("_b.value").alias("value"), F.col("_b.cosine").alias("cosine"))


# --- decaying prototypes -------------------------------------------------------------------------------------------


def decayed_prototypes(rows: DataFrame, *, decay: float, interval: int) -> DataFrame:
    """rows (key, epoch, i, label, v): key, epoch, protos: an array of (label, experience, prototype) as of the end of each epoch of
    interval observations. Before an observation counts, all that came before it is multiplied by decay.

    Within an epoch each observation's weight is known from its place, so its sums are one grouped aggregate; what epochs
    leave behind, a vector a label, is carried from one to the next as they stream by.
    """
    ages = interval - 1 - F.col("i") % interval
    weighed = rows.withColumn("_w", F.pow(F.lit(float(decay)), ages))
    sums = weighed.select("key", "epoch", "label", "_w", F.posexplode("v").alias("pos", "x")).groupBy("key", "epoch", "label", "pos").agg(F.sum(F.col("x").cast("double") * F.col("_w")).alias("x"), F.sum("_w").alias("w"))
    vectors = sums.groupBy("key", "epoch", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"), F.max("w").alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = float(decay) ** interval

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, epoch, held = object(), None, {}

        def state():
            return (now, epoch, [{"label": n, "experience": w, "prototype": v} for n, (w, v) in sorted(held.items())])

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != now or r.epoch != epoch:
                    if epoch is not None:
                        out.append(state())
                    if r.key != now:
                        now, held = r.key, {}
                    else:
                        fade = whole ** (r.epoch - epoch)
                        held = {n: (w * fade, v * fade) for n, (w, v) in held.items()}
                    epoch = r.epoch
                w, v = held.get(r.label, (0.0, 0.0))
                held[r.label] = w + r.w, v + np.asarray(r.v, dtype=float)
            yield pd.DataFrame(out, columns=["key", "epoch", "protos"])
        if epoch is not None:
            yield pd.DataFrame([state()], columns=["key", "epoch", "protos"])

    ordered = vectors.repartition("key").sortWithinPartitions("key", "epoch", "label")
    return ordered.mapInPandas(carry, f"key {kinds['key']}, epoch long, protos array<struct<label: {kinds['label']}, experience: double, prototype: array<double>>>")


def decaying_reckoner(df: DataFrame, *, key: str, id_col: str, label: str, vector: str, cosine, decay: float = 0.999, interval: int = 500) -> DataFrame:
    """key, id, guess, conviction, experience, epoch: each observation judged, before its label is learned, by the prototypes of the
    last recalibration, which happens every interval observations. conviction: the best cosine less the next one; experience:
    the decayed number of observations behind the guess. Null in the first epoch, when nothing is known.
    """
    rows = df.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    rows = numbered(rows, key="key", order="id", slot=F.floor(F.col("id") / 10_000)).withColumn("epoch", F.floor(F.col("i") / interval))
    protos = decayed_prototypes(rows, decay=decay, interval=interval).select("key", (F.col("epoch") + 1).alias("epoch"), "protos")
    judged = rows.join(protos, ["key", "epoch"], "left")
    scored = F.array_sort(F.transform("protos", lambda p: F.struct((-cosine(F.col("v"), p["prototype"])).alias("s"), p["label"].alias("label"), p["experience"].alias("experience"))))
    top = judged.withColumn("_s", scored)
    first, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    return top.select("key", "id", first["label"].alias("guess"), (F.coalesce(second["s"], F.lit(0.0)) - first["s"]).alias("conviction"), first["experience"].alias("experience"), "epoch")
