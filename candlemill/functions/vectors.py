"""Vector-symbolic algebra on array columns: exact and inside the JVM.

Ternary vectors are arrays of -1, 0, 1 as doubles. Atoms come from a hash of a typed name: only their geometry counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def atom(name: Column, d: int, kind: str = "s") -> Column:
    """Dense bipolar vector of a name; kind keeps 1, "1" and 1.0 apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.xxhash64(F.lit(kind), name, i).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0))


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def threshold(a: Column) -> Column:
    return F.transform(a, lambda x: F.signum(x))


def blend(a: Column, b: Column, w1: float | Column, w2: float | Column) -> Column:
    u, v = (w if isinstance(w, Column) else F.lit(w) for w in (w1, w2))
    return threshold(F.zip_with(a, b, lambda x, y: u * x + v * y))


def permute(a: Column, k: int) -> Column:
    """Circular shift to the right by k."""
    n = F.size(a)
    s = F.pmod(F.lit(k), n).cast("int")
    return F.concat(F.slice(a, n - s + 1, s), F.slice(a, F.lit(1), n - s))


def thermometer(v: Column, lo: Column, hi: Column, d: int) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))
    n = F.floor(share * d + 0.5)
    return F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.when(i <= n, 1.0).otherwise(-1.0))


def linear(v: Column, scale: Column, d: int) -> Column:
    return thermometer(v, F.lit(0.0), scale, d)


def logarithmic(v: Column, lo: float, hi: float, d: int) -> Column:
    return thermometer(F.log(v), F.log(F.lit(lo)), F.log(F.lit(hi)), d)


def reciprocal_log(v: Column, n: float, d: int) -> Column:
    return logarithmic(v, 1.0 / n, n, d)


def circular(v: Column, period: float, d: int) -> Column:
    angle = v * (2 * 3.141592653589793 / period)
    return blend(atom(F.lit("cos"), d, "basis"), atom(F.lit("sin"), d, "basis"), F.cos(angle), F.sin(angle))


def bundle(vectors: Column) -> Column:
    """Signs of the sums over an array of vectors."""
    return threshold(F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y)))


def capacity(d: int) -> int:
    """Children that a bundle of width d holds."""
    import math

    return math.isqrt(d)


def checked_bundle(vectors: Column, d: int) -> Column:
    """struct(vector, overflow): no vector beyond the capacity, and a flag instead of an error."""
    over = F.size(vectors) > capacity(d)
    return F.struct(F.when(~over, bundle(vectors)).alias("vector"), over.alias("overflow"))


GUARDS = ("silent", "warn", "error", "abort")


def guarded_bundle(vectors: Column, d: int, mode: str) -> Column:
    """struct(vector, overflow) under one of four guards, should there be more children than d places carry: silent bundles them
    and says nothing, warn bundles and sets the flag, error sets the flag in place of a vector, abort fails the query."""
    if mode not in GUARDS:
        raise ValueError(f"one of {', '.join(GUARDS)}")
    over = F.size(vectors) > capacity(d)
    held = bundle(vectors)
    if mode == "error":
        held = F.when(~over, held)
    elif mode == "abort":
        held = F.when(~over, held).otherwise(F.raise_error(F.concat(F.lit("a bundle of "), F.size(vectors).cast("string"), F.lit(f" children exceeds the capacity of {capacity(d)}"))).cast("array<double>"))
    return F.struct(held.alias("vector"), (F.lit(False) if mode == "silent" else over).alias("overflow"))


def bundle_rows(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One bundle for each group: positions are summed by a grouped aggregate, so no group is gathered."""
    sums = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    ordered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.signum("x").alias("x")))).alias("v"))
    return ordered.select(*keys, F.transform("v", lambda s: s["x"]).alias(vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(0.0)


def amplify(x: Column, y: Column, s: float) -> Column:
    return blend(x, y, 1.0, s)


def subtract(x: Column, y: Column) -> Column:
    return blend(x, y, 1.0, -1.0)


def project(x: Column, y: Column) -> Column:
    """The part of x along y."""
    s = dot(y, y)
    w = F.when(s > 0, dot(x, y) / F.when(s > 0, s)).otherwise(0.0)
    return F.transform(y, lambda v: v * w)


def reject(x: Column, y: Column) -> Column:
    return F.zip_with(x, project(x, y), lambda a, b: a - b)


def noise_floor(d: int) -> float:
    return 5.0 / d**0.5


def present(a: Column, b: Column, d: int) -> Column:
    return cosine(a, b) > noise_floor(d)


def coincident(a: Column, b: Column, d: int) -> Column:
    return 1 - cosine(a, b) < noise_floor(d)


def shifted_by_place(vectors: Column) -> Column:
    return F.transform(vectors, lambda v, i: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda j: F.get(v, F.pmod(j - i, F.size(v)).cast("int"))))


def sequential(vectors: Column, bundled: bool = False) -> Column:
    """The vectors, each shifted by its place, bound; or bundled, as the older encoder has it."""
    shifted = shifted_by_place(vectors)
    if bundled:
        return bundle(shifted)
    return F.aggregate(F.slice(shifted, 2, F.size(shifted)), F.get(shifted, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x * y))


def ngrams(vectors: Column, n: int) -> Column:
    """Bundle of the sequentials of n neighbours."""
    starts = F.sequence(F.lit(1), F.size(vectors) - n + 1)
    return bundle(F.transform(starts, lambda i: sequential(F.slice(vectors, i, n))))


def simhash(v: Column, seed: int = 0) -> Column:
    """64 signs of hashed projections, as a long."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.aggregate(F.transform(v, lambda x, i: F.when(F.xxhash64(F.lit(seed), k, i).bitwiseAND(F.lit(1)) == 0, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda s, x: s + x) > 0, "1").otherwise("0"))
    return F.conv(F.array_join(bits, ""), 2, -10).cast("long")


def to_hex(v: Column) -> Column:
    """Ternary vector as text, two digits each; from_hex gives it back."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex((x + 1).cast("int")), 2, "0")), "")


def from_hex(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda i: F.substring(text, i, F.lit(2)).cast("double") - 1)


def rhythm(values: Column, lo: Column | float, hi: Column | float, delta: Column | float, d: int, name: Column | str = "rhythm") -> Column:
    """Values as thermometers, each bundled with its change (a thermometer bound to the atom of changes, with equal weight: where
    they differ the sum is 0; the first has none); bound to trigrams, trigrams to pairs, the last pairs bundled, bound to the
    name's atom. Below four values it is the name bound to a sentinel.

    Each step reads the one before several times, so this is one Arrow-batched pass in numpy and not nested lambdas.
    """
    budget = capacity(d)

    @pandas_udf("array<double>")
    def encode(lists: pd.Series, low: pd.Series, high: pd.Series, most: pd.Series, change_atom: pd.Series, sentinel: pd.Series) -> pd.Series:
        place = np.arange(1, d + 1)
        gauge = lambda v, a, b: np.where(place <= np.floor(np.clip((v - a) / (b - a), 0, 1)[:, None] * d + 0.5), 1.0, -1.0)
        out = []
        for values, a, b, m, change, short in zip(lists, low, high, most, change_atom, sentinel, strict=True):
            if values is None or len(values) < 4:
                out.append(list(short))
                continue
            x = np.asarray(values, float)[-(budget + 3) :]
            facts = gauge(x, a, b)
            facts[1:] = np.sign(facts[1:] + gauge(np.diff(x), -m, m) * np.asarray(change, float))
            three = facts[:-2] * np.roll(facts[1:-1], 1, axis=1) * np.roll(facts[2:], 2, axis=1)
            out.append(np.sign((three[:-1] * three[1:])[-budget:].sum(axis=0)).tolist())
        return pd.Series(out, dtype=object)

    number = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    label = name if isinstance(name, Column) else F.lit(name)
    return bind(encode(values, number(lo), number(hi), number(delta), atom(F.lit("delta"), d), atom(F.lit("short-window-sentinel"), d)), atom(label, d))


def map_bundle(keys: Column, values: Column) -> Column:
    """Arrays of key and of value vectors as one vector: the bundle of each key bound to its value."""
    return bundle(F.zip_with(keys, values, bind))


def map_get(bundled: Column, key: Column) -> Column:
    """What a map holds under key, with the noise of its other entries: compare it with candidates."""
    return bind(bundled, key)


def list_bundle(values: Column, d: int) -> Column:
    """A map whose keys are the places, as integers."""
    return map_bundle(F.transform(values, lambda v, i: atom(i, d, "i")), values)


def nearest(v: Column, names: Column, candidates: Column) -> Column:
    """struct(name, cosine) of the candidate most like v, the first of equal ones."""
    scored = F.zip_with(names, candidates, lambda n, c: F.struct((-cosine(v, c)).alias("s"), n.alias("name")))
    best = F.array_min(scored)
    return F.struct(best["name"].alias("name"), (-best["s"]).alias("cosine"))
