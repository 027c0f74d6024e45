"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers, their sums are exact, and rows are centred before anything is multiplied: MLlib's
computeSVD sees x - S/n, so no digits go to a common offset. A singular value s over n rows means the variance s^2 / n,
with divisor n. The share that a component explains is taken of the total variance, which comes from the exact integer
deviations n*x - S and not from the decomposition.

Contract for odd input: rows with a null vector, or a null or non-finite entry, go; rows with a null id stay. Repeated rows
count as often as they occur. Vectors of another length are a fit list of their own. Entries whose whole number leaves
+-2^52 count as that bound. Directions without variance (below LEAST of the largest singular value) are no components, so
equal rows, a single row or an empty table give no rows. A deviation beyond 64 bits is null; deviation_exact holds its
digits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, stage_table

#: Whole numbers saturate here.
REACH = 2**52
#: Products of doubles can't tell smaller singular values from none: their squares keep 16 digits of the largest.
LEAST = 1e-6


def _matrix(col: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(col), dim)


def _column_sums(rows: DataFrame, dim: int) -> tuple[list[int], int, int]:
    """Exact sums by dimension, the largest absolute value, and the number of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most, n = [0] * dim, 0, 0
        for batch in batches:
            x = _matrix(batch.column(0), dim, np.int64)
            for i in range(0, len(x), 1024):  # 1,024 values below 2^53 stay within 64 bits
                sums = [a + b for a, b in zip(sums, x[i : i + 1024].sum(axis=0).tolist(), strict=True)]
            most, n = max(most, int(np.abs(x).max(initial=0))), n + len(x)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(dim), pa.int32()), "s": pa.array(map(str, sums), pa.string()), "most": pa.array([most] * dim, pa.int64()), "n": pa.array([n] * dim, pa.int64())})

    parts = rows.select("x").mapInArrow(add, "pos int, s string, most long, n long")
    found = parts.groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most"), F.sum("n").alias("n")).orderBy("pos").collect()
    return [int(r.s) for r in found], found[0].most, found[0].n


def _deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    if (2 * most * n) ** 2 * max(1, len(sums)) < 2**63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def _identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity: their means first, then products of what is centred."""

    def rows(batches: Iterator[pa.RecordBatch], centre: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if centre is None else k * k)
        for batch in batches:
            w = _matrix(batch.column(0), k, np.float64)
            total += w.sum(axis=0) if centre is None else ((w - centre).T @ (w - centre)).reshape(-1)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(total)), pa.int32()), "s": pa.array(total)})

    def summed(centre: np.ndarray | None) -> np.ndarray:
        parts = white.select("w").mapInArrow(lambda b: rows(b, centre), "pos int, s double")
        return np.array([r.s for r in parts.groupBy("pos").agg(F.sum("s").alias("s")).orderBy("pos").collect()])

    mean = summed(None) / n
    return float(np.abs(summed(mean).reshape(k, k) / n - np.eye(k)).max())


def _whiten_length(rows: DataFrame, dim: int, components: int) -> DataFrame | None:
    """Whitened rows of one length of vectors; None where nothing varies."""
    spark = rows.sparkSession
    sums, most, n = _column_sums(rows, dim)
    mean = np.array([s / n for s in sums])
    # x - S/n as (x - q) - r/n, S = q n + r: the subtraction of whole numbers loses no digits
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim, np.int64)
            exact = _deviations(x, n, sums, most)
            c = (x - whole).astype(np.float64) - rest
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(c.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(map(str, exact), pa.string())], ["vec_id", "c", "exact"])

    centred = stage_table(rows.select("vec_id", "x").mapInArrow(centre, "vec_id long, c array<double>, exact string"), "centred")
    # digits of the deviations: their total can pass 38 places, so high and low parts are added apart
    part = F.lpad("exact", 72, "0")
    halves = [F.sum(F.substring(part, 1 + 18 * i, 18).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    total = sum(int(h) * 10 ** (18 * (3 - i)) for i, h in enumerate(centred.agg(*halves).first()))
    if not total:
        return None
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c")), "c")
    # for more than half of the components MLlib solves in full (up to 15,000 dimensions), for fewer only to within 1e-10
    svd = RowMatrix(vectors, n, dim).computeSVD(min(dim, max(components, dim // 2 + 1)), computeU=False, rCond=LEAST)
    variance = np.asarray(svd.s.toArray())[:components] ** 2 / n
    axes = np.asarray(svd.V.toArray())[:, :components]
    k, scaled, trace = len(variance), axes / np.sqrt(variance), total / n**3

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _matrix(batch.column("c"), dim, np.float64) @ scaled
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), values, batch.column("exact")], ["vec_id", "w", "exact"])

    white = stage_table(centred.mapInArrow(project, "vec_id long, w array<double>, exact string"), "whitened")
    error = _identity_error(white, k, n)
    shares = F.array(*(F.lit(float(e / trace)) for e in variance))
    long = white.select("vec_id", "exact", F.posexplode("w").alias("i", "whitened"))
    deviation = F.expr("try_cast(exact as bigint)")
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"), F.col("exact").alias("deviation_exact"))


def whiten(vectors: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """For each row and component: vec_id, component (from 1, by falling variance), n, deviation, whitened, explained,
    identity_error, deviation_exact (the deviation's decimal digits).

    An entry c counts as floor(scale * c) + offset. Components are unit eigenvectors of the covariance with divisor n.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    edge = float(REACH)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c * scale))).cast("long") + F.lit(offset).cast("long"))
    kept = stage_table(rows.select("vec_id", whole.alias("x")), "whole-numbers")
    lengths = sorted(r.dim for r in kept.select(F.size("x").alias("dim")).distinct().collect())
    out = None
    for dim in lengths:
        found = _whiten_length(kept.where(F.size("x") == dim), dim, components) if dim else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    return spark.createDataFrame([], schema) if out is None else out
