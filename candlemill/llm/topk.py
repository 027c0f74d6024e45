"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. The scores are never sorted: passes over the rows build score histograms for
each query, the bin that holds the k-th best score is found from their global sums, and the next pass splits that bin,
until it is one score wide. A last pass keeps what lies above the k-th score, and of those equal to it the smallest ids.

Contract for odd input: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a row
without an id; vectors are compared only with vectors of the same length. Repeated rows are candidates as often as they
occur. A query id that occurs more than once asks once, with its smallest vector. Scores outside 64 bits saturate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import new_path

#: Queries scored together: their matrix is what a job broadcasts, and bounds its histograms (QUERY_BLOCK x BINS counts).
QUERY_BLOCK, BINS, ROW_BLOCK = 2048, 2048, 1024
_EXACT = 2.0**52


def _parse(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * vectors)) of the rows that take part, for each length of vector."""
    ids, col = batch.column(0), batch.column(1)
    if not len(ids):
        return
    off = np.asarray(col.offsets, dtype=np.int64)
    flat = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = (bad[off[1:]] == bad[off[:-1]]) & np.asarray(col.is_valid()) & np.asarray(ids.is_valid())
    ids = np.asarray(ids.fill_null(0), dtype=np.int64)
    length = np.diff(off)
    for dim in np.unique(length[keep]):
        rows = np.flatnonzero(keep & (length == dim))
        at = off[:-1][rows][:, None] + np.arange(dim)
        yield ids[rows], np.floor(scale * flat[at])


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products: float64 where every partial sum stays an exact integer, else Python integers."""
    if not vectors.size or not queries.size:
        return np.zeros((len(vectors), len(queries)))
    if np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1] < _EXACT:
        return vectors @ queries.T
    whole = np.vectorize(int, otypes=[object])
    low, high = -(2**63), 2**63 - 1
    return np.vectorize(lambda s: min(max(s, low), high), otypes=[object])(whole(vectors) @ whole(queries).T)


class _Block:
    """The queries of one block, by vector length, with the interval in which each one's k-th score lies."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(v) for v in vectors], dtype=np.int64)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            self.by_dim[int(dim)] = at, np.array([vectors[i] for i in at]).reshape(len(at), int(dim))

    def scored(self, batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query positions, candidate ids, scores, whether each pair counts), for blocks of candidates."""
        for ids, vectors in _parse(batch, scale):
            if (own := self.by_dim.get(vectors.shape[1])) is None:
                continue
            at, q = own
            for i in range(0, len(ids), ROW_BLOCK):
                some = ids[i : i + ROW_BLOCK]
                yield at, some, _scores(vectors[i : i + ROW_BLOCK], q), some[:, None] != self.ids[at][None, :]


def _histograms(df: DataFrame, block: _Block, low: list[int], top: list[int], width: list[int], need: np.ndarray, scale: int, bins: int) -> DataFrame:
    """Rows (q, bin, n) over all candidates. A task leaves out bins below its own need-th best: the global one isn't lower."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(block.ids), bins), dtype=np.int64)
        lo, end, step = (np.array(x, dtype=object) for x in (low, top, width))
        if max(map(abs, low + top), default=0) < _EXACT:
            lo, end, step = (x.astype(np.float64) for x in (lo, end, step))
        for batch in batches:
            for at, _, score, counts in block.scored(batch, scale):
                where = (score - lo[at]) // step[at]
                counts = counts & (score >= lo[at]).astype(bool) & (score < end[at]).astype(bool)
                flat = (np.broadcast_to(at, where.shape)[counts] * bins + where[counts].astype(np.int64)).astype(np.int64)
                seen += np.bincount(flat, minlength=seen.size).reshape(seen.shape)
        above = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1] - seen
        q, b = np.nonzero((seen > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(seen[q, b], pa.int64())], ["q", "bin", "n"])

    return df.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(histograms: DataFrame, need: np.ndarray) -> dict[int, tuple[int, int]]:
    """For each query of the block: the bin that holds its need-th best score, and how many scores lie above that bin."""
    spark = histograms.sparkSession
    wanted = spark.createDataFrame([(int(q), int(n)) for q, n in enumerate(need)], "q int, need long")
    down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    found = histograms.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(wanted), "q").where("upto >= need and upto - n < need")
    return {r.q: (r.bin, r.upto - r.n) for r in found.select("q", "bin", "upto", "n").collect()}


def _best(df: DataFrame, block: _Block, least: list[int], k: int, scale: int) -> DataFrame:
    """Rows (query_id, vec_id, score): in each task, at most the k best of each query that reach its k-th score."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.array(least, dtype=object)
        if max(map(abs, least), default=0) < _EXACT:
            bound = bound.astype(np.float64)
        q, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for at, some, score, counts in block.scored(batch, scale):
                row, col = np.nonzero(counts & (score >= bound[at]).astype(bool))
                q, ids, scores = np.concatenate([q, at[col]]), np.concatenate([ids, some[row]]), np.concatenate([scores, score[row, col].astype(np.int64)])
                order = np.lexsort((ids, -scores.astype(np.float64) if not len(scores) or np.abs(scores).max() < 2**52 else [-int(s) for s in scores], q))
                q, ids, scores = q[order], ids[order], scores[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                q, ids, scores = q[rank < k], ids[rank < k], scores[rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return df.mapInArrow(keep, "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """The k best rows for each row that is_query selects: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x), a score is the integer inner product, ties go to the smaller id, and a
    query is never its own answer. Queries are taken in blocks of about query_block; nothing larger reaches the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = asked.where(whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # a repeated id asks once
    blocks = max(1, math.ceil(asked.count() / query_block))

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for _, v in _parse(batch, scale):
                most = max(most, float(np.sqrt((v * v).sum(axis=1)).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    longest = rows.mapInArrow(norm, "most double").agg(F.max("most")).first()[0] or 0.0
    schema = "query_id long, rank int, vec_id long, score long"
    path = new_path(spark, "topk")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        found = {r.vec_id: r.embedding for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()}
        if not found:
            continue
        ids = np.array(sorted(found), dtype=np.int64)
        block = _Block(ids, [np.floor(scale * np.array(found[i])) for i in ids.tolist()])
        reach = [0] * len(ids)
        for at, q in block.by_dim.values():
            for i, n in zip(at, np.sqrt((q * q).sum(axis=1)), strict=True):
                reach[i] = min(int(n * longest) + 2, 2**63)
        low, top, need = [-r for r in reach], [r + 1 for r in reach], np.full(len(ids), k, dtype=np.int64)
        while any(t - x > 1 for x, t in zip(low, top, strict=True)):
            width = [max(1, -(-(t - x) // bins)) for x, t in zip(low, top, strict=True)]
            hit = _kth_bins(_histograms(rows, block, low, top, width, need, scale, bins), need)
            for i, w in enumerate(width):
                if i in hit:
                    at, above = hit[i]
                    low[i], need[i] = low[i] + at * w, need[i] - above
                    top[i] = min(top[i], low[i] + w)
                elif top[i] > low[i]:  # fewer than k candidates: all of them are wanted
                    top[i] = low[i]
        best = _best(rows, block, low, k, scale)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
