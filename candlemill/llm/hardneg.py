"""Hard negatives found through one-dimensional distance keys.

Inner products become distances: every vector gets one more component, sqrt(M^2 - |x|^2) with M the longest length, and a
query gets a zero there, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each augmented vector belongs to its nearest pivot, and
the index keeps all of them sorted by (pivot, distance to the pivot), in blocks of consecutive keys. A row within r of a
query has a key within r of the query's own distance to that pivot, so a search reads key intervals around those
distances. Intervals widen, and only blocks not seen yet are read, until the wanted rank is certain: the k-th score found
is at least the score of anything outside. A search below a highest score runs over annuli: blocks that lie wholly inside
the inner radius aren't read.

Contract for odd input: rows with a null id or label, a null vector, or a null or non-finite component take no part;
vectors meet only vectors of the same length. An anchor id that occurs more than once asks once, with the smallest label
and then the smallest key. Rows that carry the anchor's own id are never its answers; other repeated rows count as often as
they occur. Scores outside 64 bits saturate. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, new_path, running_total, shuffle_partitions, stage_table
from candlemill.llm.topk import _scores

#: Anchors searched together (their vectors and key intervals are what a job sends to tasks), rows of an index block,
#: pivots, and the rows that pivots and first radii are fitted on. None bounds what is searched.
ANCHOR_BLOCK, INDEX_BLOCK, PIVOTS, SAMPLE = 2048, 512, 64, 4096
#: Relative slack of distances, far above their rounding errors: intervals are a little too wide, never too narrow.
SLACK = 1e-9
_INDEX = "dim int, pivot int, lo double, hi double, ids binary, labels binary, vectors binary"


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column without nulls."""
    off = np.asarray(col.offsets, dtype=np.int64)
    return off - off[0], np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)


def _pack(v: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where they fit, else as doubles."""
    return v.astype(np.int16 if not v.size or np.abs(v).max() < 2**15 else np.float64).tobytes()


def _unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    if not rows * dim:
        return np.zeros((rows, dim))
    return np.frombuffer(data, np.int16 if len(data) == 2 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _augment(v: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        found = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), 0.0))
    return np.nan_to_num(found, nan=0.0, posinf=0.0)


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Means of groups of the sample, found by Lloyd's rounds from rows that lie far from each other."""
    centres, far = sample[:1], _distances(sample, sample[:1])[:, 0]
    while len(centres) < pivots and far.max() > 0:
        centres = np.vstack([centres, sample[far.argmax()]])
        far = np.minimum(far, _distances(sample, centres[-1:])[:, 0])
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(axis=1)
        for p in np.unique(nearest):
            centres[p] = sample[nearest == p].mean(axis=0)
    return centres


class Keyed:
    """The index: a table of blocks sorted by (dim, pivot, distance), its pivots and the sample behind them."""

    def __init__(self, blocks: DataFrame, anchors: DataFrame, size: dict[int, tuple[float, int]], pivots: dict[int, np.ndarray], sample: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.blocks, self.anchors, self.size, self.pivots, self.sample = blocks, anchors, size, pivots, sample


def build_index(vectors: DataFrame, is_anchor: Column, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS, block: int = INDEX_BLOCK) -> Keyed:
    """All rows that take part, sorted by (pivot, distance), and the anchors among them in the same order."""
    spark = vectors.sparkSession
    bound_batches(spark)
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x * scale))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        n: dict[int, int] = {}
        for batch in batches:
            off, flat = _lists(batch.column(0))
            dims, flat = np.diff(off), np.floor(flat)
            sums = np.add.reduceat(np.r_[flat * flat, 0.0], off[:-1]) if len(dims) else np.zeros(0)
            for dim in np.unique(dims).tolist():
                own = sums[dims == dim] if dim else np.zeros(1)
                most[dim], n[dim] = max(most.get(dim, 0.0), float(own.max())), n.get(dim, 0) + int((dims == dim).sum())
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(most), pa.int32()), "most": pa.array(list(most.values()), pa.float64()), "n": pa.array([n[d] for d in most], pa.int64())})

    sized = rows.select("v").mapInArrow(lengths, "dim int, most double, n long").groupBy("dim").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    size = {r.dim: (r.most, r.n) for r in sized.collect()}
    drawn = rows.orderBy(F.xxhash64("id"), "id", "label").select("label", "v").limit(SAMPLE).collect()
    sample, fitted = {}, {}
    for dim, (most, _) in size.items():
        own = [r for r in drawn if len(r.v) == dim]
        v = np.floor(np.array([r.v for r in own], dtype=np.float64).reshape(len(own), dim))
        sample[dim] = v, np.array([r.label for r in own], dtype=np.int64)
        usable = len(own) and math.isfinite(most)
        fitted[dim] = fit_pivots(_augment(v, most), pivots) if usable else np.zeros((1, dim + 1))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, flat = _lists(batch.column("v"))
            dims, flat = np.diff(off), np.floor(flat)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = flat[off[:-1][at][:, None] + np.arange(dim)]
                far = _distances(_augment(v, size[dim][0]), fitted[dim]) if math.isfinite(size[dim][0]) else np.zeros((len(v), 1))
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(np.full(len(at), dim), pa.int32()), "pivot": pa.array(near, pa.int32()), "key": pa.array(far[np.arange(len(at)), near]),
                    "id": batch.column("id").take(pa.array(at)), "label": batch.column("label").take(pa.array(at)), "anchor": batch.column("anchor").take(pa.array(at)), "v": pa.array([_pack(x) for x in v], pa.binary()),
                })

    keyed = rows.mapInArrow(keys, "dim int, pivot int, key double, id long, label long, anchor boolean, v binary")
    order = ["dim", "pivot", "key", "id"]  # the id deals rows with one key, such as copies, over ranges
    # a table, as the sort reads it once for the bounds of its ranges and once to deal rows out
    placed = stage_table(keyed, "keys")
    in_order = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, pivot, key, ids, labels = (np.asarray(batch.column(c)) for c in ("dim", "pivot", "key", "id", "label"))
            cuts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1])]) if len(dim) else np.zeros(0, int)
            out: list[tuple] = []
            for a, z in zip(cuts, np.r_[cuts[1:], len(dim)], strict=True):
                for i in range(a, z, block):
                    j = min(i + block, z)
                    v = np.concatenate([_unpack(x, 1, int(dim[i])) for x in batch.column("v").slice(i, j - i).to_pylist()])
                    out.append((dim[i], pivot[i], key[i], key[j - 1], ids[i:j].astype(np.int64).tobytes(), labels[i:j].astype(np.int64).tobytes(), _pack(v)))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    packed = stage_table(in_order.mapInArrow(blocks, _INDEX), "distance-keys")
    own = placed.where("anchor").groupBy("id").agg(F.min(F.struct("label", "dim", "pivot", "key", "v")).alias("own")).select("id", "own.*")
    return Keyed(packed, own.withColumn("one", F.lit(1)), size, fitted, sample)


class _Search:
    """One search for the anchors of a block: for each of them some goals, each the k best scores within [low, high]."""

    def __init__(self, index: Keyed, dim: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, goals: list[list[tuple[int | None, int | None]]], k: int, same: bool):
        self.index, self.dim, self.ids, self.labels, self.v, self.goals, self.k, self.same = index, dim, ids, labels, v, goals, k, same
        self.most = index.size[dim][0]
        with np.errstate(over="ignore"):
            self.q2 = (v * v).sum(axis=1)
        self.away = _distances(np.column_stack([v, np.zeros(len(v))]), index.pivots[dim]) if math.isfinite(self.most) else np.zeros((len(v), 1))
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in own] for own in goals]

    def radius(self, q: int, score: float) -> float:
        """All rows at least this good lie within it."""
        span = self.q2[q] + self.most
        return math.sqrt(max(0.0, span - 2 * score) + SLACK * span) + SLACK if math.isfinite(span) and score > -math.inf else math.inf

    def core(self, q: int, score: float) -> float:
        """All rows within it are better than that."""
        span = self.q2[q] + self.most
        return math.sqrt(max(0.0, span - 2 * score - SLACK * span)) * (1 - SLACK) if math.isfinite(span) else 0.0

    def first_target(self, q: int, scores: np.ndarray, low: int | None, high: int | None) -> float:
        """A score that some 4 k rows are likely to reach, from the sample."""
        labels = self.index.sample[self.dim][1]
        usable = (labels == self.labels[q]) == self.same
        if high is not None:
            usable &= (scores <= high).astype(bool)
        some = np.sort(scores[usable].astype(np.float64))[::-1]
        at = math.ceil(4 * self.k * len(labels) / max(1, self.index.size[self.dim][1]))
        floor = -math.inf if low is None else float(low)
        return max(floor, float(some[at])) if len(some) > at else floor

    def run(self) -> None:
        """Widen key intervals until every goal is certain."""
        n = len(self.ids)
        with np.errstate(all="ignore"):
            sampled = _scores(self.index.sample[self.dim][0], self.v)
        seen = np.full(n, -1.0)  # radius within which all blocks are read; -1: none
        target = [[self.first_target(q, sampled[:, q], *goal) for goal in own] for q, own in enumerate(self.goals)]
        inner = np.array([min((0.0 if high is None else self.core(q, high) for _, high in own), default=0.0) for q, own in enumerate(self.goals)])
        is_open = [[low is None or high is None or low <= high for low, high in own] for own in self.goals]
        tries = 0
        while any(map(any, is_open)):
            reach = np.array([max((self.radius(q, t) for t, o in zip(target[q], is_open[q], strict=True) if o), default=-1.0) for q in range(n)])
            active = reach > seen
            if active.any():
                self.scan(np.where(active, reach, -1.0), seen, inner, is_open)
            seen = np.maximum(seen, reach)
            for q in range(n):
                for g, (low, _) in enumerate(self.goals[q]):
                    if not is_open[q][g]:
                        continue
                    found = self.best[q][g]
                    need = found[self.k - 1][0] if len(found) >= self.k else -math.inf if low is None else low
                    if self.radius(q, need) <= seen[q]:
                        is_open[q][g] = False
                    elif len(found) >= self.k or tries >= 3:
                        target[q][g] = need
                    else:  # twice the squared distance
                        target[q][g] = max(need, target[q][g] - (self.q2[q] + self.most - 2 * target[q][g]) / 2) if target[q][g] > -math.inf else need
            tries += 1

    def scan(self, reach: np.ndarray, seen: np.ndarray, inner: np.ndarray, is_open: list[list[bool]]) -> None:
        """Read the blocks that reach brings in, and merge what they hold into the best of each goal."""
        slots = max(map(len, self.goals))
        low, high = np.full((slots, len(self.ids)), 1, dtype=object), np.full((slots, len(self.ids)), 0, dtype=object)  # an empty goal
        for q, own in enumerate(self.goals):
            for g, (a, z) in enumerate(own):
                if is_open[q][g]:
                    found = self.best[q][g]
                    least = -(2**63) if a is None else a
                    low[g, q] = max(least, found[self.k - 1][0]) if len(found) >= self.k else least
                    high[g, q] = 2**63 - 1 if z is None else z
        k, same, dim, ids, labels, v, away = self.k, self.same, self.dim, self.ids, self.labels, self.v, self.away
        on = np.flatnonzero(reach >= 0)
        near = None
        for p in range(away.shape[1]):
            a, z = float((away[on, p] - reach[on]).min()), float((away[on, p] + reach[on]).max())
            c = (F.col("pivot") == p) & (F.col("hi") >= a - SLACK * abs(a) if math.isfinite(a) else F.lit(True)) & (F.col("lo") <= z + SLACK * abs(z) if math.isfinite(z) else F.lit(True))
            near = c if near is None else near | c

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi = low.copy(), high.copy()
            n = len(ids)
            goal, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def merge() -> None:
                nonlocal goal, found, score
                goal, found, score = (np.concatenate([x, *y]) for x, y in zip((goal, found, score), zip(*waiting, strict=True), strict=True)) if waiting else (goal, found, score)
                waiting.clear()
                order = np.lexsort((found, ~score, goal))  # ~ turns the order round without leaving 64 bits
                goal, found, score = goal[order], found[order], score[order]
                first = np.flatnonzero(np.r_[True, goal[1:] != goal[:-1]]) if len(goal) else np.empty(0, np.int64)
                rank = np.arange(len(goal)) - np.repeat(first, np.diff(np.r_[first, len(goal)]))
                full = rank == k - 1
                flat = lo.reshape(-1)
                flat[goal[full]] = np.maximum(flat[goal[full]], score[full].astype(object))
                goal, found, score = goal[rank < k], found[rank < k], score[rank < k]

            for batch in batches:
                for pivot, a, z, own_ids, own_labels, data in zip(*(batch.column(c).to_pylist() for c in ("pivot", "lo", "hi", "ids", "labels", "vectors")), strict=True):
                    d = away[:, pivot]
                    hit = (reach >= 0) & (d - reach <= z) & (d + reach >= a) & ~((seen >= 0) & (d - seen <= z) & (d + seen >= a)) & (d + z >= inner)
                    at = np.flatnonzero(hit)
                    if not len(at):
                        continue
                    some, kinds = np.frombuffer(own_ids, np.int64), np.frombuffer(own_labels, np.int64)
                    scores = _scores(_unpack(data, len(some), dim), v[at])
                    usable = ((kinds[:, None] == labels[at][None, :]) == same) & (some[:, None] != ids[at][None, :])
                    for g in range(slots):
                        below, above = lo[g, at], hi[g, at]
                        if scores.dtype != object:
                            below, above = below.astype(np.float64), above.astype(np.float64)
                        r, c = np.nonzero(usable & (scores >= below).astype(bool) & (scores <= above).astype(bool))
                        if len(r):
                            waiting.append((g * n + at[c], some[r], scores[r, c].astype(np.int64)))
                    if sum(len(x[0]) for x in waiting) > 100_000:
                        merge()
                merge()
            yield pa.RecordBatch.from_arrays([pa.array(goal, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["goal", "id", "score"])

        rows = self.index.blocks.where((F.col("dim") == dim) & near).mapInArrow(search, "goal long, id long, score long")
        top = rows.withColumn("r", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
        for r in top.select("goal", "id", "score").collect():
            self.best[r.goal % len(ids)][r.goal // len(ids)].append((r.score, r.id))
        for own in self.best:
            for found in own:
                found.sort(key=lambda x: (-x[0], x[1]))
                del found[k:]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 3, margin: tuple[float, float] = (0.5, 0.95), id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, anchor_block: int = ANCHOR_BLOCK, pivots: int = PIVOTS, index_block: int = INDEX_BLOCK) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score lies between
    margin[0] and margin[1] times the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); ties go to the smaller id. Anchors are taken in blocks of anchor_block that
    lie together in the index, so a block's key intervals overlap; only a block's anchors and its own answers reach the driver.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, is_anchor, label, id_col=id_col, vector_col=vector_col, scale=scale, pivots=pivots, block=index_block)
    numbered = running_total(index.anchors, "anchors", [], ["dim", "pivot", "key", "id"], "one", "before")
    asked = stage_table(numbered.withColumn("block", F.floor(F.col("before") / anchor_block)).drop("one", "before"), "asked")
    blocks = [r.block for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = new_path(spark, "hard-negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    share = [Fraction(str(m)) for m in margin]
    for b in blocks:
        own = asked.where(F.col("block") == b).select("id", "label", "dim", "v").collect()
        out = []
        for dim in sorted({r.dim for r in own}):
            some = sorted((r for r in own if r.dim == dim), key=lambda r: r.id)
            ids, labels = np.array([r.id for r in some], dtype=np.int64), np.array([r.label for r in some], dtype=np.int64)
            v = np.concatenate([_unpack(bytes(r.v), 1, dim) for r in some])
            near = _Search(index, dim, ids, labels, v, [[(None, None)] for _ in some], positives, same=True)
            near.run()
            windows = [[(math.ceil(share[0] * s), math.floor(share[1] * s)) for s, _ in found[0]] for found in near.best]
            if not any(lo <= hi for w in windows for lo, hi in w):
                continue
            far = _Search(index, dim, ids, labels, v, windows, negatives, same=False)
            far.run()
            for q, anchor in enumerate(ids.tolist()):
                for (score, positive), found in zip(near.best[q][0], far.best[q], strict=True):
                    out += [(anchor, positive, i + 1, negative, score, s) for i, (s, negative) in enumerate(found)]
        if out:
            write_rows(spark, out, schema, path)
    return spark.read.schema(schema).parquet(path)


def write_rows(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
