"""Near-duplicate detection with HyperMinHash sketches, exact in its links.

A document's set holds its distinct shingles of five words. Documents with equal sets form a class, and classes are what
is compared. Each class gets a sketch: its shingles are hashed to buckets, round after round until no bucket is empty,
and a bucket keeps the smallest value of the first round that reached it, compressed to its count of leading zeros and
ten mantissa bits. Bands of five registers propose pairs; the Jaccard estimate of two sketches, corrected for registers
that agree by chance, drops pairs that can't reach the limit; the rest are confirmed on the full sets.

Only connections are needed, not all pairs, so that a group of thousands of near copies costs about as many comparisons
as it has members. Each class names as its hub the class of its buckets that meets most others, in most groups the text
that the others were copied from, and is compared with it on full sets. What is left are pairs in common buckets that
these links don't connect. Let x and y have the hub c. At the limit of 75 % they share at least 3/7 (|x| + |y|) shingles,
of which at most min(|x & c|, |y & c|) lie in c. So they share a known number of shingles outside c, and it is enough to
look for pairs that share one of their rarest ones (a prefix filter on what each class has beyond its hub), among classes
of fitting sizes. Where that number is zero, or the hubs differ, the pairs of a bucket are compared by sketches, inside the
join. Two sets at the limit share no bucket with a probability of 3e-8; nothing else is left out.

Contract for odd input: null and empty texts and texts of white space have an empty set and are linked with nothing. A
row is a document of its own, even with a null or repeated id: its component is the smallest id of the rows that it is
linked with, null if none has one. Texts may be of any length. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.llm.common import bound_batches, stage_table
from candlemill.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, MANTISSA = 64, 5, 10
REGISTERS = BANDS * ROWS
#: Six standard deviations below the limit: the least estimate, and the most parity bits of 320 that may differ.
LEAST_ESTIMATE, MOST_BITS = 0.6, 75
CACHE_WORDS = 300_000
_C = (np.random.default_rng(5).integers(1, 1 << 62, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts, with a bounded memory of word hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: lowers A-Z alone and splits at ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            hashes.append(h)
        w = np.array(hashes, np.uint64)
        k = min(self.size, len(w))
        total = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            total += w[j : len(w) - k + 1 + j] * _C[j]
        return np.unique(_mix(total))


def class_id(shingles: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS compressed registers for each non-empty set."""
    t, n = REGISTERS, len(sets)
    reg = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate(sets) if n else np.empty(0, np.uint64)
    seeds = np.arange(1, 2 * t + 1, dtype=np.uint64) * _C[6]
    for i in range(2 * t):
        z = _mix(h + seeds[i])
        low = z & np.uint64(0xFFFFFFFF)
        # At first each shingle falls into a bucket of its own; the second half of the rounds serves one bucket each, so none stays empty.
        bucket = ((z >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        at, value = doc * t + bucket, (np.uint64(i) << np.uint64(32)) | low
        free = reg[at] > value
        np.minimum.at(reg, at[free], value[free])
        open_docs = (reg.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_docs.any():
            break
        stay = open_docs[doc]
        if not stay.all():
            doc, h = doc[stay], h[stay]
    low = reg & np.uint64(0xFFFFFFFF)
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(32) - exponent
    fraction = ((low << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | fraction).astype(np.uint16).reshape(n, t)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each row of registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C[7], parts.shape[:2]).copy()
    for j in range(ROWS):
        total = _mix(total + parts[:, :, j] * _C[j])
    return total.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from two sketches, corrected for the registers that agree by chance: those whose counts of zeros
    agree, as their distributions have it, and of them one in 2**MANTISSA."""
    za, zb = (np.bincount(x >> MANTISSA, minlength=33) / len(x) for x in (a, b))
    chance = float(za @ zb) / (1 << MANTISSA)
    return max(0.0, (float((a == b).mean()) - chance) / (1.0 - chance))


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls, sketch, text_hash) of each row; the sketch comes with the first row of a class in a task, at least."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                n, cls, sets, owner = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    s = shingler(text or b"")
                    n.append(len(s))
                    cls.append(class_id(s) if len(s) else None)
                    if len(s) and cls[-1] not in seen:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        seen.add(cls[-1])
                        sets.append(s)
                        owner.append(row)
                out: list[bytes | None] = [None] * len(n)
                # Long texts are sketched a few at a time.
                first, size = 0, 0
                for last in range(len(sets)):
                    size += len(sets[last])
                    if size > 1 << 18 or last == len(sets) - 1:
                        for row, r in zip(owner[first : last + 1], sketches(sets[first : last + 1]), strict=True):
                            out[row] = r.tobytes()
                        first, size = last + 1, 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(out, pa.binary()), part.column(2)], ["doc_id", "n", "cls", "sketch", "text_hash"])

    return docs.mapInArrow(compute, "doc_id long, n long, cls long, sketch binary, text_hash long")


def _bands(classes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                registers = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(registers).ravel()), pa.array(np.repeat(np.asarray(part.column(0)), BANDS))], ["key", "cls"])

    return classes.select("cls", "sketch").mapInArrow(explode, "key long, cls long")


def _bitmap_place(ids: np.ndarray, bits: int) -> np.ndarray:
    return _mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of docs whose id is among wanted.doc_id, and a few others: a bitmap of hashed ids, of 64 MB at
    most, keeps the texts that aren't needed out of the shuffle. A full bitmap lets more texts through, never fewer."""
    bits = 1 << 16
    count = wanted.count()
    while bits < 16 * count and bits < 1 << 29:
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 32, np.int64)
        for batch in batches:
            at = _bitmap_place(np.asarray(batch.column(0).drop_null()), bits).astype(np.int64)
            np.bitwise_or.at(words, at >> 5, np.int64(1) << (at & 31))
        hit = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(words[hit])], ["word", "bits"])

    words = np.zeros(bits // 32, np.int64)
    for r in wanted.select("doc_id").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r.word] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(words.astype(np.uint32))

    @pandas_udf("boolean")
    def needed(ids: pd.Series) -> pd.Series:
        at = _bitmap_place(ids.fillna(0).to_numpy(np.int64), bits).astype(np.int64)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1) | ids.isna().reset_index(drop=True)

    return docs.where(needed("doc_id"))


def _sets(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, first_id, sketch, s): the full sets of the known classes, as sorted shingle hashes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [s for s in map(shingler, (t or b"" for t in batch.slice(i, 256).column(0).to_pylist())) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "s"])

    found = _fetch(docs, known.select(F.col("first_id").alias("doc_id"))).select("text").mapInArrow(compute, "cls long, s binary")
    return stage_table(known.join(found.groupBy("cls").agg(F.first("s").alias("s")), "cls"), "near-sets")


def _read(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint64)


def _beyond_hubs(sets: DataFrame, hubs: DataFrame) -> DataFrame:
    """(cls, hub, n, hub_n, inside, rest): a class's size, its hub's, how much they share and what the class has beyond."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            out: list[tuple] = []
            for cls, hub, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != hub:
                    last = [hub, _read(t)]
                mine = _read(s)
                rest = np.setdiff1d(mine, last[1], assume_unique=True)
                out.append((cls, hub, len(mine), len(last[1]), len(mine) - len(rest), rest.view(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64()))], ["cls", "hub", "n", "hub_n", "inside", "rest"])

    own = hubs.join(sets.select("cls", "s"), "cls")
    both = own.join(sets.select(F.col("cls").alias("hub"), F.col("s").alias("t")), "hub").select("cls", "hub", "s", "t")
    return stage_table(both.mapInArrow(compare, "cls long, hub long, n long, hub_n long, inside long, rest array<long>"), "near-beyond")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the limit. The estimate spares the comparison where it can."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, l, s, t in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                good = estimate(np.frombuffer(k, np.uint16), np.frombuffer(l, np.uint16)) >= LEAST_ESTIMATE
                if good:
                    x, y = _read(s), _read(t)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good = 100 * both >= percent * (len(x) + len(y) - both)
                keep.append(good)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("sketch").alias("k"), F.col("s").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("sketch").alias("l"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "k", "l", "x", "y").mapInArrow(compare, "a long, b long")


def _rare_pairs(beyond: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with one hub and different components that share a shingle among the rarest that they have beyond it.

    beyond: (cls, comp, hub, n, inside, rest). Sizes are split into bands; a class looks for partners that are not larger,
    in each band of its hub from which a partner can come, and the least size there tells how much they must share.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.03)))
    least = lambda sizes: F.ceil(sizes * percent / (100 + percent))  # noqa: E731  shingles that two sets at the limit share, by the sum of their sizes
    rows = beyond.withColumn("band", band)
    each = rows.select("cls", "hub", F.explode("rest").alias("h"))
    common = each.groupBy("hub", "h").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(common, ["hub", "h"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("common"))
    ready = stage_table(rows.drop("rest").withColumn("m", F.lit(0)).join(ranked, "cls").join(rows.select("cls", F.size("rest").alias("left")), "cls"), "near-ranked")
    # The first of a class's shingles by frequency: those that no other has (left - size(common) of them), then common.
    first = lambda needed: F.slice("common", 1, F.greatest(F.lit(0), F.col("left") - F.greatest(needed, F.lit(1)) + 1 - (F.col("left") - F.size("common"))).cast("int"))
    index = ready.select("hub", "band", F.col("cls").alias("a"), F.col("comp").alias("a_comp"), F.col("n").alias("a_n"), F.explode(first(least(2 * F.col("n")) - F.col("inside"))).alias("t")).select("hub", "band", "a", "a_comp", "a_n", F.col("t.h").alias("h"))
    bands = ready.groupBy(F.col("hub").alias("b_hub"), F.col("band").alias("b_band")).agg(F.min("n").alias("b_n"), F.max("n").alias("b_most"))
    reach = ready.join(bands, (F.col("hub") == F.col("b_hub")) & (F.col("b_n") <= F.col("n")) & (100 * F.col("b_most") >= percent * F.col("n")))
    probe = reach.select("hub", F.col("b_band").alias("band"), F.col("cls").alias("b"), F.col("comp").alias("b_comp"), F.col("n").alias("b_size"), F.explode(first(least(F.col("b_n") + F.col("n")) - F.col("inside"))).alias("t"))
    probe = probe.select("hub", "band", "b", "b_comp", "b_size", F.col("t.h").alias("h"))
    same = (index["hub"] == probe["hub"]) & (index["band"] == probe["band"]) & (index["h"] == probe["h"]) & (F.col("a_comp") != F.col("b_comp")) & (F.col("a_n") <= F.col("b_size")) & (100 * F.col("a_n") >= percent * F.col("b_size"))
    return index.join(probe, same).select("a", "b").distinct()


def _bits(known: DataFrame) -> DataFrame:
    """(cls, w0 .. w4): the lowest bits of the registers, for comparisons inside a join."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            words = np.packbits((registers & 1).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i].copy()) for i in range(words.shape[1]))], ["cls", *(f"w{i}" for i in range(words.shape[1]))])

    return known.select("cls", "sketch").mapInArrow(pack, "cls long, " + ", ".join(f"w{i} long" for i in range(REGISTERS // 64)))


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, cls, comp) of the buckets that join several components."""
    named = labels.select(F.col("node").alias("cls"), "root")
    rows = shared.join(named, "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key")
    return stage_table(rows.join(mixed, "key"), "near-open")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, text_hash: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id is component_id), and
    on demand text_hash (xxhash64 of the text), which tells rows apart that share an id."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text") if text_hash else F.lit(None).cast("long"))
    rows = stage_table(_sketched(hashed), "near-docs")
    classes = stage_table(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("sketch", ignorenulls=True).alias("sketch")), "near-classes")
    bands = _bands(classes)
    crowded = bands.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("members")).where("low <> high")
    shared = stage_table(bands.join(crowded.select("key", "members"), "key"), "near-shared")
    met = stage_table(shared.groupBy("cls").agg(F.sum(F.col("members") - 1).alias("met")), "near-met")
    known = classes.join(met.select("cls"), "cls", "left_semi")
    seen = shared.select("key", "cls").join(met, "cls")
    centres = seen.groupBy("key").agg(F.max(F.struct("met", "cls")).alias("top"))
    hubs = shared.select("key", "cls").join(centres, "key").groupBy("cls").agg(F.max("top").alias("top")).select("cls", F.col("top.cls").alias("hub"))
    sets = _sets(texts, known)
    beyond = _beyond_hubs(sets, hubs)
    reached = 100 * F.col("inside") >= percent * (F.col("n") + F.col("hub_n") - F.col("inside"))
    links = stage_table(beyond.where(reached & (F.col("cls") != F.col("hub"))).select(F.col("cls").alias("a"), F.col("hub").alias("b")), "near-links")
    labels = components(links)

    rest = _open_buckets(shared.select("key", "cls"), labels)
    if not rest.isEmpty():
        unsure = stage_table(beyond.join(rest.select("cls", "comp").distinct(), "cls"), "near-unsure")
        marked = stage_table(rest.join(_bits(known), "cls").join(unsure.select("cls", "hub", "n", "inside"), "cls"), "near-marked")
        other = marked.select(*(F.col(c).alias(f"o_{c}") for c in marked.columns))
        apart = sum(F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"o_w{i}"))) for i in range(REGISTERS // 64))
        # Pairs of which the shingles beyond the hub tell nothing.
        blind = (F.col("hub") != F.col("o_hub")) | ((100 + percent) * F.least("inside", "o_inside") >= percent * (F.col("n") + F.col("o_n")))
        fits = (100 * F.col("n") >= percent * F.col("o_n")) & (100 * F.col("o_n") >= percent * F.col("n"))
        direct = marked.join(other, (F.col("key") == F.col("o_key")) & (F.col("comp") < F.col("o_comp")) & (apart <= MOST_BITS) & fits & blind).select(F.col("cls").alias("a"), F.col("o_cls").alias("b"))
        found = direct.distinct().unionByName(_rare_pairs(unsure, percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = stage_table(_confirm(stage_table(found, "near-tries"), sets, percent), "near-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = classes.select("cls", "first_id").join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = stage_table(named.join(least, "root").select("cls", "component_id"), "near-components")
    out = rows.select("doc_id", "n", "cls", "text_hash").join(placed, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_hash"] if text_hash else []))
