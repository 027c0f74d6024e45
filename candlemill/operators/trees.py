"""Trees in a node table, built and walked a level at a time: as vectors, as canonical text, and flattened to leaves.

A tree is rows (tree, level, node, parent, key): the root has level 0 and no parent; leaves have a value. All trees of a
table are worked on together, so the number of joins is the depth of the deepest, whatever the number of trees or walks.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.functions import vectors as V
from candlemill.sources.staging import staged

#: Nodes at most that a task holds the vectors of; rows at most of a level that is sent to all tasks.
HELD, SENT = 4096, 20_000


def trie(df: DataFrame, tree: Column, number: Column, base: int, depth: int) -> DataFrame:
    """tree, level, node, parent, key, value: the numbers of each tree by their depth lowest digits, the highest first. A node is
    named by its digits; a leaf's value is the smallest of the numbers that share all of them."""
    digits = [F.floor(number / base ** (depth - 1 - k)) % base for k in range(depth)]
    rows = df.select(tree.cast("string").alias("tree"), number.cast("long").alias("value"), F.array(*(d.cast("int") for d in digits)).alias("digits")).where("tree is not null and value is not null")
    name = lambda n: F.array_join(F.slice("digits", F.lit(1), n), ".")
    each = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    nodes = each.select("tree", "level", name(F.col("level")).alias("node"), F.when(F.col("level") > 0, name(F.col("level") - 1)).alias("parent"), F.get("digits", F.col("level") - 1).alias("key"), F.when(F.col("level") == depth, F.col("value")).alias("value"))
    return nodes.groupBy("tree", "level", "node", "parent", "key").agg(F.min("value").alias("value"))


def levels(nodes: DataFrame) -> int:
    """The deepest level."""
    return nodes.agg(F.max("level")).first()[0] or 0


def _bytes(v: Column) -> Column:
    @pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda a: np.asarray(a).astype(np.int8).tobytes())

    return pack(v)


def key_atoms(nodes: DataFrame, depth: int, base: int, d: int) -> np.ndarray:
    """The atoms of all keys by level and digit: one row of them."""
    row = nodes.sparkSession.range(1).select(*(V.atom(F.lit(f"key {level} {key}"), d).alias(f"k{level}_{key}") for level in range(1, depth + 1) for key in range(base))).first()
    return np.array([[row[f"k{level}_{key}"] for key in range(base)] for level in range(1, depth + 1)], dtype=np.int8)


def _bundle(own: np.ndarray, keys: Column, vectors: Column) -> Column:
    """The vector of a node from arrays of its children's keys, whose atoms are own, and vectors: one entry a key at most."""

    @pandas_udf("binary")
    def run(keys: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(keys, vectors, strict=True):
            children = np.array([np.frombuffer(x, np.int8) for x in v], dtype=np.int32)
            out.append(np.sign((children * own[np.asarray(k)]).sum(axis=0)).astype(np.int8).tobytes())
        return pd.Series(out)

    return run(keys, vectors)


def build(nodes: DataFrame, base: int, d: int = 2048) -> DataFrame:
    """nodes with vector (signs as bytes): a leaf's is its value's atom, an inner node's the bundle of its children, each bound to the
    atom of its key and level. base, the number of keys, bounds the children of a node; the width must carry as many.

    Each level is a table in the shared folder, made from the one below."""
    if base > V.capacity(d):
        raise ValueError(f"{base} children exceed what {d} places carry")
    depth = levels(nodes)
    if not depth:
        return nodes.withColumn("vector", _bytes(V.atom(F.concat(F.lit("leaf "), F.col("value").cast("string")), d)))
    atoms = key_atoms(nodes, depth, base, d)
    nodes = staged(nodes, "nodes")
    leaves = nodes.where(F.col("value").isNotNull()).withColumn("vector", _bytes(V.atom(F.concat(F.lit("leaf "), F.col("value").cast("string")), d)))
    leaves = staged(leaves, "leaves")
    made, below = [leaves], leaves.where(F.col("level") == depth)
    for level in range(depth - 1, -1, -1):
        kids = below.groupBy("tree", F.col("parent").alias("node")).agg(F.collect_list("key").alias("_k"), F.collect_list("vector").alias("_v"))
        bundled = kids.select("tree", "node", _bundle(atoms[level], F.col("_k"), F.col("_v")).alias("vector"))
        inner = staged(nodes.where((F.col("level") == level) & F.col("value").isNull()).join(bundled, ["tree", "node"]).select(*nodes.columns, "vector"), "inner")
        made.append(inner)
        below = inner.unionByName(leaves.where(F.col("level") == level))
    return staged(reduce(DataFrame.unionByName, made), "tree")


def walk(queries: DataFrame, built: DataFrame, depth: int, base: int, d: int = 2048) -> DataFrame:
    """queries (query, tree, path: the keys from the root): query, value (of the leaf reached), cosine (of the last step).

    At each level the vector is unbound from the path's key and compared with the children of its node, which name the
    next one: one join and one grouped maximum a level, for all queries together. A path that leaves the tree ends at a null.
    """
    atoms = key_atoms(built, depth, base, d)

    def likeness(level: int):
        @pandas_udf("double")
        def cos(vector: pd.Series, key: pd.Series, child: pd.Series) -> pd.Series:
            x = np.array([np.frombuffer(v, np.int8) for v in vector], dtype=np.float32).reshape(-1, d) * atoms[level][key.to_numpy()]
            y = np.array([np.frombuffer(v, np.int8) for v in child], dtype=np.float32).reshape(-1, d)
            size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1), dtype=np.float64)
            return pd.Series(np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0))

        return cos

    roots = built.where("level = 0").select("tree", "node", "vector", "value")
    now = queries.join(roots, "tree").withColumn("cosine", F.lit(None).cast("double"))
    below = built.where("level > 0").select("tree", F.col("parent").alias("node"), F.col("level").alias("_level"), F.col("node").alias("_node"), F.col("key").alias("_key"), F.col("vector").alias("_v"), F.col("value").alias("_value"))
    for level in range(depth):
        steps = now.where(F.size("path") > level).join(below.where(F.col("_level") == level + 1), ["tree", "node"])
        scored = steps.withColumn("_c", likeness(level)(F.col("vector"), F.col("path")[level], F.col("_v")))
        best = scored.groupBy("query", "tree", "path").agg(F.max(F.struct(F.col("_c").alias("c"), (-F.col("_key")).alias("k"), F.col("_node").alias("node"), F.col("_v").alias("v"), F.col("_value").alias("value"))).alias("b"))
        now = best.select("query", "tree", "path", F.col("b.node").alias("node"), F.col("b.v").alias("vector"), F.col("b.value").alias("value"), F.col("b.c").alias("cosine"))
    return queries.join(now.select("query", "value", "cosine"), "query", "left").select("query", "value", "cosine")


STEPS = "tree string, level int, node long, keys array<int>, values array<long>, cosines array<double>, vector binary"


def _signs(seeds: np.ndarray, d: int) -> np.ndarray:
    """The atoms of names from their hashes: the last round of 64-bit xxHash, which takes in the place."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    places = np.arange(d, dtype=np.uint64) * p1
    out = np.empty((len(seeds), d), dtype=np.int8)
    for lo in range(0, len(seeds), 256):
        h = (seeds[lo : lo + 256].view(np.uint64) + p5 + np.uint64(4))[:, None] ^ places
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[lo : lo + 256] = 1 - 2 * ((h ^ (h >> np.uint64(32))) & np.uint64(1)).astype(np.int8)
    return out


def _pack(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.concatenate([np.packbits(v > 0, axis=1), np.packbits(v < 0, axis=1)], axis=1)]


def _unpack(packed: list[bytes], d: int) -> np.ndarray:
    bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), 2, -1)
    up, down = (np.unpackbits(bits[:, k], axis=1, count=d).astype(np.int8) for k in (0, 1))
    return up - down


def _climb(children: np.ndarray, v: np.ndarray, atoms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """children: sorted numbers of one level, v: their vectors, atoms: of the keys. Of the level above the numbers and vectors, and
    by the key that is asked for the place of the child that a walk goes on to, and its cosine: ties go to the smaller key."""
    base = len(atoms)
    above, first, up = np.unique(children // base, return_index=True, return_inverse=True)
    key = children % base
    made = np.sign(np.add.reduceat(v * atoms[key], first, axis=0, dtype=np.int16)).astype(np.int8)
    along = (made[up] * v).astype(np.float32) @ atoms.T.astype(np.float32)  # whole numbers, so exact
    size = np.sqrt(np.count_nonzero(made, axis=1)[up] * np.count_nonzero(v, axis=1).astype(np.float64))[:, None]
    cosine = np.full((len(above), base, base), -np.inf)
    cosine[up, key] = np.divide(along, size, out=np.zeros(along.shape), where=size > 0)
    place = np.zeros((len(above), base), dtype=np.int64)
    place[up, key] = np.arange(len(children))
    best = cosine.argmax(axis=1)
    return above, made, np.take_along_axis(place, best, axis=1), np.take_along_axis(cosine, best[:, None], axis=1)[:, 0]


def steps(df: DataFrame, tree: Column, number: Column, base: int, depth: int, d: int = 2048) -> DataFrame:
    """tree, level, node, keys, values, cosines: of the inner nodes of trie() of the same arguments, whose vectors are those of
    build(), the key that a walk goes on to by the key it asks for, and above leaves their values and the cosines. A node is the
    number that its digits make. Whole numbers from 0 on.

    Where a walk goes from a node depends on no walk, so it is worked out where the vectors are made: a task makes those of a subtree
    of at most HELD leaves, several levels at once, from the numbers, and hands on the vector of its root alone."""
    if base > V.capacity(d):
        raise ValueError(f"{base} children exceed what {d} places carry")
    high = max(1, int(math.log(HELD + 0.5, base)))
    atoms = key_atoms(df, depth, base, d)
    rows = df.select(tree.cast("string").alias("tree"), number.cast("long").alias("value")).where("tree is not null and value is not null")
    below = rows.groupBy("tree", (F.col("value") % base**depth).alias("node")).agg(F.min("value").alias("value"))
    below = below.withColumn("seed", F.xxhash64(F.lit("s"), F.concat(F.lit("leaf "), F.col("value").cast("string"))))
    out, bottom = [], depth
    while bottom > 0:
        top = max(0, bottom - high)
        groups = below.groupBy("tree", F.floor(F.col("node") / base ** (bottom - top)).alias("_up"))
        made = staged(groups.applyInArrow(_subtrees(atoms, bottom, top, bottom == depth, d), STEPS), "steps")
        out.append(made.drop("vector"))
        below, bottom = made.where(F.col("level") == top).select("tree", "node", "vector"), top
    return reduce(DataFrame.unionByName, out)


def _subtrees(atoms: np.ndarray, bottom: int, top: int, leaves: bool, d: int):
    """The steps of a subtree's levels from bottom, which isn't among them, to top."""
    base = atoms.shape[1]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        at, values = group["node"].to_numpy(), group["value"].to_numpy() if leaves else None
        v = _signs(group["seed"].to_numpy(), d) if leaves else _unpack(group["vector"].to_pylist(), d)
        parts = []
        for level in range(bottom - 1, top - 1, -1):
            children = at
            at, v, place, cosine = _climb(children, v, atoms[level])
            told = leaves and level == bottom - 1
            column = lambda x, kind, told=True: pa.array(list(x) if told else [None] * len(at), pa.list_(kind))  # noqa: B023, E731
            parts.append(pa.table({
                "tree": pa.array([group["tree"][0].as_py()] * len(at), pa.string()), "level": pa.array([level] * len(at), pa.int32()), "node": pa.array(at),
                "keys": column((children[place] % base).astype(np.int32), pa.int32()), "values": column(values[place] if told else (), pa.int64(), told), "cosines": column(cosine, pa.float64(), told),
                "vector": pa.array(_pack(v) if level == top > 0 else [None] * len(at), pa.binary()),
            }))
        return pa.concat_tables(parts)

    return run


def follow(queries: DataFrame, known: DataFrame, depth: int, base: int) -> DataFrame:
    """queries (query, tree, path: the keys from the root), known: of steps(). query, value, cosine as walk() finds them: one join a
    level, of numbers alone. A path that leaves the tree or ends early ends at a null."""
    count = {r.level: r["count"] for r in known.groupBy("level").count().collect()}
    now = queries.select("query", "tree", "path", F.lit(0).cast("long").alias("node"))
    for level in range(depth):
        last = level == depth - 1
        here = known.where(F.col("level") == level).select("tree", "node", "keys", *(["values", "cosines"] if last else []))
        met = now.join(F.broadcast(here) if count.get(level, 0) <= SENT else here, ["tree", "node"], "left")
        asked = F.get("path", F.lit(level))
        now = met.select("query", "tree", "path", (F.col("node") * base + F.get("keys", asked)).alias("node")) if not last else met.select("query", F.get("values", asked).alias("value"), F.get("cosines", asked).alias("cosine"))
    return now


def canonical(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """tree, text: each tree as text, built from the leaves up: a leaf is (leaf value), an inner node (node key child ...) in order
    of keys. Equal trees have equal text. The number of levels comes from the table."""
    own = F.concat(F.lit("(leaf "), F.col("value").cast("string"), F.lit(")")) if text is None else text
    rows = nodes.withColumn("text", F.when(F.col("value").isNotNull(), own))
    below = None
    for level in range(levels(nodes), -1, -1):
        here = rows.where(F.col("level") == level)
        if below is not None:
            kids = below.groupBy("tree", "parent").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("kids"))
            joined = F.concat(F.lit("(node"), F.array_join(F.transform("kids", lambda k: F.concat(F.lit(" "), k["key"].cast("string"), F.lit(" "), k["text"])), ""), F.lit(")"))
            kids = kids.select("tree", F.col("parent").alias("node"), joined.alias("_text"))
            here = here.join(kids, ["tree", "node"], "left").withColumn("text", F.coalesce("text", "_text")).drop("_text")
        below = here
    return below.select("tree", "text")


def flatten(nodes: DataFrame) -> DataFrame:
    """tree, path (the keys from the root), value: the leaves, found from the roots down, a join a level."""
    now = nodes.where("level = 0").select("tree", "node", "value", F.array().cast("array<int>").alias("path"))
    found = [now.where("value is not null")]
    below = nodes.where("level > 0").select("tree", "level", F.col("parent").alias("_at"), F.col("node").alias("_node"), F.col("key").alias("_key"), F.col("value").alias("_value"))
    for level in range(1, levels(nodes) + 1):
        step = below.where(F.col("level") == level).withColumnRenamed("_at", "node").join(now.drop("value"), ["tree", "node"])
        now = step.select("tree", F.col("_node").alias("node"), F.col("_value").alias("value"), F.concat("path", F.array("_key")).alias("path"))
        found.append(now.where("value is not null"))
    return reduce(DataFrame.unionByName, found).select("tree", "path", "value")


_WORDS = re.compile(r"\(leaf (-?\d+)\)|\(node|\)|(-?\d+)")


def parse(text: str) -> list[tuple[tuple[int, ...], int]]:
    """The leaves of a canonical text, as (path, value)."""
    out, path = [], []
    for m in _WORDS.finditer(text):
        if m[2] is not None:  # a key leads to what follows it
            path.append(int(m[2]))
        elif m[1] is not None:
            out.append((tuple(path), int(m[1])))
            path = path[:-1]
        elif m[0] == ")":
            path = path[:-1]
    return out
