"""Journals under damage, releases, traces; trees as vectors, text and leaves."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import journal, trees


def log(spark, n=700):
    return spark.createDataFrame([(i, f"entry {i % 7}" if i % 11 else None) for i in range(n)], "seq long, body string").repartition(3)


def test_a_journal_is_chained_within_blocks_and_by_heads(spark):
    built = {r.seq: r.hash for r in journal.build(log(spark), 64).collect()}
    ends, last = [], ""
    for i in range(700):
        last = f"block {i // 64}" if i % 64 == 0 else last
        last = hashlib.sha256(f"{last}|{i}|{f'entry {i % 7}' if i % 11 else ''}".encode()).hexdigest()
        assert built[i] == last
        if i % 64 == 63 or i == 699:
            ends.append(last)
    head = ""
    for r, end in zip(journal.heads(journal.build(log(spark), 64), 64).orderBy("block").collect(), ends, strict=True):
        head = hashlib.sha256(f"{head}|{end}".encode()).hexdigest()
        assert (r.last, r.head) == (end, head)


def test_every_damage_names_its_place(spark):
    sound = journal.build(log(spark), 64)
    heads = journal.heads(sound, 64)
    faults = lambda j, h=heads: sorted((r.block, r.seq if r.seq is not None else -1, r.fault) for r in journal.audit(j, h, 64).collect())
    assert faults(sound) == []
    assert faults(sound.withColumn("body", F.when(F.col("seq") == 130, "x").otherwise(F.col("body")))) == [(2, 130, "hash")]
    assert faults(sound.where("seq <> 130")) == [(2, -1, "end"), (2, 131, "gap")]
    assert faults(sound.where("seq <> 191")) == [(2, -1, "end")]
    assert faults(sound.where("seq <> 128")) == [(2, -1, "end"), (2, 129, "gap")]
    assert faults(sound.where("seq < 640")) == [(10, -1, "end")]
    assert faults(sound.unionByName(sound.where("seq = 70"))) == [(1, -1, "end"), (1, 70, "again")]
    swapped = sound.withColumn("seq", F.when(F.col("seq") == 5, 6).when(F.col("seq") == 6, 5).otherwise(F.col("seq")))
    assert [f[1:] for f in faults(swapped)] == [(5, "hash"), (6, "hash"), (7, "hash")]
    # a block rewritten from an entry on, with its hashes: it hangs together, but doesn't end as published
    rewritten = journal.build(log(spark).withColumn("body", F.when(F.col("seq") == 200, "x").otherwise(F.col("body"))), 64)
    assert faults(rewritten) == [(3, -1, "end")]
    assert faults(rewritten, journal.heads(rewritten, 64)) == []  # who rewrites the heads as well is told by the last head
    assert heads.orderBy(F.desc("block")).first().head != journal.heads(rewritten, 64).orderBy(F.desc("block")).first().head
    forged = heads.withColumn("last", F.when(F.col("block") == 3, journal.heads(rewritten, 64).where("block = 3").first().last).otherwise(F.col("last")))
    assert faults(rewritten, forged) == [(3, -1, "head")]
    assert faults(sound.limit(0), heads.limit(0)) == []


def test_releases_and_traces(spark):
    rel = spark.createDataFrame([(1, "a", "1", "form"), (2, "a", "2", "other"), (3, "b", "1", "form")], "seq long, name string, version string, form string")
    reg = journal.publish(rel)
    assert {(r.seq, r.name) for r in reg.collect()} == {(3, "b"), (2, "a")}  # of one content the last
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    asked = spark.createDataFrame([(1, h("form"), "form"), (2, h("form"), "forged"), (3, h("none"), "none")], "id long, address string, form string")
    assert {r.id: (r.seq, r.sound) for r in journal.fetch(asked, reg).collect()} == {1: (3, True), 2: (3, False), 3: (None, False)}
    due = spark.createDataFrame([(t, p, f"{t}{p}") for t in "abcd" for p in range(3)], "trace string, place long, form string")
    steps = due.withColumn("receipt", journal.address(F.col("form"))).select("trace", "place", "receipt")
    steps = steps.where("not (trace = 'b' and place = 1)").withColumn("place", F.when((F.col("trace") == "c") & (F.col("place") > 0), 3 - F.col("place")).otherwise(F.col("place")))
    steps = steps.unionByName(spark.createDataFrame([("d", 3, h("d3"))], "trace string, place long, receipt string"))
    assert {r.trace: (r.steps, r.sound, r.first_fault) for r in journal.audit_traces(steps, due).collect()} == {"a": (3, True, None), "b": (2, False, 1), "c": (3, False, 1), "d": (4, False, 3)}


def test_walks_at_depth_eight_equal_a_scalar_walk(spark):
    g = random.Random(3)
    base, depth, d = 6, 8, 2048
    numbers = [(t, g.randrange(base**depth)) for t in ("x", "y") for _ in range(60)]
    df = spark.createDataFrame(numbers, "tree string, n long").repartition(3)
    nodes = trees.trie(df, F.col("tree"), F.col("n"), base, depth)
    built = trees.build(nodes, base, d)
    atoms = trees.key_atoms(nodes, depth, base, d)
    leaf = {r.n: np.array(r.v) for r in df.select("n", V.atom(F.concat(F.lit("leaf "), F.col("n").cast("string")), d).alias("v")).collect()}
    digits = lambda n: [n // base ** (depth - 1 - k) % base for k in range(depth)]

    def vector(tree, prefix):
        own = sorted({tuple(digits(n)) for t, n in numbers if t == tree and digits(n)[: len(prefix)] == prefix})
        if len(prefix) == depth:
            return leaf[sum(x * base ** (depth - 1 - k) for k, x in enumerate(prefix))]
        keys = sorted({o[len(prefix)] for o in own})
        return np.sign(sum(atoms[len(prefix)][k] * vector(tree, [*prefix, k]) for k in keys))

    got = {(r.tree, r.node): np.frombuffer(r.vector, np.int8) for r in built.collect()}
    for tree in ("x", "y"):
        assert (got[tree, ""] == vector(tree, [])).all()
    wrong = next(n for n in range(base**depth) if all(n != m for t, m in numbers if t == "x"))
    asked = spark.createDataFrame([(i, t, digits(n)) for i, (t, n) in enumerate(numbers)] + [(900, "x", digits(wrong)), (901, "none", digits(3)), (902, "x", [])], "query long, tree string, path array<int>")
    found = {r.query: r for r in trees.walk(asked, built, depth, base, d).collect()}
    for i, (_, n) in enumerate(numbers):
        assert found[i].value == n and found[i].cosine > 0.2
    assert len(found) == len(numbers) + 3 and found[901].value is None and found[902].value is None
    assert found[900].value != wrong


def test_texts_are_canonical_and_round_trip(spark):
    numbers = [("a", 5), ("a", 77), ("a", 5), ("b", 77), ("b", 5), ("c", 1), (None, 3), ("a", None)]
    df = spark.createDataFrame(numbers, "tree string, n long")
    for depth in (3, 11):  # whatever the depth
        nodes = trees.trie(df, F.col("tree"), F.col("n"), 10, depth).repartition(4)
        text = {r.tree: r.text for r in trees.canonical(nodes).collect()}
        assert text["a"] == text["b"] != text["c"] and set(text) == {"a", "b", "c"}
        leaves = {}
        for r in trees.flatten(nodes).collect():
            leaves.setdefault(r.tree, []).append((tuple(r.path), r.value))
        assert {t: trees.parse(x) for t, x in text.items()} == {t: sorted(own) for t, own in leaves.items()}
    assert trees.parse("(node 0 (node 1 (leaf 4) 2 (leaf 5)) 3 (leaf 6))") == [((0, 1), 4), ((0, 2), 5), ((3,), 6)]
    assert trees.canonical(nodes.limit(0)).count() == 0
