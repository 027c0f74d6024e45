"""Nested forms: text, facts and vectors against scalar recursions."""

import random

import numpy as np
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import forms

SCHEMA = "form string, node string, parent string, place int, kind string, name string, args array<double>"
D = 64


def grow(g, depth):
    if not depth or g.random() < 0.25:
        kind = g.choice(["atom", "linear", "log", "circular", "thermometer"])
        args = {"atom": [], "linear": [g.uniform(-3, 3), 4.0], "log": [g.choice([0.001, 5.0, 70.0])], "circular": [float(g.randrange(24)), 24.0], "thermometer": [g.random(), 0.0, 1.0]}[kind]
        return (kind, f"n{g.randrange(5)}" if kind == "atom" else None, args, [])
    kind = g.choice(["bundle", "sequential", "bind", "permute"])
    return (kind, None, [float(g.randrange(1, 9))] if kind == "permute" else [], [grow(g, depth - 1) for _ in range({"bind": 2, "permute": 1}.get(kind, g.randrange(1, 4)))])


def rows(form, tree, node="r", parent=None, place=0):
    kind, name, args, kids = tree
    out = [(form, node, parent, place, kind, name, args)]
    for i, kid in enumerate(kids):
        out += rows(form, kid, f"{node}.{i}", node, i)
    return out


def digits(x):
    return f"{x:.4f}".rstrip("0").rstrip(".") if "." in f"{x:.4f}" else f"{x:.4f}"


def edn(tree, depth=0):
    kind, name, args, kids = tree
    pad = "\n" + "  " * (depth + 1)
    if kind == "atom":
        return f'(atom "{name}")'
    if not kids:
        return f"({kind} {' '.join(map(digits, args))})"
    return f"({kind}" + "".join(pad + edn(k, depth + 1) for k in kids) + (pad + digits(args[0]) if kind == "permute" else "") + ")"


def facts(tree):
    if tree[0] in ("bundle", "sequential"):
        return [f for k in tree[3] for f in facts(k)]
    return [] if tree[0] == "atom" else [edn(tree)]


def vector(tree, leaf):
    kind, _, args, kids = tree
    own = [vector(k, leaf) for k in kids]
    if not kids:
        return leaf(tree)
    if kind == "bind":
        return own[0] * own[1]
    if kind == "permute":
        return np.roll(own[0], int(args[0]))
    return np.sign(sum(np.roll(v, i) if kind == "sequential" else v for i, v in enumerate(own)))


def test_texts_facts_and_vectors_equal_scalar_recursions(spark):
    g = random.Random(5)
    trees = {f"f{i}": grow(g, 4) for i in range(12)} | {"deep": ("bundle", None, [], [("log", None, [2.0], [])])}
    for _ in range(5):  # deeper than the others
        trees["deep"] = ("sequential", None, [], [trees["deep"], ("atom", "x", [], [])])
    trees["same"] = trees["f3"]
    nodes = spark.createDataFrame([r for f, t in trees.items() for r in rows(f, t)] + [("lost", "a", "nowhere", 0, "atom", "x", [])], SCHEMA).repartition(4)
    text = {r.form: r.text for r in forms.to_edn(nodes).collect()}
    assert text == {f: edn(t) for f, t in trees.items()} and text["same"] == text["f3"]
    found = {}
    for r in forms.collect_facts(nodes).collect():
        found.setdefault(r.form, []).append(r.text)
    assert {f: sorted(x) for f, x in found.items()} == {f: sorted(facts(t)) for f, t in trees.items() if facts(t)}

    levels, n = forms.leveled(nodes)
    assert n >= 7
    made = {(r.form, r.node): np.array(r.vector) for r in forms.vectors(levels, n, D).collect()}
    names = {r.n: np.array(r.v) for r in spark.createDataFrame([(f"n{i}",) for i in range(5)] + [("x",)], "n string").select("n", V.atom(F.col("n"), D).alias("v")).collect()}
    for f, t in trees.items():
        flat = {r[1]: r for r in rows(f, t)}
        leaf_at = {id_: made[f, id_] for id_ in flat}
        for id_, r in flat.items():
            if r[4] == "atom":
                assert (leaf_at[id_] == names[r[5]]).all()

        def walk(node, tree):
            kids = [walk(f"{node}.{i}", k) for i, k in enumerate(tree[3])]
            want = vector((tree[0], tree[1], tree[2], [("v", None, i, []) for i in range(len(kids))]), lambda leaf: kids[leaf[2]]) if kids else leaf_at[node]  # noqa: B023
            assert (leaf_at[node] == want).all()  # noqa: B023
            return want

        walk("r", t)
    p = {(r.form, r.node): r.presence for r in forms.presence(nodes, D).collect()}
    for (f, node), cos in p.items():
        a, b = made[f, node] if D == len(made[f, node]) else None, made[f, "r"]
        assert abs(cos - (float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0.0)) < 1e-9
    assert forms.to_edn(nodes.limit(0)).count() == 0
