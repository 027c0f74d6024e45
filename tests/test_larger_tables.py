"""What shows only on larger tables, in small: chains of full length, nearest rows, walks and services."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import provenance, retrieval, treasury, trees
from candlemill.plans import load
from candlemill.sources import staging


def test_a_chain_is_followed_for_exactly_as_many_steps_as_asked(spark):
    rows = [(i, i + 1, None) for i in range(20)] + [(20, None, 7)]
    rows += [(30, 31, 5), (31, None, 9)]  # a terminal ends its chain, whatever comes next
    rows += [(40, 41, None), (41, 40, None), (50, 99, None), (60, None, 1), (60, None, 3), (61, 60, None), (None, None, None)]  # a loop, a loose end, two of one form
    df = spark.createDataFrame(rows, "form long, next long, terminal long").repartition(3)
    for depth in (0, 1, 5, 16, 17):
        got = {r.form: r.terminal for r in provenance.resolve(df, depth).collect()}
        want = {i: 7 if 20 - i <= depth else None for i in range(21)} | {30: 5, 31: 9, 40: None, 41: None, 50: None, 60: 3, 61: 3 if depth else None, None: None}
        assert got == want, depth


def test_nearest_rows_by_cells_equal_comparison_without_pairs(spark):
    by_index = load()[0]["nearest_by_index"](spark, "/root/testdata/sf0.1")
    exact = load()[0]["nearest_by_comparison"](spark, "/root/testdata/sf0.1")
    assert sorted(by_index.collect()) == sorted(exact.collect())  # a table this small is seen whole
    assert "Join" not in by_index._jdf.queryExecution().toString()  # no row for each pair


def test_cells_with_copies_ties_and_odd_rows(spark):
    g = np.random.default_rng(12)
    base = g.normal(size=(40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(40)] + [(100 + i, base[7].tolist()) for i in range(300)]  # a group of copies
    rows += [(1000 + i, (base[9] * (i + 2)).tolist()) for i in range(200)]  # all as like each other as can be
    rows += [(500, (base[3] * 2).tolist()), (501, (base[3] + 0.01).tolist()), (502, None), (503, [None] * 8), (None, base[1].tolist()), (504, []), (505, [1.0]), (506, [0.0] * 8), (507, [1.0, 2.0]), (508, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    e = retrieval.entries(df, "vec_id", "embedding")
    pairs = e.select(F.col("id").alias("query"), F.size("v").alias("d")).join(e.select("id", F.size("v").alias("d")), "d").select("query", "id").where("query <> id and d > 0")
    exact = {r.query: (r.id, r.cosine) for r in retrieval.nearest(retrieval.verified(pairs, e, e, V.cosine)).collect()}
    for cells, fitted in ((256, 4096), (3, 20)):
        c = retrieval.centres(retrieval.valid(df, "vec_id", "embedding"), cells, fitted)
        index = retrieval.build_cells(e, c)
        assert index.count() == e.count() - 1  # the empty vector
        for block in (8192, 60):
            got = {r.query: (r.id, r.cosine) for r in retrieval.search_cells(e, index, c, block=block).collect()}
            assert got == exact and 505 not in got  # to the last bit, so ties go to the smaller id
    assert retrieval.search_cells(e.limit(0), index, c).count() == 0
    nothing = retrieval.build_cells(e.limit(0), {})
    assert retrieval.search_cells(e, nothing, {}).count() == 0


def test_half_of_the_cells_hold_nine_tenths_of_the_nearest(spark):
    v = np.random.default_rng(5).normal(size=(6000, 64))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "v": v.tolist()}), "id long, v array<double>").repartition(5)
    c = retrieval.centres(df)
    index = retrieval.build_cells(df, c)
    asked = df.where("id % 20 = 0")
    exact = {r.query: r.id for r in retrieval.search_cells(asked, index, c).collect()}
    found = {r.query: r.id for r in retrieval.search_cells(asked, index, c, least=1).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -2
    assert exact == {20 * k: int(i) for k, i in enumerate(s.argmax(axis=1))}
    assert len(found) == 300 and 0.9 <= np.mean([found[q] == i for q, i in exact.items()]) < 1


@pytest.mark.parametrize(("base", "depth", "held"), [(6, 4, 4096), (6, 4, 40), (3, 5, 9)])
def test_steps_lead_where_walks_through_the_vectors_lead(spark, monkeypatch, base, depth, held):
    monkeypatch.setattr(trees, "HELD", held)  # so many levels in a task
    g, d = random.Random(base), 512
    numbers = [(t, g.randrange(base**depth)) for t in ("x", "y", None) for _ in range(40)] + [("x", base**depth + 5), ("x", 5), ("z", 7), ("y", None)]
    df = spark.createDataFrame(numbers, "tree string, n long").repartition(3)
    digits = lambda n: [n // base ** (depth - 1 - k) % base for k in range(depth)]
    paths = [(t, digits(n)) for t, n in numbers if n is not None] + [(t, digits(g.randrange(base**depth))) for t in "xyz" for _ in range(60)]  # most of the last leave the tree
    paths += [("none", digits(1)), ("x", []), ("x", [0]), ("x", digits(5) + [1]), ("x", None)]
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(paths)], "query long, tree string, path array<int>")
    known = trees.steps(df, F.col("tree"), F.col("n"), base, depth, d)
    assert "vector" not in known.columns
    got = {r.query: (r.value, r.cosine) for r in trees.follow(asked, known, depth, base).collect()}
    built = trees.build(trees.trie(df, F.col("tree"), F.col("n"), base, depth), base, d)
    want = {r.query: (r.value, r.cosine) for r in trees.walk(asked.where("path is not null"), built, depth, base, d).collect()}
    assert got == want | {len(paths) - 1: (None, None)}
    assert {got[i] for i in range(len(paths) - 5, len(paths)) if i != len(paths) - 2} == {(None, None)} and got[len(paths) - 2][0] == 5


def test_walks_leave_no_vector_of_each_node_on_disk(spark):
    folder = Path(staging.new_folder(spark, "x").removeprefix("file:")).parent
    used = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = used()
    walks = load()[0]["tree_walks"](spark, "/root/testdata/sf0.01")
    assert walks.where("like_it and query = value").count() == 1500
    assert used() - before < 1_000_000  # a vector takes 2,048 bytes, and there are more nodes than customers


def served(rows, balances, fee=0.0035):
    """The service one request after another."""
    out, state = {}, {}
    for r in rows.sort_values("event_id").itertuples():
        papers, record, left, reals = state.setdefault(r.treasury, ({}, {}, dict(balances), []))
        issued = amount = residue = states = None
        own = record.get(r.owner, [0, 0, 0])
        if r.kind == "Tick":
            for p in papers.values() if r.candle >= 288 else ():
                if p["state"] == "Active":
                    p["state"] = "Violence"
                    record[p["owner"]][2] += 1
            continue
        if r.kind == "SubmitPaper":
            issued, amount = len(papers) + 1, 10_000.0
            papers[issued] = {"owner": r.owner, "units": 10_000 * (1 - fee) / r.price if r.price > 0 else 0.0, "state": "Active"}
            record.setdefault(r.owner, [0, 0, 0])[0] += 1
        elif r.kind == "SubmitReal" and own[0] >= 50 and own[1] > own[2] and left.get(r.asset, 0) > 0:
            amount = min(50.0, left[r.asset])
            left[r.asset] -= amount
            reals.append(r.event_id)
            issued = len(reals)
        elif r.kind == "SubmitExit" and papers.get(r.paper_id, {}).get("state") == "Active":
            p = papers[r.paper_id]
            gain = p["units"] * r.price - 10_000 - p["units"] * r.price * fee
            if gain > 0:
                residue, p["state"] = gain, "Grace"
                record[p["owner"]][1] += 1
        elif r.kind == "BatchGetPaperStates":
            states = ",".join(f"{i}:{papers[i]['state'] if i in papers else 'None'}" for i in r.paper_ids)
        out[r.event_id] = (r.treasury, r.owner, r.kind, issued, amount, residue, states)
    return out


@pytest.mark.parametrize("span", [65_536, 50])
def test_a_service_in_pieces_equals_one_request_after_another(spark, monkeypatch, span):
    monkeypatch.setattr(treasury, "SPAN", span)
    g = random.Random(span)
    n, rows = 3000, []
    for e in g.sample(range(20_000), n):
        kind = g.choices(["SubmitPaper", "SubmitExit", "SubmitReal", "BatchGetPaperStates", "Tick", "Other"], [50, 35, 8, 5, 1, 1])[0]
        price = g.choice([0.0, None, float("nan")]) if g.random() < 0.02 else g.uniform(80, 90) * (1 + e / 10_000)
        ids = g.sample(range(1, 700), g.randrange(4)) + [3, 3]
        rows.append((g.choice([1, 1, 1, 2, 3]), e, g.randrange(3), kind, g.choice([0, 287]) if e < 9000 else 288, price, g.choice(["USDC", "WBTC", "ETH"]), g.randrange(1, 700), ids[: g.randrange(6)]))
    names = ["treasury", "event_id", "owner", "kind", "candle", "price", "asset", "paper_id", "paper_ids"]
    df = spark.createDataFrame(rows, "treasury long, event_id long, owner long, kind string, candle long, price double, asset string, paper_id long, paper_ids array<long>").repartition(5)
    want = served(pd.DataFrame(rows, columns=names), {"USDC": 420.0, "WBTC": 110.0, "DAI": 1.0})
    answer = treasury.serve(df, {"USDC": 420.0, "WBTC": 110.0, "DAI": 1.0})
    found = answer.collect()
    assert len(found) == len(want) and {r.event_id: (r.treasury, r.owner, r.kind, r.issued, r.amount, r.residue, r.states) for r in found} == want
    assert sum(w[5] is not None for w in want.values()) > 50 and sum(w[2] == "SubmitReal" and w[3] is not None for w in want.values()) > 5 and all(any(s in (w[6] or "") for w in want.values()) for s in ("Violence", "Grace", "Active", "None"))
    assert "FlatMapGroups" not in answer._jdf.queryExecution().toString()  # no task holds a treasury
    assert treasury.serve(df, {}).where("kind = 'SubmitReal' and issued is not null").count() == 0
    assert treasury.serve(df.limit(0), {"USDC": 1.0}).count() == 0
