"""Online learning and lookups by likeness against scalar versions."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import online, retrieval


def low_rank(n, d=20, rank=3, seed=0, noise=0.05):
    g = np.random.default_rng(seed)
    return g.normal(size=(n, rank)) @ g.normal(size=(rank, d)) + noise * g.normal(size=(n, d))


def frame(spark, x, key="a", start=0):
    return spark.createDataFrame(pd.DataFrame({"key": key, "id": np.arange(start, start + len(x)), "v": x.tolist()}), "key string, id long, v array<double>").repartition(3)


def residuals(spark, df, **how):
    return online.subspace_residuals(df, key="key", id_col="id", vector="v", **how).orderBy("key", "id").toPandas()


def test_residuals_fall_to_the_noise_and_jump_at_a_new_direction(spark):
    x = low_rank(300)
    x[250:] += 4 * np.random.default_rng(5).normal(size=20)
    got = residuals(spark, frame(spark, x), ell=12, k=3)["residual"].to_numpy()
    assert np.allclose(got[:24], np.linalg.norm(x[:24], axis=1))  # nothing known yet
    assert np.median(got[150:250]) < 0.1 * np.median(np.linalg.norm(x, axis=1)) and got[250] > 5 * got[150:250].max()


def test_streaming_equals_batch_replay_whatever_the_micro_batches(spark, tmp_path):
    x = low_rank(130, seed=2)
    whole = frame(spark, x).unionByName(frame(spark, low_rank(60, seed=3), "b"))
    want = residuals(spark, whole, ell=8, k=3)
    source, out = tmp_path / "in", tmp_path / "out"
    for lo, hi in ((0, 7), (7, 8), (8, 90), (90, 130)):
        whole.where((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(str(source))
        q = online.stream_residuals(spark.readStream.schema(whole.schema).parquet(str(source)), ell=8, k=3).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()  # a new run each time: the state comes back from the checkpoint
    got = spark.read.parquet(str(out)).orderBy("key", "id").toPandas()[["key", "id", "residual"]]
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=0)


def test_chunks_merge_within_the_bound(spark):
    x, ell = low_rank(640, seed=4, noise=0.3), 10
    one = online.Directions(ell, 3)
    for row in x:
        one.update(row)
    parts = []
    for i in range(0, 640, 80):
        s = online.Directions(ell, 3)
        for row in x[i : i + 80]:
            s.update(row)
        parts.append(s)
    merged = parts[0]
    for s in parts[1:]:
        merged = merged.merge(s)
    for s in (one, merged):
        b = np.array(s.rows)
        gap = np.linalg.eigvalsh(x.T @ x - b.T @ b)
        assert gap.min() > -1e-6 and gap.max() <= s.lost + 1e-6 and s.lost <= (x * x).sum() / ell + 1e-6
    whole = residuals(spark, frame(spark, x), ell=ell, k=3)["residual"].to_numpy()
    cut = residuals(spark, frame(spark, x), ell=ell, k=3, size=80)["residual"].to_numpy()
    assert (cut[:160] == whole[:160]).all()  # the second chunk starts from the whole state of the first
    assert np.abs(cut[160:] - whole[160:]).mean() < 0.1 * np.linalg.norm(x, axis=1).mean()
    assert len(residuals(spark, frame(spark, x[:0]))) == 0


def test_planted_values_come_back_and_ties_go_to_the_first(spark):
    g = np.random.default_rng(8)
    planted = {f"n{k}": v for k, v in enumerate((0.0, 0.013, 0.05, 0.099, 0.1))}
    rows = [(n, float(np.clip(v + 0.004 * g.normal(), 0, 0.1)), "Grace", float(g.integers(0, 3))) for n, v in planted.items() for _ in range(201)]
    rows += [(n, 0.07, "Violence", 50.0) for n in planted] + [("even", 0.02, "Grace", 0.0), ("even", 0.08, "Grace", 0.0), ("n0", None, "Grace", 1.0)]
    df = spark.createDataFrame(rows, "name string, value double, outcome string, weight double")
    for log, lo in ((False, 0.0), (True, 0.001)):
        b = online.accumulate(df, ["name"], F.col("value"), F.col("outcome"), F.col("weight"), lo, 0.1, 512, log)
        got = {r.name: r for r in online.extract(b, ["name"], lo, 0.1, 51, 512, log).collect()}
        for n, v in planted.items():
            assert abs(got[n].value - max(v, lo)) <= 0.0021 and got[n].cosine > 0.9
        d, low = 512, (lambda x: math.floor(min(max((math.log(max(x, 1e-300)) - math.log(lo)) / (math.log(0.1) - math.log(lo)), 0), 1) * 512 + 0.5)) if log else (lambda x: math.floor(min(max(x / 0.1, 0), 1) * 512 + 0.5))
        enc = lambda x: np.where(np.arange(1, d + 1) <= low(x), 1, -1)  # noqa: B023, E731
        for n in (*planted, "even"):
            acc = np.sign(sum((1 + w) * enc(v) for m, v, o, w in rows if m == n and o == "Grace" and v is not None))
            grid = [lo + k * (0.1 - lo) / 50 for k in range(51)]
            scores = [round(float(acc @ enc(v)) / (np.linalg.norm(acc) * math.sqrt(d)), 12) for v in grid]
            assert abs(got[n].value - grid[scores.index(max(scores))]) < 1e-12 and abs(got[n].cosine - max(scores)) < 1e-9


def test_decay_equals_a_sequential_fold(spark):
    g = np.random.default_rng(6)
    n, d, interval, decay = 1500, 6, 70, 0.97
    labels, x = g.integers(0, 3, n), g.normal(size=(n, d))
    x += np.eye(6)[labels] * 1.5
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(n) % 5 == 0, "b", "a"), "id": np.arange(n) * 3, "label": labels, "v": x.tolist()}), "k string, id long, label int, v array<double>").repartition(4)
    got = {r.id: r for r in online.decaying_reckoner(df, key="k", id_col="id", label="label", vector="v", cosine=V.cosine, decay=decay, interval=interval).collect()}
    assert len(got) == n
    hits = 0
    for key in ("a", "b"):
        acc, seen, shown, shown_n, i = {}, {}, None, None, 0
        for t in range(n):
            if (t % 5 == 0) != (key == "b"):
                continue
            if i and i % interval == 0:
                shown, shown_n = {c: v.copy() for c, v in acc.items()}, dict(seen)
            r = got[t * 3]
            if shown is None:
                assert r.guess is None
            else:
                cos = {c: float(x[t] @ v / np.linalg.norm(x[t]) / np.linalg.norm(v)) for c, v in shown.items()}
                order = sorted(cos, key=lambda c: (-cos[c], c))  # noqa: B023
                assert r.guess == order[0] and abs(r.conviction - (cos[order[0]] - cos[order[1]])) < 1e-9 and abs(r.experience - shown_n[order[0]]) < 1e-9
                hits += r.guess == labels[t]
            acc, seen = {c: v * decay for c, v in acc.items()}, {c: w * decay for c, w in seen.items()}
            acc[labels[t]], seen[labels[t]] = acc.get(labels[t], 0) + x[t], seen.get(labels[t], 0) + 1
            i += 1
    assert hits > 700


def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_the_index_finds_nine_tenths_of_the_nearest_and_comparison_finds_all(spark, tmp_path):
    rows = retrieval.entries(embeddings(spark), "vec_id", "embedding")
    asked = rows.where("id % 20 = 0")
    index = retrieval.build_index(rows)
    index.write.parquet(str(tmp_path / "index"))  # kept and read again
    pairs = retrieval.candidates(asked, spark.read.parquet(str(tmp_path / "index")))
    found = {r.query: r.id for r in retrieval.nearest(retrieval.verified(pairs, asked, rows, V.cosine)).collect()}
    exact = {r.query: r.id for r in retrieval.all_pairs_best(asked, rows, block=40).collect()}
    pdf = rows.toPandas().sort_values("id")
    v, ids = np.array(pdf["v"].tolist()), pdf["id"].to_numpy()
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    assert exact == {int(i): int(ids[s[k].argmax()]) for k, i in enumerate(ids) if i % 20 == 0}
    recall = np.mean([found.get(q) == i for q, i in exact.items()])
    assert len(exact) == 100 and recall >= 0.9, recall


def test_lookups_with_copies_ties_and_odd_rows(spark):
    g = np.random.default_rng(12)
    base = g.normal(size=(40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(40)] + [(100 + i, base[7].tolist()) for i in range(300)]  # a group of copies
    rows += [(500, (base[3] * 2).tolist()), (501, (base[3] + 0.01).tolist()), (502, None), (503, [None] * 8), (None, base[1].tolist()), (504, []), (505, [1.0]), (506, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    e = retrieval.entries(df, "vec_id", "embedding")
    assert e.where("id >= 100 and id < 500").count() == 0 and {r.id for r in e.collect()} >= {7, 500, 501, 504, 505, 506}
    asked = e.where("id in (500, 501, 505, 506)")
    pairs = retrieval.candidates(asked, retrieval.build_index(e))
    assert pairs.count() < 4 * 44
    scored = retrieval.verified(pairs, asked, e, V.cosine)
    first = {r.query: r.id for r in retrieval.first_coincident(scored, 0.99).collect()}
    assert first == {500: 3, 501: 3} == {r.query: r.id for r in retrieval.all_pairs_best(asked, e, 0.99).collect()}
    assert {r.query: r.id for r in retrieval.nearest(scored).collect()}[501] in (3, 500)
    assert retrieval.all_pairs_best(e.limit(0), e).count() == 0
