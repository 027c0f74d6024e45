"""Fingerprints' draws against a scalar version and the law of collisions; the quality discriminant against dense formulas."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from candlemill.llm import fingerprints, quality
from tests.llm import fixtures


def signed(spark, texts, samples):
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    return {r.id: r.v for r in fingerprints.signatures(df, ["id"], ["v"], [(F.col("text"), [1])], samples).collect()}


def scalar_signature(hashes, weights, samples):
    """Every word drawn in full, no bound: the least ln a of each sample."""
    u = lambda bits, shift: (((bits >> shift) & 0xFFFFFFFF) + 0.5) / 2**32
    out = []
    for k in range(samples):
        best = None
        for w, n in weights.items():
            one, two, three = (x & (2**64 - 1) for x in hashes[w, k])
            r, c, b = -math.log(u(one, 0) * u(one, 32)), -math.log(u(two, 0) * u(two, 32)), u(three, 32)
            t = 0 if n == 1 else math.floor(math.log(n) / r + b)
            a = math.log(c) - r * (t - b + 1)
            if best is None or a < best[0]:
                best = (a, ((three & fingerprints._MASK) ^ t) & fingerprints._MASK)
        out.append(best[1])
    return out


def test_draws_equal_a_scalar_version(spark):
    g = random.Random(1)
    texts = {1: "one two two three three three", 2: "alone", 3: " ".join(g.choice("abcdefghij") * g.randint(1, 2) for _ in range(300)), 4: "x " * 5000 + "y"}
    samples = 64
    words = sorted({w for t in texts.values() for w in t.split()})
    ks = F.array(*(F.lit(k) for k in range(samples)))
    hashed = spark.createDataFrame([(w,) for w in words], "w string").withColumn("h", F.xxhash64("w")).withColumn("k", F.explode(ks))
    rows = hashed.select("w", "k", *(F.xxhash64("h", F.col("k") + i * fingerprints.SECOND).alias(f"x{i}") for i in range(3))).collect()
    hashes = {(r.w, r.k): (r.x0, r.x1, r.x2) for r in rows}
    got = signed(spark, texts, samples)
    for i, text in texts.items():
        assert got[i] == scalar_signature(hashes, Counter(text.split()), samples)


def test_collisions_follow_generalised_jaccard_similarity(spark):
    g = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    pairs = []
    for k in range(12):
        a = Counter({w: g.randint(1, 6) for w in g.sample(vocabulary, 25)})
        b = Counter({w: n + g.choice([-1, 0, 0, 0, 2]) * (k % 3) for w, n in a.items() if g.random() > k / 16})
        b = Counter({w: n for w, n in b.items() if n > 0} | {w: g.randint(1, 4) for w in g.sample(vocabulary, k)})
        pairs.append((a, b))
    texts = {}
    for k, (a, b) in enumerate(pairs):
        texts[2 * k], texts[2 * k + 1] = " ".join(a.elements()), " ".join(b.elements())
    samples = 2048
    got = signed(spark, texts, samples)
    off = []
    for k, (a, b) in enumerate(pairs):
        want = sum((a & b).values()) / sum((a | b).values())
        share = np.mean([x == y for x, y in zip(got[2 * k], got[2 * k + 1], strict=True)])
        off.append((share - want) / math.sqrt(max(want * (1 - want), 1e-4) / samples))
    assert max(map(abs, off)) < 4.5 and abs(np.mean(off)) < 1.5  # standard errors, each and on the whole: a biased sampler shows


def test_the_discriminant_equals_dense_formulas(spark):
    g = np.random.default_rng(4)
    d = len(quality.NAMES)
    x = {0: g.normal(size=(80, d)) @ g.normal(size=(d, d)) * 0.3, 1: g.normal(size=(50, d)) * 0.5 + 0.7}
    sums, products = {c: v.sum(axis=0) for c, v in x.items()}, {c: v.T @ v for c, v in x.items()}
    model = quality.Discriminant({c: len(v) for c, v in x.items()}, sums, products, 0.1, 0.01)
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 130
    densities = []
    new = g.normal(size=(40, d))
    for c in (0, 1):
        cov = 0.9 * np.cov(x[c].T, bias=True) + 0.1 * pooled
        cov = 0.99 * cov + 0.01 * (np.trace(pooled) / d + 1e-6) * np.eye(d)
        away = new - x[c].mean(axis=0)
        densities.append(np.log(len(x[c]) / 130) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    want = 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -700, 700)))
    assert np.allclose(model.score(new), want, rtol=1e-7, atol=1e-12)
    assert np.allclose(quality.Discriminant({1: 5}, {1: x[1][:5].sum(axis=0)}, {1: x[1][:5].T @ x[1][:5]}, 0.1, 0.01).score(new), 1.0)
    assert np.allclose(quality.Discriminant({}, {}, {}, 0.1, 0.01).score(new), 0.5)


def test_quality_of_all_documents_equals_a_fit_in_one_place(spark):
    """The whole query on documents with null ids, repeated ids and odd texts."""
    import zlib

    docs = fixtures.documents(spark)
    data = fixtures.rows()
    marks = [(i, int(i % 2 == 0), 0) for i in range(40)] + [(None, 1, 0), (3, 2, 0), (7777, 1, 0), (100, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(data)
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2
    stats = [(r[0], np.array(quality.statistics((r[1] or "").encode()))) for r in data]
    taught = [(q, x) for i, q, _ in marks if i is not None and q in (0, 1) and not held(i) for j, x in stats if j == i]
    own = {c: np.array([x for q, x in taught if q == c]) for c in (0, 1)}
    model = quality.Discriminant({c: len(v) for c, v in own.items()}, {c: v.sum(axis=0) for c, v in own.items()}, {c: v.T @ v for c, v in own.items()}, quality.TO_POOLED, quality.TO_IDENTITY)
    want = sorted((str(i), float(s)) for (i, _), s in zip(stats, model.score(np.array([x for _, x in stats])), strict=True))
    mine = sorted((str(r.doc_id), r.score) for r in got)
    assert [a[0] for a in mine] == [b[0] for b in want] and np.allclose([a[1] for a in mine], [b[1] for b in want], rtol=1e-6, atol=1e-9)
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in got)
