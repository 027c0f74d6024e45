"""Guards of bundles, and sequences."""

import pytest
from pyspark.sql import functions as F

from candlemill.functions import vectors as V


def test_the_four_guards(spark):
    df = spark.createDataFrame([(8,), (9,)], "n int").select("n", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: V.atom(i.cast("string"), 64)).alias("l"))
    plain = {r.n: r.v for r in df.select("n", V.bundle(F.col("l")).alias("v")).collect()}
    got = {m: {r.n: (r.g.vector, r.g.overflow) for r in df.where("n = 8" if m == "abort" else "true").select("n", V.guarded_bundle(F.col("l"), 64, m).alias("g")).collect()} for m in V.GUARDS}
    assert got["silent"] == {8: (plain[8], False), 9: (plain[9], False)}
    assert got["warn"] == {8: (plain[8], False), 9: (plain[9], True)}
    assert got["error"] == {8: (plain[8], False), 9: (None, True)}
    assert got["abort"] == {8: (plain[8], False)}
    with pytest.raises(Exception, match="9 children exceeds the capacity of 8"):
        df.select(V.guarded_bundle(F.col("l"), 64, "abort").alias("g")).collect()
    with pytest.raises(ValueError):
        V.guarded_bundle(F.col("l"), 64, "loud")


def test_both_sequences_depend_on_the_order(spark):
    df = spark.range(1).select(*(V.atom(F.lit(n), 512).alias(n) for n in "abc"))
    for bundled in (False, True):
        r = df.select(V.sequential(F.array("a", "b", "c"), bundled).alias("x"), V.sequential(F.array("a", "b", "c"), bundled).alias("y"), V.sequential(F.array("b", "a", "c"), bundled).alias("z"), F.col("a")).first()
        assert r.x == r.y and r.x != r.z
        like = sum(p * q for p, q in zip(r.x, r.a, strict=True)) / 512
        assert like > 0.3 if bundled else abs(like) < 0.2  # a bundle resembles its first, a chain nothing
