"""Receipts, releases, witnesses, claims and similarity lookups, as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.sources.staging import staged


def issue(forms: DataFrame, form: str = "form") -> DataFrame:
    return forms.withColumn("receipt", F.sha2(F.col(form).cast("binary"), 256))


def verify(receipts: DataFrame, forms: DataFrame) -> DataFrame:
    """receipts (id, receipt), forms (id, form): whether each receipt is that of its form; a missing form isn't."""
    f = issue(forms).select("id", F.col("receipt").alias("again"))
    return receipts.join(f, "id", "left").select("id", F.coalesce(F.col("receipt") == F.col("again"), F.lit(False)).alias("valid"))


def resolve(pointers: DataFrame, depth: int = 16) -> DataFrame:
    """pointers (form, next, terminal): the terminal that a chain of at most depth steps reaches; of several the largest.

    Paths double: a jump goes over 1, 2, 4 ... forms and knows the terminal among them, and those that make up depth + 1
    forms, a chain's own first, are put one behind the other. Chains that have ended are in no join."""
    jump = pointers.groupBy("form", F.when(F.col("terminal").isNull(), F.col("next")).alias("next")).agg(F.max("terminal").alias("terminal"))
    now, left = None, depth + 1
    while left:
        if left % 2:
            now = jump if now is None else _behind(now, jump)
        left //= 2
        if left:
            jump = staged(_behind(jump, jump), "jumps")
    return now.groupBy("form").agg(F.max("terminal").alias("terminal"))


def _behind(first: DataFrame, then: DataFrame) -> DataFrame:
    """Jumps over the forms of first and then over those of then."""
    hop = then.select(F.col("form").alias("h"), F.col("next").alias("h_next"), F.col("terminal").alias("terminal"))
    on = first.where("next is not null").drop("terminal").join(hop, F.col("next") == F.col("h"), "left")
    return first.where("next is null").unionByName(on.select("form", F.col("h_next").alias("next"), "terminal"))


def witnesses(claims: DataFrame, beacons: DataFrame) -> DataFrame:
    """claims (id, name, round, value): every witness of a claim must match its beacon; a claim without witnesses claims nothing."""
    b = beacons.select("name", "round", F.col("value").alias("true_value"))
    j = claims.join(b, ["name", "round"], "left")
    ok = F.coalesce(F.col("value") == F.col("true_value"), F.lit(False))
    g = j.groupBy("id").agg(F.bool_and(F.when(F.col("name").isNotNull(), ok)).alias("ok"))
    return g.select("id", F.when(F.col("ok").isNull(), "no-claim").when(F.col("ok"), "valid").otherwise("invalid").alias("verdict"))


def causal(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """claims (id, claimed_at), anchors (id, publication_time): nothing is older than the latest anchor that it cites."""
    a = anchors.groupBy("id").agg(F.max("publication_time").alias("newest"))
    return claims.join(a, "id", "left").select("id", F.when(F.col("newest").isNull(), "unanchored").when(F.col("claimed_at") >= F.col("newest"), "possible").otherwise("impossible").alias("verdict"))


def first_coincident(stored: DataFrame, query: Column, similarity, floor: float) -> DataFrame:
    """stored (seq, v, terminal): the terminal of the earliest entry within the floor of the query."""
    return stored.where(1 - similarity(F.col("v"), query) < floor).agg(F.min_by("terminal", "seq").alias("terminal"))


def best_match(stored: DataFrame, query: Column, similarity) -> DataFrame:
    s = similarity(F.col("v"), query)
    return stored.agg(F.max_by("terminal", F.struct(s, -F.col("seq"))).alias("terminal"), F.max(s).alias("cosine"))


def top_two(scored: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """The best label of each key and its margin over the second."""
    w = Window.partitionBy(by).orderBy(F.desc(score), label)
    r = scored.withColumns({"place": F.row_number().over(w), "second": F.lead(score).over(w)})
    return r.where("place = 1").select(by, label, (F.col(score) - F.coalesce("second", F.lit(0.0))).alias("margin"))
