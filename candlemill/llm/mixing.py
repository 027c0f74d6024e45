"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources share a budget of words by weight, each at most max_epochs times its own size. A source first gives whole
epochs of all its documents; the rest of its target is drawn without replacement, with probabilities that follow the
documents' quality weights: each document gets the exponential key -ln(u) / weight, u from a hash of its id, the
source is ordered by key, and documents are taken while the middle of the next one lies within the budget.

Contract for odd input: a null text counts 0 words; a null source is a source of its own, the last; a null id hashes as
the empty text. Documents without words are never drawn and take 0. Repeated rows are documents of their own. An empty
table gives an empty result. Only the id, text and source columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import WORD, running_total, stage_table

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A cheap quality weight in (0, 1]: 1 / (1 + 20 * the share of characters from the usual signs of broken text)."""
    odd = F.length(text) - F.length(F.translate(text, "#$%&*!|<>{}\\^~=_", ""))
    return F.coalesce(1.0 / (1.0 + 20.0 * odd / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """One row for each source, with its target: min(cap, level * weight), the level such that the targets sum up.

    Giving the excess of capped sources to the others by weight, again and again, ends at this level. It is found in one
    ordered pass: by cap / weight, the first source that the level of those not before it doesn't fill.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("__cap", max_epochs * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    fills = capped.withColumn("__level", level).withColumn("__open", F.col("__level") <= F.col("__cap") / F.col("__w"))
    first = F.min(F.when(F.col("__open"), F.struct((F.col("__cap") / F.col("__w")).alias("fill"), F.col("__level").alias("level")))).over(everything)["level"]
    return fills.withColumn("target", F.least("__cap", F.coalesce(first, F.lit(float("inf"))) * F.col("__w"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs (whole ones of its source), drawn, copies, taken,
    text_hash (xxhash64 of the text).

    quality: weight column over docs, above 0; text_quality of the text if none is given.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        (-F.log(u) / (text_quality(F.col("text")) if quality is None else quality)).alias("__key"),
    )
    sized = stage_table(sized, "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    ordered = running_total(sized, "mix-order", ["source"], ["__key", "doc_id", "size", "text_hash"], "size", "__before")
    goal = targets.select(F.col("source").alias("__source"), "source_size", "target")
    # As many rows as there are sources: every document needs the row of its own. AQE broadcasts it while it is small and splits a hot source otherwise.
    joined = ordered.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("drawn", (F.col("size") > 0) & (2 * F.col("__before") + F.col("size") <= 2 * budget))
        .withColumn("copies", F.col("epochs") + F.col("drawn").cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "drawn", "copies", "taken", "text_hash")
    )
