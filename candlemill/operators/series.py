"""Long series in pieces: row numbers and bounded frames without a task that holds a whole series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that are worked on together.
CHUNK = 16_384


def numbered(df: DataFrame, *, key: str = "sym", order: str = "ts", out: str = "i", total: str | None = None, slot: Column | None = None) -> DataFrame:
    """df with out: the number of rows of the series before this one; and, if named, total: the number of all its rows.

    slot is a whole number that grows with order, by default a month. Slots are sorted and counted on their own; a series'
    slots, one row each, are summed up and added. A null comes first.
    """
    if slot is None:
        slot = F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / (30 * 86_400))
    rows = df.withColumn("_slot", F.coalesce(slot.cast("long"), F.lit(-(2**62))))
    series = Window.partitionBy("_k")
    counts = rows.groupBy(F.col(key).alias("_k"), F.col("_slot").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(series.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumns({"_before": before, "_total": F.sum("_n").over(series)}).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(F.col(order).asc_nulls_first())) - 1
    joined = rows.withColumn("_inside", inside).join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s")))
    return joined.select(*df.columns, (F.col("_inside") + F.col("_before")).alias(out), *([F.col("_total").alias(total)] if total else []))


def copies(df: DataFrame, before: int, after: int = 0, size: int = CHUNK, total: str | None = None) -> DataFrame:
    """Rows numbered by i, each once with own true in its chunk, and again in the chunks whose frames reach it: before rows
    ahead of a chunk and after rows behind it. total: column with the rows of the series, past which there are no chunks."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("i") - after) / size)), F.floor((F.col("i") + before) / size)
    if total:
        last = F.least(last, F.floor((F.col(total) - 1) / size))
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.floor(F.col("i") / size) == F.col("chunk"))


def as_of(rows: DataFrame, events: DataFrame, values: list[str], *, key: str = "sym", at: str = "i", size: int = CHUNK) -> DataFrame:
    """rows with the values of the last event of their series whose place isn't after theirs; null where there is none.

    Places are cut into chunks of size: rows and events of a chunk are merged in order, and what was last before a chunk
    comes from one row a chunk. Of events at one place the one with the largest values counts.
    """
    place = lambda df: F.floor(df[at] / size)
    held = F.struct(*values)
    theirs = events.select(F.col(key), F.col(at), held.alias("_v"), place(events).alias("_c"))
    both = rows.withColumns({"_c": place(rows), "_v": F.lit(None).cast(theirs.schema["_v"].dataType)}).unionByName(theirs.select("*"), allowMissingColumns=True)
    both = both.withColumn("_is", F.col("_v").isNotNull())
    inside = Window.partitionBy(key, "_c").orderBy(F.col(at), F.col("_is").desc(), F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where(~F.col("_is"))
    last = both.groupBy(key, "_c").agg(F.max(F.when(F.col("_is"), F.struct(F.col(at), F.col("_v")))).alias("_l"))
    ever = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col(key).alias("_k"), F.col("_c").alias("_cc"), F.last("_l", ignorenulls=True).over(ever)["_v"].alias("_o"))
    joined = merged.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_cc")))
    got = F.coalesce("_in", "_o")
    return joined.select(*rows.columns, *(got[v].alias(v) for v in values))


def chunked(df: DataFrame, f: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = CHUNK) -> DataFrame:
    """f(df), where f adds columns by frames over (sym, ts) that reach at most before rows back and after rows ahead.

    f sees sym as a pair of series and chunk, so its windows run over chunks: one series of any length is spread over tasks.
    f may drop rows, but must keep sym, own and i.
    """
    pieces = copies(numbered(df, total="_total"), before, after, size, "_total").withColumn("sym", F.struct("sym", "chunk")).drop("chunk", "_total")
    return f(pieces).where("own").withColumn("sym", F.col("sym.sym")).drop("own")
