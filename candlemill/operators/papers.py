"""Papers and positions that follow the price: trailing stops, fixed stops, targets, excursions in both directions.

An entry is walked along its next rows, at most horizon of them. Extremes are running maxima, so every level is a window
over the entry's own rows and an exit is the first row that meets a condition; nothing is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAPER = ("sym", "paper")


def walk(entries: DataFrame, candles: DataFrame, horizon: int) -> DataFrame:
    """entries (sym, paper, opened and any others), candles (sym, at, close): a row for each entry and row from opened to horizon rows later."""
    steps = entries.withColumn("at", F.explode(F.sequence("opened", F.col("opened") + horizon)))
    return steps.join(candles.select("sym", "at", F.col("close").alias("price")), ["sym", "at"])


def _upto() -> Window:
    return Window.partitionBy(*PAPER).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)


def _first(condition: Column) -> Column:
    """The first row of the entry, after that of the entry itself, that meets a condition."""
    return F.min(F.when(condition & (F.col("at") > F.col("opened")), F.col("at"))).over(Window.partitionBy(*PAPER))


def trailing(rows: DataFrame) -> DataFrame:
    """rows: of walk, with direction, entry, trail_distance and stop_distance. The paper's state at each row it lives: extreme,
    trail_level, signaled, and resolved_at and grace of the paper.

    The trail follows the extreme and never falls back behind the entry. A paper is signaled once its extreme is the
    trail's distance away; it leaves at the stop, or, when signaled, at its trail; the stop is tested first.
    """
    sign = F.when(F.col("direction") == "Up", 1.0).otherwise(-1.0)
    best = sign * F.max(sign * F.col("price")).over(_upto())
    df = rows.withColumns({"_s": sign, "extreme": best})
    trail = F.col("_s") * F.greatest(F.col("_s") * F.col("entry"), F.col("_s") * F.col("extreme") - F.col("extreme") * F.col("trail_distance"))
    df = df.withColumns({"trail_level": trail, "signaled": F.col("_s") * F.col("extreme") >= F.col("_s") * F.col("entry") + F.col("entry") * F.col("trail_distance")})
    stopped = F.col("_s") * F.col("price") <= F.col("_s") * F.col("entry") - F.col("entry") * F.col("stop_distance")
    fired = F.col("signaled") & (F.col("_s") * F.col("price") <= F.col("_s") * F.col("trail_level"))
    df = df.withColumns({"_stop": _first(stopped), "_fire": _first(fired)})
    df = df.withColumn("resolved_at", F.least("_stop", "_fire"))
    grace = F.col("resolved_at").isNotNull() & F.max(F.when((F.col("at") <= F.col("resolved_at")) & ~((F.col("at") == F.col("_stop")) & stopped), F.col("signaled"))).over(Window.partitionBy(*PAPER))
    return df.withColumn("grace", F.coalesce(grace, F.lit(False))).where("resolved_at is null or at <= resolved_at").drop("_s", "_stop", "_fire")


def positions(rows: DataFrame, k_stop: float, k_trail: float, k_tp: float) -> DataFrame:
    """rows: of walk, with entry (a rate that rises in the position's favour) and atr (a fraction of it). One row a position: exit
    (StopLoss, TakeProfit or null), exit_at, stop at the exit or the last row, worst return."""
    extreme = F.max("price").over(_upto())
    stop = F.greatest(F.col("entry") * (1 - k_stop * F.col("atr")), F.when(F.col("at") > F.col("opened"), F.max("price").over(_upto()) * (1 - k_trail * F.col("atr"))).otherwise(F.lit(float("-inf"))))
    df = rows.withColumns({"_x": extreme, "_stop": F.max(stop).over(_upto())})
    df = df.withColumns({"_hit": _first(F.col("price") <= F.col("_stop")), "_tp": _first(F.col("price") >= F.col("entry") * (1 + k_tp * F.col("atr")))})
    df = df.withColumn("exit_at", F.least("_hit", "_tp")).where("exit_at is null or at <= exit_at")
    ends = df.groupBy(*PAPER).agg(F.max("exit_at").alias("exit_at"), F.max("_hit").alias("_hit"), F.max_by("_stop", "at").alias("stop"), F.min(F.when(F.col("at") > F.col("opened"), F.col("price") / F.col("entry") - 1)).alias("_worst"))
    exit_ = F.when(F.col("exit_at").isNull(), None).when(F.col("exit_at") == F.col("_hit"), "StopLoss").otherwise("TakeProfit")
    return ends.select(*PAPER, exit_.alias("exit"), "exit_at", "stop", F.least(F.coalesce("_worst", F.lit(0.0)), F.lit(0.0)).alias("max_adverse"))


def excursions(rows: DataFrame, k_stop: float, k_trail: float, k_tp: float) -> DataFrame:
    """rows: of walk, with entry and atr. One row an entry: for buying and for selling the best and the worst move until the side's
    trailing stop or target, and, where both have come, the outcome: Win where buying was better, with the gap as weight."""
    sides = rows.withColumn("side", F.explode(F.array(F.lit("buy"), F.lit("sell")))).withColumn("_s", F.when(F.col("side") == "buy", 1.0).otherwise(-1.0))
    by = Window.partitionBy(*PAPER, "side")
    upto = by.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("at") > F.col("opened")
    far = F.col("_s") * F.max(F.col("_s") * F.col("price")).over(upto)
    level = F.when(after, F.col("_s") * far * (1 - F.col("_s") * k_trail * F.col("atr"))).otherwise(F.col("_s") * F.col("entry") * (1 - F.col("_s") * k_stop * F.col("atr")))
    df = sides.withColumn("_level", F.max(level).over(upto))
    done = after & ((F.col("_s") * F.col("price") <= F.col("_level")) | (F.col("_s") * F.col("price") >= F.col("_s") * F.col("entry") * (1 + F.col("_s") * k_tp * F.col("atr"))))
    df = df.withColumn("_end", F.min(F.when(done, F.col("at"))).over(by)).where("_end is null or at <= _end")
    move = F.col("_s") * (F.col("price") - F.col("entry"))
    each = df.groupBy(*PAPER, "side").agg(F.greatest(F.max(move), F.lit(0.0)).alias("mfe"), F.least(F.min(move), F.lit(0.0)).alias("mae"), F.max(F.col("_end").isNotNull()).alias("done"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    both = each.groupBy(*PAPER).agg(*(of(s, c) for s in ("buy", "sell") for c in ("mfe", "mae", "done")))
    gap = (F.col("buy_mfe") + F.col("buy_mae")) - (F.col("sell_mfe") + F.col("sell_mae"))
    settled = F.col("buy_done") & F.col("sell_done")
    return both.select(*PAPER, "buy_mfe", "buy_mae", "sell_mfe", "sell_mae", F.when(settled, F.when(gap > 0, "Win").otherwise("Loss")).alias("outcome"), F.when(settled, F.greatest(F.abs(gap), F.lit(0.01))).alias("weight"))
