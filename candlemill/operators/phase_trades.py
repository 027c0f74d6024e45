"""Trades on phase flips: a simpler labeler than the engine's, always in the market, with a sweep of its multiplier, streaks
of extremes, what they cover, and the accumulation of positions under them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLIPS = "sym string, multiplier double, flip long, kind string, start long, `end` long, price double, extreme double"
#: The multipliers and stops of a sweep, the fee of a round trip, the edges of the net residue's buckets.
MULTIPLIERS = (1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0)
STOPS = (0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3)
ROUND_TRIP, EDGES = 0.007, (-0.03, -0.01, 0.0, 0.01, 0.03)
POSITION, ENTRY_FEE, LEAST_ATR = 50.0, 0.0035, 0.01


def flips(closes: np.ndarray, atr: np.ndarray, multiplier: float) -> list[tuple]:
    """(kind, start, end, price, extreme) of each phase that ends: a rising one follows the low until the close is
    multiplier * ATR above it, a falling one the high. The first is rising; rows without an ATR of 0.01 are passed over."""
    sign, extreme, start, out = 1.0, None, 0, []
    for i in np.flatnonzero(atr >= LEAST_ATR):
        c = sign * closes[i]  # a falling phase is a rising one of negated closes
        if extreme is None:
            extreme, start = c, i
            continue
        extreme = min(extreme, c)
        if c > extreme + multiplier * atr[i]:
            out.append(("rising" if sign > 0 else "falling", int(start), int(i), float(closes[i]), float(sign * extreme)))
            sign, start = -sign, i
            extreme = -c
    return out


def sweep(folded: DataFrame, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """Completed phases for every series and multiplier: each pair is a group of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        m = float(pdf["multiplier"].iloc[0])
        found = flips(pdf["close"].to_numpy(float), pdf["atr"].fillna(0.0).to_numpy(float), m)
        out = pd.DataFrame(found, columns=["kind", "start", "end", "price", "extreme"])
        return out.assign(sym=pdf["sym"].iloc[0], multiplier=m, flip=range(1, len(out) + 1))[["sym", "multiplier", "flip", "kind", "start", "end", "price", "extreme"]]

    runs = folded.select("sym", "ts", "close", "atr").withColumn("multiplier", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))))
    return runs.groupBy("sym", "multiplier").applyInPandas(run, FLIPS)


def flip_trades(found: DataFrame) -> DataFrame:
    """A trade from each flip to the next: short after a rising phase, long after a falling one."""
    by = Window.partitionBy("sym", "multiplier").orderBy("flip")
    t = found.withColumns({"exit": F.lead("price").over(by), "left": F.lead("end").over(by)}).where("exit is not null")
    move = (F.col("exit") - F.col("price")) / F.when(F.col("price") != 0, F.col("price"))
    t = t.withColumn("direction", F.when(F.col("kind") == "rising", "short").otherwise("long"))
    t = t.withColumn("residue", F.when(F.col("direction") == "long", move).otherwise(-move)).withColumn("net", F.col("residue") - ROUND_TRIP)
    return t.select("sym", "multiplier", "flip", "direction", F.col("price").alias("entry"), "exit", "residue", "net", (F.col("left") - F.col("end")).alias("held"))


def trade_summary(trades: DataFrame, *by: str) -> DataFrame:
    share = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return trades.groupBy("sym", "multiplier", *by).agg(F.count("*").alias("trades"), share("residue").alias("gross_rate"), share("net").alias("net_rate"), F.avg("held").alias("held"), F.avg("residue").alias("residue"), F.avg("net").alias("net"), F.sum("net").alias("total"))


def bucket(net: Column) -> Column:
    """0 to 5: below -3 %, -1 %, 0, 1 %, 3 %, and above; an edge belongs to the bucket above it."""
    return sum(((net >= e).cast("int") for e in EDGES), F.lit(0))


def runs_of_extremes(found: DataFrame) -> DataFrame:
    """found with beaten: how many phases of a kind in a row, up to this one, beat the one before: lows higher, highs lower."""
    by = Window.partitionBy("sym", "multiplier", "kind").orderBy("flip")
    gain = F.when(F.col("kind") == "rising", F.col("extreme") > F.lag("extreme").over(by)).otherwise(F.col("extreme") < F.lag("extreme").over(by))
    marked = found.withColumn("beats", F.coalesce(gain, F.lit(False)).cast("int"))
    marked = marked.withColumn("island", F.sum(1 - F.col("beats")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("sym", "multiplier", "kind", "island").orderBy("flip").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("beaten", F.sum("beats").over(within)).drop("beats")


def streaks(found: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least this many comparisons: their length in phases, first and last phase."""
    runs = runs_of_extremes(found).groupBy("sym", "multiplier", "kind", "island").agg(F.max("beaten").alias("n"), F.min("flip").alias("first"), F.max("flip").alias("last"))
    return runs.where(F.col("n") >= least).select("sym", "multiplier", "kind", (F.col("n") + 1).alias("length"), "first", "last")


def covered(found: DataFrame, least: int = 2) -> DataFrame:
    """(sym, multiplier, side, row): rows of the phases at which a streak holds and of the phases after those; buy by rising ones."""
    by = Window.partitionBy("sym", "multiplier").orderBy("flip")
    held = runs_of_extremes(found).withColumns({"n_start": F.lead("start").over(by), "n_end": F.lead("end").over(by)}).where(F.col("beaten") >= least)
    spans = F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b")), F.struct(F.col("n_start").alias("a"), F.col("n_end").alias("b")))
    each = held.select("sym", "multiplier", F.when(F.col("kind") == "rising", "buy").otherwise("sell").alias("side"), F.explode(spans).alias("s")).where("s.a is not null")
    return each.select("sym", "multiplier", "side", F.explode(F.sequence("s.a", "s.b")).alias("row")).distinct()


def coverage(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """rows: of covered; lengths (sym, total): rows of buy and sell, of either and both, and of neither."""
    sides = rows.groupBy("sym", "multiplier", "row").agg(F.max((F.col("side") == "buy").cast("int")).alias("b"), F.max((F.col("side") == "sell").cast("int")).alias("s"))
    n = sides.groupBy("sym", "multiplier").agg(F.sum("b").alias("buy"), F.sum("s").alias("sell"), F.count("*").alias("either"), F.sum(F.col("b") * F.col("s")).alias("both"))
    return n.join(lengths, "sym").select("sym", "multiplier", "buy", "sell", "either", "both", (F.col("total") - F.col("either")).alias("neither"))


def coverage_runs(rows: DataFrame) -> DataFrame:
    """Continuous runs of covered rows: their number, mean, upper median, longest and shortest."""
    by = Window.partitionBy("sym", "multiplier", "side").orderBy("row")
    runs = rows.withColumn("island", F.col("row") - F.row_number().over(by)).groupBy("sym", "multiplier", "side", "island").agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list("n"))
    out = runs.groupBy("sym", "multiplier", "side").agg(F.count("*").alias("runs"), F.avg("n").alias("mean"), sorted_.alias("l"), F.max("n").alias("longest"), F.min("n").alias("shortest"))
    return out.withColumn("median", F.get("l", F.floor(F.size("l") / 2).cast("int"))).drop("l")


def positions(found: DataFrame, candles: DataFrame) -> DataFrame:
    """(sym, side, at, price): a position is entered at every row from the end of a phase at which a streak of two holds until
    the end of the next phase of the kind, or the last row. found: of one multiplier; candles (sym, at, close)."""
    by = Window.partitionBy("sym", "kind").orderBy("flip")
    last = candles.groupBy("sym").agg(F.max("at").alias("last"))
    active = runs_of_extremes(found).withColumn("until", F.lead("end").over(by)).where("beaten >= 2").join(last, "sym")
    rows = active.select("sym", F.when(F.col("kind") == "rising", "long").otherwise("short").alias("side"), F.explode(F.sequence("end", F.coalesce("until", "last"))).alias("at")).distinct()
    return rows.join(candles.select("sym", "at", F.col("close").alias("price")), ["sym", "at"])


def breaks(found: DataFrame) -> DataFrame:
    """(sym, side, at): rows that end a phase whose low isn't above (whose high isn't below) that of the one before of its kind."""
    by = Window.partitionBy("sym", "kind").orderBy("flip")
    before = F.lag("extreme").over(by)
    broken = F.when(F.col("kind") == "rising", F.col("extreme") <= before).otherwise(F.col("extreme") >= before)
    return found.withColumn("broken", broken).where("broken").select("sym", F.when(F.col("kind") == "rising", "long").otherwise("short").alias("side"), F.col("end").alias("at"))


def accumulate(entered: DataFrame, broken: DataFrame, candles: DataFrame, stops: tuple[float, ...] = STOPS) -> DataFrame:
    """What becomes of the positions under each stop: (sym, stop, grace, stopped, held, open, deployed, recovered, residue, lost, fees, worth).

    From the row after its entry on a position leaves at the first row that reaches its stop, or else at a break that
    leaves something beyond principal and fee; breaks that don't are held through. Every series, stop and side is a
    group, walked once with its open positions in sorted prices: a row closes a range of them.
    """
    events = candles.select("sym", "at", "close", "high", "low").join(entered.groupBy("sym", "at").agg(F.max((F.col("side") == "long").cast("int")).alias("buy"), F.max((F.col("side") == "short").cast("int")).alias("sell")), ["sym", "at"], "left")
    events = events.join(broken.groupBy("sym", "at").agg(F.max((F.col("side") == "long").cast("int")).alias("buy_break"), F.max((F.col("side") == "short").cast("int")).alias("sell_break")), ["sym", "at"], "left").na.fill(0, ["buy", "sell", "buy_break", "sell_break"])
    runs = events.withColumn("stop", F.explode(F.array(*(F.lit(float(s)) for s in stops)))).withColumn("side", F.explode(F.array(F.lit("long"), F.lit("short"))))
    names = ["grace", "stopped", "held", "open", "deployed", "recovered", "residue", "lost", "fees", "worth"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        stop, is_long = float(pdf["stop"].iloc[0]), pdf["side"].iloc[0] == "long"
        enter, leave = (pdf[c].to_numpy(bool) for c in (("buy", "buy_break") if is_long else ("sell", "sell_break")))
        close, edge = pdf["close"].to_numpy(float), pdf["low" if is_long else "high"].to_numpy(float)
        ratio = (1.0 - stop) if is_long else 1.0 / (1.0 + stop)  # of its value, what a position is worth at its stop
        fee = POSITION * ENTRY_FEE
        at_stop = POSITION * ratio * (1.0 - ENTRY_FEE)
        open_, t = np.empty(0), dict.fromkeys(names, 0.0)
        for i in range(len(close)):
            hit = edge[i] <= open_ * (1.0 - stop) if is_long else edge[i] >= open_ * (1.0 + stop)
            n = int(hit.sum())
            t["stopped"] += n
            t["recovered"] += n * at_stop
            t["lost"] += n * (POSITION + fee - at_stop)
            t["fees"] += n * POSITION * ratio * ENTRY_FEE
            open_ = open_[~hit]
            if leave[i] and len(open_):
                rest = POSITION * (close[i] / open_ if is_long else open_ / close[i]) - POSITION - fee
                good = rest > 0
                k = int(good.sum())
                t["grace"] += k
                t["held"] += len(open_) - k
                t["recovered"] += k * POSITION
                t["residue"] += float(rest[good].sum())
                t["fees"] += k * fee
                open_ = open_[~good]
            if enter[i]:
                open_ = np.append(open_, close[i])
                t["deployed"] += POSITION + fee
                t["fees"] += fee
        t["open"] = float(len(open_))
        t["worth"] = float((POSITION * (close[-1] / open_ if is_long else open_ / close[-1])).sum())
        return pd.DataFrame([{"sym": pdf["sym"].iloc[0], "stop": stop} | t])

    each = runs.groupBy("sym", "stop", "side").applyInPandas(run, "sym string, stop double, " + ", ".join(f"{n} double" for n in names))
    counts = [F.sum(n).cast("long").alias(n) for n in names[:4]]
    return each.groupBy("sym", "stop").agg(*counts, *(F.sum(n).alias(n) for n in names[4:])).withColumn("net", F.col("recovered") + F.col("residue") - F.col("deployed") + F.col("worth"))
