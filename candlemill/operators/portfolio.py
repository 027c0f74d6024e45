"""A portfolio's account over its trades: equity, a decaying peak, drawdowns, and rolling statistics of the outcomes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the account and of what counts as healthy.
PEAK_DECAY, KEPT_DRAWDOWNS, ROLLING = 0.999, 20, 500
LOOKBACK, RECOVERED, RECENT, DENSITY, LEAST_CORRELATED = 5, 0.005, 50, 20, 20
HEALTHY_DRAWDOWN, HEALTHY_RATE = 0.02, 0.55
TRADES_SCALE, DENSITY_SCALE, FREQUENCY_SCALE = 100.0, 1000.0, 30.0


def net_return(outcome: Column, direction: Column, fee: float, slippage: float) -> Column:
    """Of a trade with both swaps' costs."""
    keep = 1.0 - (fee + slippage)
    return keep * (1 + F.when(direction == "Long", outcome).otherwise(-outcome)) * keep - 1.0


def account(trades: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """trades (sym, i, net, frac): after each, equity, peak (which decays towards the equity), bottom of the drawdown, trades since
    it, and the worst of the last completed drawdowns. The peak feeds back into itself: one pass a portfolio."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        equity = peak = bottom = initial
        since, done, out = 0, [], []
        for net, frac in zip(pdf["net"], pdf["frac"], strict=True):
            equity += equity * frac * net
            if equity > peak:
                if bottom < peak * PEAK_DECAY:
                    done = [*done[-(KEPT_DRAWDOWNS - 1) :], (peak - bottom) / peak]
                peak, bottom, since = equity, equity, 0
            peak = peak * PEAK_DECAY + equity * (1.0 - PEAK_DECAY)
            bottom, since = (equity, 0) if equity < bottom else (bottom, since + 1)
            out.append((equity, peak, bottom, since, max(done, default=0.0)))
        return pdf[["sym", "i", "net"]].assign(**dict(zip(("equity", "peak", "bottom", "since_bottom", "worst"), zip(*out, strict=True), strict=True)))

    return trades.select("sym", "i", "net", "frac").groupBy("sym").applyInPandas(run, "sym string, i long, net double, equity double, peak double, bottom double, since_bottom long, worst double")


def risk_branches(accounts: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """accounts: of account. Drawdown, accuracy, volatility, correlation and panel of a portfolio after each trade."""
    by = Window.partitionBy("sym").orderBy("i")
    last = lambda n: by.rowsBetween(-(n - 1), 0)
    won = (F.col("net") > 0).cast("double")
    over = lambda a, b, other=0.0: F.when(b > 0, a / F.when(b > 0, b)).otherwise(other)
    fall = lambda x: over(F.col("peak") - x, F.col("peak"))
    df = accounts.withColumns({
        "n": F.row_number().over(by), "drawdown": fall(F.col("equity")), "_five": F.lag("equity", LOOKBACK - 1).over(by), "_turn": F.coalesce((F.lag(won).over(by) != won).cast("int"), F.lit(0)),
        **{f"win_{n}": F.avg(won).over(last(n)) for n in (10, 50, 200)}, "win_all": F.avg(won).over(by.rowsBetween(Window.unboundedPreceding, 0)),
        "_m": F.avg("net").over(last(RECENT)), "vol": F.stddev_pop("net").over(last(RECENT)), "_best": F.max("net").over(last(RECENT)), "_least": F.min("net").over(last(RECENT)),
        "_r": F.collect_list("net").over(last(RECENT)), "_w": F.collect_list(2 * won - 1).over(last(RECENT)),
    })
    df = df.withColumn("_run", F.sum("_turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("sym", "_run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_streak", F.count("*").over(run))
    some, calm = F.col("n") >= LOOKBACK, F.col("vol") > 1e-10
    cube = F.aggregate("_r", F.lit(0.0), lambda s, x: s + F.pow((x - F.col("_m")) / F.when(calm, F.col("vol")), F.lit(3))) / F.size("_r")
    mean_w = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x) / F.size("_w")
    df = df.withColumn("_mw", mean_w)
    var_w = 1 - F.col("_mw") * F.col("_mw")
    pairs = F.aggregate(F.sequence(F.lit(1), F.size("_w") - 1), F.lit(0.0), lambda s, k: s + (F.get("_w", k - 1) - F.col("_mw")) * (F.get("_w", k) - F.col("_mw")))
    paired = F.col("n") >= LEAST_CORRELATED
    auto = F.when(paired & (var_w > 1e-10), pairs / ((F.size("_w") - 1) * F.when(var_w > 1e-10, var_w))).otherwise(0.0)
    losing = F.col("net") <= 0
    return df.select(
        "sym", "i", "equity", "peak", "bottom", "since_bottom", "worst", "drawdown",
        F.when(some, F.col("drawdown") - fall(F.col("_five"))).otherwise(0.0).alias("velocity"),
        F.when((F.col("peak") > F.col("bottom")) & (F.col("drawdown") > RECOVERED), F.greatest(F.lit(0.0), F.least(F.lit(1.0), over(F.col("equity") - F.col("bottom"), F.col("peak") - F.col("bottom"))))).otherwise(1.0).alias("recovery"),
        F.when(F.col("worst") > 0.001, F.col("drawdown") / F.when(F.col("worst") > 0.001, F.col("worst"))).otherwise(0.0).alias("historical"),
        "win_10", "win_50", "win_200", "win_all", (F.col("win_10") - F.col("win_50")).alias("trajectory"), (F.col("win_10") - F.col("win_200")).alias("divergence"),
        F.when(some, F.col("vol")).otherwise(0.0).alias("vol"), F.when(some & calm, F.col("_m") / F.when(calm, F.col("vol"))).otherwise(0.0).alias("sharpe"), F.when(some & calm, cube).otherwise(0.0).alias("skew"),
        F.when(some, F.least("_least", F.lit(0.0))).otherwise(0.0).alias("worst_trade"), F.when(some, F.greatest("_best", F.lit(0.0))).otherwise(0.0).alias("best_trade"),
        auto.alias("autocorrelation"), F.when(paired, F.sum(losing.cast("int")).over(last(DENSITY)) / DENSITY).otherwise(0.0).alias("loss_density"),
        F.when(paired & losing, F.least("_streak", F.lit(RECENT))).otherwise(0).cast("long").alias("losses_in_a_row"),
        (F.col("since_bottom") / TRADES_SCALE).alias("duration"), (F.col("n") / DENSITY_SCALE).alias("trade_density"), (F.sqrt(F.col("n").cast("double")) / FREQUENCY_SCALE).alias("trade_frequency"),
        F.when(paired, F.when(F.round(auto, 9) < 0, -1.0).otherwise(1.0)).otherwise(0.0).alias("autocorrelation_sign"),
        (F.col("equity") / initial - 1).alias("gain"), F.when(losing, -F.col("_streak")).otherwise(F.col("_streak")).cast("long").alias("streak"),
        ((F.col("drawdown") < HEALTHY_DRAWDOWN) & (F.col("win_50") > HEALTHY_RATE) & (F.col("_m") > 0)).alias("healthy"),
    )


def position_fraction(df: DataFrame) -> Column:
    """Of equity, from phase (Observe, Tentative, Confident), accuracy, conviction, least and flip: null where nothing is staked."""
    edge = F.greatest(F.col("accuracy") - 0.5, F.lit(0.0))
    sure = F.when(edge < 0.05, 0.005).when(edge < 0.10, 0.01).otherwise(F.least(edge * 0.10, F.lit(0.02)))
    base = F.when(F.col("phase") == "Tentative", 0.005).when(F.col("phase") == "Confident", sure)
    raised = F.when(base.isNotNull(), F.least(base * F.col("conviction") / F.when(F.col("flip") > 0, F.col("flip")), F.lit(0.05)))
    return F.when(F.col("conviction") < F.col("least"), None).when(F.col("flip") <= 0, base).when(F.col("conviction") >= F.col("flip"), raised)
