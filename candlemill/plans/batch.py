"""Queries of the batch builder's columns and facts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.operators import batch, folds, indicators
from candlemill.plans.catalogue import BY_TYPE, NAMES, ORACLES, RAW, by_type, div, over, prev, query, rounded
from candlemill.plans.facts import FOLDS


def _frame(name: str, n: int) -> str:
    hi, lo, whole = f"max(high) {over(n)}", f"min(low) {over(n)}", f"count(*) {over(n)} = {n}"
    return f"""round(case when {whole} then {hi} else high end, 6) as tf_{name}_high, round(case when {whole} then {lo} else low end, 6) as tf_{name}_low, round(coalesce({div(f'close - {prev("close", n)}', prev('close', n))}, 0), 6) + 0 as tf_{name}_ret,
    round(case when {whole} and {hi} - ({lo}) > 1e-10 then abs(close - first(open) {over(n)}) / ({hi} - ({lo})) else 0 end, 6) as tf_{name}_body"""


@query(f"with {BY_TYPE} select sym, ts, {_frame('1h', 12)}, {_frame('4h', 48)} from c")
def batch_timeframes(spark, d):
    return rounded(batch.timeframe_columns(by_type(spark, d)).select("sym", "ts", *(f"tf_{n}_{k}" for n in ("1h", "4h") for k in ("high", "low", "ret", "body"))))


_ATR = f"with {FOLDS}, ar as materialized (select *, coalesce({div(f'atr - {prev("atr", 6)}', prev('atr', 6))}, 0) as a6, coalesce({div(f'atr - {prev("atr", 12)}', prev('atr', 12))}, 0) as a12 from fo)"


@query(_ATR + " select sym, ts, round(a6, 6) + 0 as atr_roc_6, round(a12, 6) + 0 as atr_roc_12 from ar")
def atr_changes(spark, d):
    return rounded(batch.atr_changes(folds.fold(by_type(spark, d))).select("sym", "ts", "atr_roc_6", "atr_roc_12"))


_TREND = ORACLES["batch_columns"].replace("round(case when i >", "(case when i >").replace("end, 6) as trend", "end) as trend")
_SCALARS = [
    ("volatility", "atr-regime", "greatest(atr_ratio, 1e-10)", 0.1), ("volatility", "atr-ratio", "greatest(1 + a6, 0.01)", 2.0), ("volatility", "atr-accel-6", "greatest(-1, least(1, a6)) * 0.5 + 0.5", 1.0), ("volatility", "atr-accel-12", "greatest(-1, least(1, a12)) * 0.5 + 0.5", 1.0),
    *(("structure", f"exit-trend-consistency-{n}", f"trend_consistency_{n}", 1.0) for n in (6, 12, 24)), ("structure", "exit-adx-strength", "greatest(adx, 1)", 100.0), ("structure", "exit-structure-quality", "steady", 1.0),
    ("timing", "exit-momentum-rsi", "rsi / 100", 1.0), ("timing", "exit-momentum-macd", "greatest(-500, least(500, macd_hist)) / 1000 + 0.5", 1.0), ("timing", "exit-stoch-k", "greatest(0, least(1, stoch_k / 100))", 1.0), ("timing", "exit-cci-magnitude", "greatest(abs(cci), 1)", 300.0),
]
_ZONES = [
    ("volatility", "vol-regime", "zone", "case when a6 > 0.3 then 'vol-expanding-fast' when a6 > 0.1 then 'vol-expanding' when a6 < -0.2 then 'vol-contracting-fast' when a6 < -0.05 then 'vol-contracting' else 'vol-stable' end"), ("volatility", "squeeze-state", "bare", "case when squeeze < 1 then 'squeeze-active' else 'squeeze-off' end"),
    ("structure", "exit-structure", "zone", "case when adx > 40 and steady > 0.6 then 'structure-strong' when adx > 25 and steady > 0.5 then 'structure-moderate' when adx < 15 then 'structure-absent' else 'structure-weak' end"),
    ("timing", "exit-timing", "zone", "case when rsi > 70 and stoch_k > 80 then 'timing-overbought' when rsi < 30 and stoch_k < 20 then 'timing-oversold' else 'timing-neutral' end"),
]


@query(_ATR + f", x as materialized (select ar.*, stoch_k, cci, trend_consistency_6, trend_consistency_12, trend_consistency_24, (trend_consistency_6 + trend_consistency_12 + trend_consistency_24) / 3 as steady from ar join {RAW['stochastic']} using (sym, ts) join {RAW['cci']} using (sym, ts) join ({_TREND}) using (sym, ts)) "
    + " union all ".join([f"select sym, ts, '{m}' as module, '{n}' as name, 'scalar' as kind, round(({v})::double, 6) as value, {s}::double as scale, null::varchar as zone from x" for m, n, v, s in _SCALARS] + [f"select sym, ts, '{m}', '{n}', '{k}', null::double, null::double, {z} from x" for m, n, k, z in _ZONES]))
def exit_facts(spark, d):
    x = indicators.cci(indicators.stochastic(batch.atr_changes(folds.fold(by_type(spark, d)))))
    return rounded(batch.exit_facts(indicators.batch_columns(x)))


def _walk(name: str, up: bool) -> str:
    far, rev, sign = ("greatest", "<=", "-") if up else ("least", ">=", "+")
    agg = "list_max" if up else "list_min"
    return f"list_position(list_transform(range(1, len(p) + 1), lambda k: p[k] {rev} {far}(e, {agg}(p[1:k])) * (1 {sign} d)), true) as {name}"


@query(f"""with {BY_TYPE}, n as (select sym, ts, close as e, list(close) over (partition by sym order by ts rows between 1 following and 24 following) as p from c), t as (select *, unnest(range(1, 21)) * 0.1::double / 20 as d from n where e > 0 and len(p) > 0),
h as (select *, {_walk('fb', True)}, {_walk('fs', False)} from t), g as (select sym, ts, d, (case when coalesce(fb, 0) > 0 then p[fb] else p[len(p)] end - e) / e as b, (e - case when coalesce(fs, 0) > 0 then p[fs] else p[len(p)] end) / e as s from h),
k as (select *, row_number() over (partition by sym, ts order by b desc, d) as rb, row_number() over (partition by sym, ts order by s desc, d) as rs from g)
select sym || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') as id, round(max(d) filter (rb = 1), 6) as buy_distance, round(max(b) + 1e-9, 4) as buy_residue, round(max(d) filter (rs = 1), 6) as sell_distance, round(max(s) + 1e-9, 4) as sell_residue from k group by sym, ts""")
def dual_distances(spark, d):
    ahead = F.collect_list("close").over(Window.partitionBy("sym").orderBy("ts").rowsBetween(1, 24))
    e = by_type(spark, d).select(F.concat_ws("/", "sym", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("id"), F.col("close").alias("entry"), ahead.alias("path"))
    b = batch.dual_distances(e)  # a billionth more, so that halves round alike everywhere
    return rounded(b.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("buy_residue", "sell_residue")}))


@query()
def segment_divergences(spark, d):
    return batch.segment_divergences(folds.fold(by_type(spark, d)).where("close > 0"))


@query("select count(*) as n from events")
def row_count(spark, d):
    """From the files' footers: no column is read."""
    return spark.read.parquet(f"{d}/events.parquet").agg(F.count("*").alias("n"))


# Every column of the batch builder in one table: the SQL joins that of its parts.
_PARTS = [f.__name__ for f in (*indicators.ALL, indicators.time_parts) if f is not indicators.timeframe]


@query(f"select * replace (round(sma20 + 1e-9::double, 5) as sma20, round(sma50 + 1e-9::double, 5) as sma50, round(sma200 + 1e-9::double, 5) as sma200) from ({ORACLES['fold_all']}) " + " ".join(f"join ({ORACLES[n]}) using (sym, ts)" for n in ("batch_columns", "batch_timeframes", "atr_changes", *(f"ind_{p}" for p in _PARTS if p != "sma"))) + f" join {RAW['sma']} using (sym, ts)")
def offline_candles(spark, d):
    """Candles with all folds, indicators, time parts and columns of the batch builder: the folds' exchange and one by series."""
    df = indicators.time_parts(indicators.enrich(folds.fold(by_type(spark, d))))
    df = indicators.batch_columns(batch.atr_changes(batch.timeframe_columns(df)))
    own = ["trend_consistency_6", "trend_consistency_12", "trend_consistency_24", "range_position_12", "label", *(f"tf_{n}_{k}" for n in ("1h", "4h") for k in ("high", "low", "ret", "body")), "atr_roc_6", "atr_roc_12"]
    # a mean that ends in a five is rounded up, whatever its last bit
    df = df.withColumns({"squeeze": F.round("squeeze", 5), **{c: F.round(F.col(c) + 1e-9, 5) for c in NAMES["sma"]}})
    return rounded(df.select(*folds.CANDLE, *folds.COLUMNS, *(c for p in _PARTS for c in NAMES[p]), *own))
