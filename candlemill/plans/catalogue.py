"""Registry of the engine's queries over the driver's tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import folds, indicators, learning, provenance, simulator, treasury
from candlemill.sources import candles as C

QUERIES: dict = {}
ORACLES: dict = {}
#: Of each windowed indicator its SQL without rounding, for the SQL of what is built on it.
RAW: dict[str, str] = {}
#: And its columns.
NAMES: dict[str, list[str]] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def by_type(spark: SparkSession, d: str) -> DataFrame:
    return C.hourly_by_type(table(spark, d, "events").select("event_id", "ts", "event_type", "value"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero."""
    digits = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c)
    return df.select(*(digits(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- candles -------------------------------------------------------------------------------------------------------

BY_TYPE = """c as (
    select event_type as sym, date_trunc('hour', ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low,
           arg_max(value, ts) as close, count(*)::double as volume
    from events group by 1, 2)"""
OUT = "sym, ts, open, high, low, close, volume"


@query(f"with {BY_TYPE} select {OUT} from c")
def candles_by_type(spark, d):
    return by_type(spark, d)


@query("select 'all' as sym, date_trunc('hour', ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*)::double as volume from events group by 2")
def candles_hourly(spark, d):
    return C.hourly(table(spark, d, "events"))


@query("""with o as (select *, row_number() over (partition by l_returnflag, date_trunc('day', l_shipdate) order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem)
select l_returnflag as sym, date_trunc('day', l_shipdate)::timestamp as ts, arg_min(l_extendedprice, r) as open, max(l_extendedprice) as high, min(l_extendedprice) as low, arg_max(l_extendedprice, r) as close, sum(l_quantity) as volume from o group by 1, 2""")
def candles_daily_lineitem(spark, d):
    return C.daily_lineitem(table(spark, d, "lineitem"))


@query(f"with {BY_TYPE} select {OUT} from c order by ts, sym limit 100")
def candles_bounded(spark, d):
    return C.open_bounded(by_type(spark, d), 100)


@query(f"with {BY_TYPE}, r as (select *, row_number() over (partition by sym order by ts) as i from c) select {OUT} from r where i > 50 and i <= 150")
def candles_skip(spark, d):
    return C.skip(by_type(spark, d), 50, 100)


@query(f"with {BY_TYPE}, r as (select *, row_number() over (partition by sym order by ts) - 1 as i from c), w as (select unnest(range(10))::int as win) select win, sym, count(*) as n, round(sum(close), 6) as total from r join w on i >= win * 40 and i < win * 40 + 100 group by 1, 2")
def candles_strided(spark, d):
    return rounded(C.strided(by_type(spark, d), 10, 40, 100).groupBy("win", "sym").agg(F.count("*").alias("n"), F.sum("close").alias("total")))


# --- windowed indicators -------------------------------------------------------------------------------------------


def over(n: int) -> str:
    return f"over (partition by sym order by ts rows between {n - 1} preceding and current row)"


def prev(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by sym order by ts)"


def div(a: str, b: str, default: str = "0") -> str:
    return f"(case when ({b}) <> 0 then ({a}) / ({b}) else {default} end)"


def indicator(f, columns: dict[str, str], steps: list[str] = ()):  # noqa: B006
    """A query that gives the columns of one indicator; steps are further CTEs, each over the one before."""
    names = NAMES[f.__name__] = list(columns)
    src, ctes = "c", BY_TYPE
    for k, step in enumerate(steps):
        ctes += f", s{k} as (select *, {step} from {src})"
        src = f"s{k}"
    RAW[f.__name__] = f"(with {ctes} select sym, ts, {', '.join(f'({e})::double as {n}' for n, e in columns.items())} from {src})"
    show = ", ".join(f"case when round(({e})::double, 6) = 0 then 0.0::double else round(({e})::double, 6) end as {n}" for n, e in columns.items())

    def run(spark, d):
        return rounded(f(by_type(spark, d)).select("sym", "ts", *(F.col(n).cast("double").alias(n) for n in names)))

    run.__name__ = f"ind_{f.__name__}"
    query(f"with {ctes} select sym, ts, {show} from {src}")(run)


I = indicators  # noqa: E741
indicator(I.sma, {f"sma{n}": f"avg(close) {over(n)}" for n in (20, 50, 200)})
indicator(I.bollinger, {"bb_width": div("4 * s", "m"), "bb_pos": div("close - (m - 2 * s)", "4 * s", "0.5")}, [f"avg(close) {over(20)} as m, coalesce(stddev_pop(close) {over(20)}, 0) as s"])
indicator(
    I.stochastic,
    {"stoch_k": "coalesce(k, 50)", "stoch_d": "d", "williams_r": "case when n = 14 then " + div("-100 * (hi - close)", "hi - lo", "-50") + " else -50 end", "stoch_cross_delta": f"(coalesce(k, 50) - d) - coalesce({prev('coalesce(k, 50) - d')}, 0)"},
    [f"max(high) {over(14)} as hi, min(low) {over(14)} as lo, count(*) {over(14)} as n", "case when n = 14 then " + div("100 * (close - lo)", "hi - lo", "50") + " end as k", f"coalesce(avg(k) {over(3)}, 50) as d"],
)
indicator(
    I.cci, {"cci": "case when n = 20 then " + div("tp - m", "0.015 * md") + " else 0 end"},
    ["(high + low + close) / 3 as tp", f"avg(tp) {over(20)} as m, list(tp) {over(20)} as l, count(*) {over(20)} as n", "list_sum(list_transform(l, lambda x: abs(x - m))) / len(l) as md"],
)
indicator(
    I.mfi, {"mfi": f"case when dn = 0 then 100 else 100 - 100 / (1 + {div('up', 'dn')}) end"},
    ["(high + low + close) / 3 as tp", f"{prev('tp')} as p", f"coalesce(sum(case when p is not null then case when tp > p then tp * volume else 0 end end) {over(14)}, 0) as up, coalesce(sum(case when p is not null then case when tp > p then 0 else tp * volume end end) {over(14)}, 0) as dn"],
)
indicator(
    I.obv, {"obv_slope_12": f"case when count(*) {over(12)} < 2 then 0 else regr_slope(o, i) {over(12)} end", "volume_accel": f"volume / case when avg(volume) {over(20)} = 0 then 1 else avg(volume) {over(20)} end"},
    [f"coalesce(sign(close - {prev('close')}), 0) * volume as st, (row_number() over (partition by sym order by ts))::double as i", "sum(st) over (partition by sym order by ts rows unbounded preceding) as o"],
)
indicator(I.roc, {**{f"roc_{n}": f"case when {prev('close', n)} is null then 0 else {div(f'close - {prev("close", n)}', prev('close', n))} end" for n in (1, 3, 6)}, "roc_12": "0", "roc_12_whole": f"case when {prev('close', 12)} is null then 0 else {div(f'close - {prev("close", 12)}', prev('close', 12))} end"})
indicator(I.range_position, {f"range_pos_{n}": div(f"close - min(low) {over(n)}", f"max(high) {over(n)} - min(low) {over(n)}", "0.5") for n in (12, 24, 48)})
indicator(
    I.timeframe, {"tf_1h_ret": "r1", "tf_1h_body": "b1", "tf_4h_ret": "r4", "tf_4h_body": "b4", "tf_agreement": "(f * sign(r1) + f * sign(r4) + sign(r1) * sign(r4)) / 3"},
    [f"first(close) {over(12)} as f1, first(close) {over(48)} as f4, coalesce(sign(close - {prev('close')}), 0) as f", f"{div('close - f1', 'f1')} as r1, {div('close - f4', 'f4')} as r4, {div('abs(close - f1)', f'max(close) {over(12)} - min(close) {over(12)}')} as b1, {div('abs(close - f4)', f'max(close) {over(48)} - min(close) {over(48)}')} as b4"],
)
indicator(
    I.ichimoku, {"tenkan_sen": "t", "kijun_sen": "k", "cloud_top": "greatest((t + k) / 2, b)", "cloud_bottom": "least((t + k) / 2, b)", "tk_cross_delta": f"(t - k) - coalesce({prev('t - k')}, 0)"},
    [", ".join(f"(max(high) {over(n)} + min(low) {over(n)}) / 2 as {a}" for n, a in ((9, "t"), (26, "k"), (52, "b")))],
)
indicator(I.vwap, {"vwap_distance": div("close - v", "close")}, [div("sum(close * volume) over (partition by sym order by ts rows unbounded preceding)", "sum(volume) over (partition by sym order by ts rows unbounded preceding)") + " as v"])
indicator(I.efficiency, {"kama_er": f"case when count(*) {over(10)} = 10 then {div(f'abs(close - first(close) {over(10)})', f'sum(m) {over(9)}', '1')} else 0.5 end"}, [f"abs(close - {prev('close')}) as m"])
indicator(
    I.entropy, {"entropy_rate": "case when n >= 5 then " + " + ".join(f"(case when c{i} > 0 then -(c{i} / n) * ln(c{i} / n) else 0 end)" for i in range(5)) + " else 1 end"},
    [f"{prev('close')} as p", f"case when p is not null then {div('close - p', 'p')} end as r", "case when r < -0.005 then 0 when r < -0.001 then 1 when r < 0.001 then 2 when r < 0.005 then 3 when r is not null then 4 end as bin", f"count(bin) {over(29)} as n, " + ", ".join(f"(count(*) filter (bin = {i}) {over(29)})::double as c{i}" for i in range(5))],
)
indicator(
    I.aroon, {"aroon_up": "case when n = 25 then (25 - list_position(list_reverse(h), list_max(h))) / 24.0 * 100 else 50 end", "aroon_down": "case when n = 25 then (25 - list_position(list_reverse(l), list_min(l))) / 24.0 * 100 else 50 end"},
    [f"list(high) {over(25)} as h, list(low) {over(25)} as l, count(*) {over(25)} as n"],
)
indicator(I.price_action, {"range_ratio": div("high", "low", "1"), "gap": f"coalesce({div(f'open - {prev("close")}', prev('close'))}, 0)"})
indicator(
    I.streaks, {"consecutive_up": "sum((mv > 0)::int) over (partition by sym, dn order by ts rows unbounded preceding)", "consecutive_down": "sum((mv < 0)::int) over (partition by sym, up order by ts rows unbounded preceding)"},
    [f"coalesce(sign(close - {prev('close')}), 0) as mv", "sum((mv < 0)::int) over (partition by sym order by ts rows unbounded preceding) as dn, sum((mv > 0)::int) over (partition by sym order by ts rows unbounded preceding) as up"],
)
_LOGS = "list_transform(range(1, len(l) - {k} + 1), lambda i: case when l[i] > 0 and l[i + {k}] > 0 then ln(l[i + {k}] / l[i]) else 0 end)"
indicator(
    I.variance_ratio, {"variance_ratio": "case when len(l) < 10 then 1 else " + div("list_var_pop(five)", "5 * list_var_pop(one)", "1") + " end"},
    [f"list(close) {over(30)} as l", f"{_LOGS.format(k=1)} as one, {_LOGS.format(k=5)} as five"],
)
indicator(
    I.autocorrelation, {"autocorrelation": "case when len(l) >= 3 then " + div("list_sum(list_transform(range(1, len(l)), lambda i: (l[i] - m) * (l[i + 1] - m))) / (len(l) - 1)", "v") + " else 0 end"},
    [f"list(close) {over(48)} as l, avg(close) {over(48)} as m, var_pop(close) {over(48)} as v"],
)
indicator(I.time_parts, {"minute": "minute(ts)", "hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "day_of_month": "day(ts)", "month_of_year": "month(ts)"})


@query(f"""with {BY_TYPE}, s as (select *, (close > {prev('close')})::int as rose, row_number() over (partition by sym order by ts) as i, lead(close, 10) over (partition by sym order by ts) as ahead from c)
select sym, ts, {', '.join(f"round(case when i > {n} then (sum(rose) {over(n)}) / {n}.0 else 0.5 end, 6) as trend_consistency_{n}" for n in (6, 12, 24))},
  round(case when count(*) {over(12)} = 12 then {div(f'close - min(low) {over(12)}', f'max(high) {over(12)} - min(low) {over(12)}', '0.5')} else 0.5 end, 6) as range_position_12,
  case when ahead is null then 'Noise' when {div('ahead - close', 'close')} > 0.005 then 'Buy' when {div('ahead - close', 'close')} < -0.005 then 'Sell' else 'Noise' end as label from s""")
def batch_columns(spark, d):
    return rounded(indicators.batch_columns(by_type(spark, d)).select("sym", "ts", "trend_consistency_6", "trend_consistency_12", "trend_consistency_24", "range_position_12", "label"))


@query(f"""with {BY_TYPE}, s as (select *, avg(close) {over(20)} as f, avg(close) {over(50)} as w from c)
select sym, case when f > w * 1.001 then 'Up' when f < w * 0.999 then 'Down' else 'Hold' end as signal, count(*) as n from s group by 1, 2""")
def sma_cross_signals(spark, d):
    df = indicators.sma(by_type(spark, d))
    signal = F.when(F.col("sma20") > F.col("sma50") * 1.001, "Up").when(F.col("sma20") < F.col("sma50") * 0.999, "Down").otherwise("Hold")
    return df.groupBy("sym", signal.alias("signal")).agg(F.count("*").alias("n"))


# --- recursions ----------------------------------------------------------------------------------------------------


def recursive(x: str, period: int, keep: str, add: str, name: str, skip: int = 0, src: str = "n") -> str:
    """CTE name(sym, i, v): the seeded recursion of x over rows i of src, by a fold over lists with the step number in it."""
    return f"""{name}_l as (select sym, list({x} order by i) as l, list(i order by i) as ii from {src} where i > {skip} group by sym),
    {name} as (select sym, unnest(ii) as i, unnest(list_transform(range(1, len(l) + 1), lambda k: case when k < {period} then 0.0
        else list_reduce(list_concat([list_sum(l[1:{period}]) / {period}], l[{period} + 1:k]), lambda a, b: {keep} * a + {add} * b) end)) as v from {name}_l)"""


NUMBERED = BY_TYPE + f", n as (select *, row_number() over (partition by sym order by ts) as i, {prev('close')} as pc from c), tr as (select *, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as t, greatest(coalesce(close - pc, 0), 0) as gain, greatest(coalesce(pc - close, 0), 0) as fall from n)"


@query(f"""with {NUMBERED}, {recursive('close', 20, '(1 - 2.0/21)', '(2.0/21)', 'e')}, {recursive('t', 14, '(13.0/14)', '(1.0/14)', 'a', 0, 'tr')}
select n.sym, n.ts, round(e.v, 6) as ema20, round(a.v, 6) as atr, round(e.v + 2 * a.v, 6) as kelt_upper, round(e.v - 2 * a.v, 6) as kelt_lower, round({div('n.close - (e.v - 2 * a.v)', '4 * a.v', '0.5')}, 6) as kelt_pos, round({div('a.v', 'n.close')}, 6) as atr_ratio
from n join e on n.sym = e.sym and n.i = e.i join a on n.sym = a.sym and n.i = a.i""")
def fold_ema_atr_keltner(spark, d):
    df = folds.fold(by_type(spark, d), ("ema20", "atr", "kelt_upper", "kelt_lower", "kelt_pos", "atr_ratio"))
    near = lambda c: F.when(F.abs(F.col("kelt_upper") - F.col("kelt_lower")) > 1e-12, F.col(c)).otherwise(0.5)
    return rounded(df.select("sym", "ts", "ema20", "atr", "kelt_upper", "kelt_lower", near("kelt_pos").alias("kelt_pos"), "atr_ratio"))


@query(f"""with {NUMBERED}, {recursive('gain', 14, '(13.0/14)', '(1.0/14)', 'g', 1, 'tr')}, {recursive('fall', 14, '(13.0/14)', '(1.0/14)', 'f', 1, 'tr')}
select n.sym, n.ts, round(case when coalesce(f.v, 0) = 0 then 100 else 100 - 100 / (1 + g.v / f.v) end, 6) as rsi from n left join g on n.sym = g.sym and n.i = g.i left join f on n.sym = f.sym and n.i = f.i""")
def fold_rsi(spark, d):
    return rounded(folds.fold(by_type(spark, d), ("rsi",)).select("sym", "ts", "rsi"))


@query(f"""with {NUMBERED}, {recursive('close', 12, '(1 - 2.0/13)', '(2.0/13)', 'p')}, {recursive('close', 26, '(1 - 2.0/27)', '(2.0/27)', 'q')},
m as (select p.sym, p.i, p.v - q.v as macd from p join q on p.sym = q.sym and p.i = q.i), {recursive('macd', 9, '(1 - 2.0/10)', '(2.0/10)', 's', 25, 'm')}
select n.sym, n.ts, round(macd - coalesce(s.v, 0), 6) as macd_hist from n join m on n.sym = m.sym and n.i = m.i left join s on n.sym = s.sym and n.i = s.i""")
def fold_macd(spark, d):
    return rounded(folds.fold(by_type(spark, d), ("macd_hist",)).select("sym", "ts", "macd_hist"))


@query(f"""with {NUMBERED}, m as (select *, high - {prev('high')} as up, {prev('low')} - low as dn from tr), dm as (select *, case when up > dn and up > 0 then up else 0 end as plus, case when dn > up and dn > 0 then dn else 0 end as minus from m),
{recursive('t', 14, '(13.0/14)', '(1.0/14)', 't', 1, 'dm')}, {recursive('plus', 14, '(13.0/14)', '(1.0/14)', 'p', 1, 'dm')}, {recursive('minus', 14, '(13.0/14)', '(1.0/14)', 'q', 1, 'dm')}
select n.sym, n.ts, round(coalesce(100 * {div('p.v', 't.v')}, 0), 6) as plus_di, round(coalesce(100 * {div('q.v', 't.v')}, 0), 6) as minus_di
from n left join t on n.sym = t.sym and n.i = t.i left join p on n.sym = p.sym and n.i = p.i left join q on n.sym = q.sym and n.i = q.i""")
def fold_directional(spark, d):
    return rounded(folds.fold(by_type(spark, d), ("plus_di", "minus_di")).select("sym", "ts", "plus_di", "minus_di"))


@query(f"""with {NUMBERED}, {recursive('t', 14, '(13.0/14)', '(1.0/14)', 'a', 0, 'tr')}, j as (select n.*, a.v as atr from n join a on n.sym = a.sym and n.i = a.i),
r as (select *, max(high) {over(12)} - min(low) {over(12)} as reach, sum(atr) {over(14)} as total, avg(close) {over(20)} as m, coalesce(stddev_pop(close) {over(20)}, 0) as s from j)
select sym, ts, round(case when i >= 14 and reach > 0 and total > 0 then 100 * ln(total / reach) / ln(14) else 50 end, 6) as choppiness,
round({div(div('4 * s', 'm'), div('4 * atr', 'close'))}, 5) as squeeze from r""")
def fold_choppiness_squeeze(spark, d):
    out = folds.fold(by_type(spark, d), ("choppiness", "squeeze")).select("sym", "ts", "choppiness", F.round("squeeze", 5).alias("squeeze"))
    return rounded(out)


@query(f"""with recursive {NUMBERED}, {recursive('t', 14, '(13.0/14)', '(1.0/14)', 'a', 0, 'tr')}, j as materialized (select n.sym, n.ts, n.i, n.close, 2 * a.v as sm from n join a on n.sym = a.sym and n.i = a.i),
ph(sym, i, rising, extreme, label, direction, duration, generation) as (
    select sym, i, false, close, 'Valley', 'None', 1, 0 from j where i = 1
    union all
    select sym, i, rising, extreme, new_label, case when near then 'None' when rising then 'Up' else 'Down' end, case when new_label = label then duration + 1 else 1 end, generation + (new_label <> label)::int
    from (select *, case when near then case when rising then 'Peak' else 'Valley' end else 'Transition' end as new_label
        from (select *, case when rising then extreme - close else close - extreme end <= sm / 2 as near
            from (select sym, i, close, sm, label, duration, generation, (was <> turned) as rising, case when turned then close else tracked end as extreme
                from (select *, case when was then tracked - close else close - tracked end > sm as turned
                    from (select j.sym, j.i, j.close, j.sm, ph.label, ph.duration, ph.generation, ph.rising as was, case when ph.rising then greatest(ph.extreme, j.close) else least(ph.extreme, j.close) end as tracked
                        from ph join j on j.sym = ph.sym and j.i = ph.i + 1)))))
) select j.sym, j.ts, j.close, ph.label as phase_label, ph.direction as phase_direction, ph.duration::bigint as phase_duration, ph.generation::bigint as phase_generation from ph join j on j.sym = ph.sym and j.i = ph.i""")
def phase_labels(spark, d):
    return folds.phases(folds.fold(by_type(spark, d), ("atr",)))


# --- simulation and ledger -----------------------------------------------------------------------------------------


def labelled(spark, d) -> DataFrame:
    base = by_type(spark, d)
    p = folds.phases(folds.fold(base, ("atr",))).select("sym", "ts", "phase_label", "phase_generation")
    return indicators.sma(base).join(p, ["sym", "ts"])


def outcomes(spark, d) -> DataFrame:
    return simulator.simulate(labelled(spark, d), deadline=48)


_SIMULATED = ORACLES["phase_labels"].rsplit(") select j.sym", 1)[0] + f"""),
sig as materialized (select j.sym, j.i, j.close, ph.label, ph.generation, t.thinker,
    case when t.thinker = 'always-up' then 'Up' when avg(j.close) over (partition by j.sym, t.thinker order by j.i rows 19 preceding) > avg(j.close) over (partition by j.sym, t.thinker order by j.i rows 49 preceding) * 1.001 then 'Up'
         when avg(j.close) over (partition by j.sym, t.thinker order by j.i rows 19 preceding) < avg(j.close) over (partition by j.sym, t.thinker order by j.i rows 49 preceding) * 0.999 then 'Down' else 'Hold' end as signal
    from j join ph on j.sym = ph.sym and j.i = ph.i cross join (values ('always-up'), ('sma-cross')) t(thinker)),
sim(sym, thinker, i, dir, since, entry, papers, gen, state, gain, was_dir, was_since) as (
    select sym, thinker, i, case when signal <> 'Hold' then signal end, i, close, (signal <> 'Hold')::int, generation, null::varchar, 0.0::double, null::varchar, 0::bigint from sig where i = 1
    union all
    select sym, thinker, i, case when dir is null then case when signal <> 'Hold' then signal end when verdict is null then dir end, case when dir is null then i else since end, case when dir is null then close else entry end,
        papers + (dir is null and signal <> 'Hold')::int, generation, verdict, g, dir, since
    from (select *, case when dir is null then null when i >= since + 48 then 'Violence'
                         when generation <> gen and label = case when dir = 'Up' then 'Peak' else 'Valley' end and signal <> 'Hold' and signal <> dir and g >= 0.01 then 'Grace' end as verdict
        from (select sig.*, sim.dir, sim.since, sim.entry, sim.papers, sim.gen, (case when sim.entry = 0 then 0 else (sig.close - sim.entry) / sim.entry end) * (case when sim.dir = 'Up' then 1 else -1 end) - 0.007 as g
            from sim join sig on sig.sym = sim.sym and sig.thinker = sim.thinker and sig.i = sim.i + 1))
), outcomes as (select sym, thinker, papers::bigint as paper_id, was_dir as direction, was_since::bigint as opened_at, i::bigint as resolved_at, state, case when state = 'Grace' then gain else 0 end as residue, case when state = 'Violence' then abs(gain) else 0 end as loss from sim where state is not null)
"""


@query(_SIMULATED + "select sym, thinker, paper_id, direction, opened_at, resolved_at, state, round(residue::double, 6) as residue, round(loss::double, 6) as loss from outcomes")
def paper_resolutions(spark, d):
    return rounded(outcomes(spark, d))


@query(_SIMULATED + "select sym, thinker, count(*) as papers, count(*) filter (state = 'Grace') as grace, count(*) filter (state = 'Violence') as violence, round(sum(residue)::double, 6) as residue, round(sum(loss)::double, 6) as loss from outcomes group by 1, 2")
def run_aggregates(spark, d):
    return rounded(simulator.aggregate(outcomes(spark, d), "sym", "thinker"))


@query(_SIMULATED + """, byt as (select thinker, count(*) as p, count(*) filter (state = 'Grace') as g from outcomes group by 1),
zz as (select u.g as g0, u.p as p0, v.g as g1, v.p as p1, (u.g + v.g) / (u.p + v.p) as q from byt u, byt v where u.thinker = 'always-up' and v.thinker = 'sma-cross')
select g0, p0, g1, p1, round(case when q * (1 - q) > 0 then (g1 / p1 - g0 / p0) / sqrt(q * (1 - q) * (1 / p1 + 1 / p0)) else 0 end, 6) as z from zz""")
def thinker_significance(spark, d):
    a = simulator.aggregate(outcomes(spark, d), "thinker")
    up, cross = (a.where(F.col("thinker") == t).select(F.col("grace").alias(f"g{k}"), F.col("papers").alias(f"p{k}")) for k, t in enumerate(("always-up", "sma-cross")))
    return rounded(simulator.two_proportion_z(up.crossJoin(cross), "g1", "p1", "g0", "p0"))


def requests(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "Exit").when(F.col("event_type") == "view", "Submit").otherwise("Tick")
    return e.select(F.col("user_id").alias("owner"), "event_id", F.floor(F.unix_timestamp("ts") / 300).cast("long").alias("candle"), F.col("value").alias("price"), kind.alias("kind"))


@query()
def treasury_ledger(spark, d):
    return rounded(treasury.ledger(requests(spark, d)))


@query()
def proposer_records(spark, d):
    return rounded(treasury.proposer_records(treasury.ledger(requests(spark, d))))


@query("""with g as (select user_id as owner, count(*) as paper_submitted, count(*) filter (event_type = 'purchase') as paper_survived, count(*) filter (event_type = 'view') as paper_failed,
  round(coalesce(sum(case when event_type = 'purchase' then value else 0 end), 0), 6) as paper_grace_residue from events group by 1)
select *, paper_submitted >= 50 and (case when paper_survived + paper_failed > 0 then paper_survived / (paper_survived + paper_failed) else 0 end) > 0.5 as gate from g""")
def gate_predicate(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", "Grace").when(F.col("event_type") == "view", "Violence").otherwise("Active")
    return rounded(treasury.proposer_records(e.select(F.col("user_id").alias("owner"), state.alias("state"), F.col("value").alias("residue"))))


# --- result analytics ----------------------------------------------------------------------------------------------


@query("select event_type as thinker, count(*) as papers, count(*) filter (value > 20) as grace, count(*) filter (value <= 20) as violence, count(distinct user_id) as owners, round(sum(value), 4) as residue, round(avg(value), 6) as mean from events group by 1 having count(*) > 10 order by 1")
def grouped_rollup(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("thinker")).agg(F.count("*").alias("papers"), F.count_if(F.col("value") > 20).alias("grace"), F.count_if(F.col("value") <= 20).alias("violence"), F.count_distinct("user_id").alias("owners"), F.round(F.sum("value"), 4).alias("residue"), F.round(F.avg("value"), 6).alias("mean"))
    return g.where("papers > 10").orderBy("thinker")


@query("select json_extract(props, '$.k')::bigint as k, count(*) as n, round(sum(value), 4) as total from events group by 1")
def json_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select floor(l_discount * 100) / 100 as band, count(*) as n, round(avg((l_returnflag = 'R')::int), 6) as rate from lineitem group by 1")
def conviction_bins(spark, d):
    return table(spark, d, "lineitem").groupBy((F.floor(F.col("l_discount") * 100) / 100).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("rate"))


@query("select 'orders' as log, count(*) as n, count(distinct o_custkey) as ids from orders union all select 'events', count(*), count(distinct user_id) from events union all select 'lineitem', count(*), count(distinct l_partkey) from lineitem")
def union_summary(spark, d):
    one = lambda t, k: table(spark, d, t).agg(F.lit(t).alias("log"), F.count("*").alias("n"), F.count_distinct(k).alias("ids"))
    return one("orders", "o_custkey").unionByName(one("events", "user_id")).unionByName(one("lineitem", "l_partkey"))


@query("select o.o_orderkey, count(*) as facts, round(sum(l_extendedprice), 4) as total, max(l_shipdate) as shipped from orders o join lineitem l on o.o_orderkey = l.l_orderkey where o.o_totalprice > 100000 group by 1")
def ledger_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey")
    return o.join(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("facts"), F.round(F.sum("l_extendedprice"), 4).alias("total"), F.max("l_shipdate").alias("shipped"))


@query("""with t as (select l_orderkey as id, l_extendedprice as entry, l_extendedprice * (1 + l_tax - l_discount) as close from lineitem)
select id, count(*) as n, round(sum((close / entry) * (1 - 0.0035) * (1 - 0.0035) - 1), 6) as pnl, round(sum((close > entry)::int) / (count(*) + 0.001), 6) as allocation from t where entry > 0 group by 1""")
def trade_pnl(spark, d):
    t = table(spark, d, "lineitem").where("l_extendedprice > 0").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("entry"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("close"))
    return t.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close") / F.col("entry") * (1 - 0.0035) * (1 - 0.0035) - 1), 6).alias("pnl"), F.round(F.sum((F.col("close") > F.col("entry")).cast("int")) / (F.count("*") + 0.001), 6).alias("allocation"))


# --- vectors -------------------------------------------------------------------------------------------------------

SIGNS = "e as (select vec_id, label, list_transform(embedding, lambda x: sign(x::double)::double) as v, list_transform(embedding, lambda x: x::double) as r from embeddings)"


def signs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.signum(x.cast("double"))).alias("v"), F.transform("embedding", lambda x: x.cast("double")).alias("r"))


def with_query(s: DataFrame) -> DataFrame:
    """s with q, the vector 0: one row, or none, joined with all."""
    return s.crossJoin(F.broadcast(s.where("vec_id = 0").select(F.col("r").alias("q")).limit(1)))


@query(f"with {SIGNS}, x as (select vec_id, v, list_transform(range(1, len(v) + 1), lambda i: v[((i - 1 - 3) % len(v) + len(v)) % len(v) + 1]) as p from e) select vec_id, list_aggregate(list_transform(range(1, len(v) + 1), lambda i: (v[i] * p[i])::int::varchar), 'string_agg', ',') as bound from x")
def vector_bind_permute(spark, d):
    s = signs(spark, d)
    return s.select("vec_id", F.array_join(F.transform(V.bind(F.col("v"), V.permute(F.col("v"), 3)), lambda x: x.cast("int").cast("string")), ",").alias("bound"))


@query(f"with {SIGNS}, p as (select label, unnest(range(1, len(v) + 1)) as i, unnest(v) as x from e), s as (select label, i, sign(sum(x)) as x from p group by 1, 2) select label, string_agg(x::int::varchar, ',' order by i) as bundle from s group by 1")
def vector_bundle(spark, d):
    b = V.bundle_rows(signs(spark, d), ["label"], "v")
    return b.select("label", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("bundle"))


@query(f"with {SIGNS}, q as (select r as q from e where vec_id = 0) select vec_id, round(list_cosine_similarity(r, q), 6) as cosine, list_cosine_similarity(r, q) > 5 / sqrt(len(r)) as present from e, q")
def vector_cosine(spark, d):
    s = with_query(signs(spark, d))
    c = V.cosine(F.col("r"), F.col("q"))
    return s.select("vec_id", F.round(c, 6).alias("cosine"), (c > 5.0 / F.sqrt(F.size("r"))).alias("present"))


@query(f"with {SIGNS}, q as (select r as q from e where vec_id = 0), w as (select vec_id, r, q, list_inner_product(r, q) / list_inner_product(q, q) as w from e, q) select vec_id, round(list_sum(list_transform(range(1, len(r) + 1), lambda i: (r[i] - w * q[i]) * (r[i] - w * q[i]))), 6) as rejected, round(list_sum(list_transform(q, lambda x: w * x * w * x)), 6) as projected from w")
def vector_reject_project(spark, d):
    s = with_query(signs(spark, d))
    a, b = V.reject(F.col("r"), F.col("q")), V.project(F.col("r"), F.col("q"))
    return s.select("vec_id", F.round(V.dot(a, a), 6).alias("rejected"), F.round(V.dot(b, b), 6).alias("projected"))


@query("with t as (select event_id, least(1, greatest(0, value / 100)) as s from events) select event_id, floor(s * 64 + 0.5)::bigint as ones from t")
def vector_thermometer(spark, d):
    e = table(spark, d, "events")
    v = V.thermometer(F.col("value"), F.lit(0.0), F.lit(100.0), 64)
    return e.select("event_id", F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("ones"))


@query()
def vector_rhythm(spark, d):
    e = by_type(spark, d)
    last = F.collect_list("close").over(Window.partitionBy("sym").orderBy("ts").rowsBetween(-10, 0))
    return e.withColumn("l", last).select("sym", "ts", V.to_hex(V.rhythm(F.col("l"), 0.0, 100.0, 20.0, 256)).alias("rhythm"))


# --- retrieval and provenance --------------------------------------------------------------------------------------


@query("select item_id, sha256(text) as receipt, count(*) over (partition by sha256(text)) as copies from benchmark")
def receipts(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("receipt"))
    return b.withColumn("copies", F.count("*").over(Window.partitionBy("receipt")))


@query("with e as (select o_orderkey as id, o_custkey as key, o_totalprice as v from orders), c as (select c_custkey as key, c_nationkey as value from customer) select e.id, c.value is not null as found, coalesce(c.value, -1)::bigint as terminal from e left join c on e.key = c.key")
def cache_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    return o.join(c, "key", "left").select("id", F.col("value").isNotNull().alias("found"), F.coalesce("value", F.lit(-1)).cast("long").alias("terminal"))


@query(f"""with {SIGNS}, a as (select label as axiom, v from e where vec_id < 10), k as (select vec_id as claim, v from e where vec_id >= 10),
m as (select claim, max(list_cosine_similarity(k.v, a.v)) as coherence from k, a group by 1) select claim, round(coherence, 6) as coherence, case when coherence >= 0.4 then 'accept' when coherence >= 0.2 then 'review' else 'reject' end as verdict from m""")
def soundness_gate(spark, d):
    """Ten axioms against all claims: the axioms, a stated few, are one row that all claims are joined with."""
    s = signs(spark, d)
    axioms = s.where("vec_id < 10").agg(F.collect_list("v").alias("axioms"))
    best = F.array_max(F.transform("axioms", lambda a: V.cosine(F.col("v"), a)))
    out = s.where("vec_id >= 10").crossJoin(F.broadcast(axioms)).select(F.col("vec_id").alias("claim"), best.alias("c")).where("c is not null")
    return out.select("claim", F.round("c", 6).alias("coherence"), F.when(F.col("c") >= 0.4, "accept").when(F.col("c") >= 0.2, "review").otherwise("reject").alias("verdict"))


# --- windows of facts, phases, learners ----------------------------------------------------------------------------

@query(f"""with {BY_TYPE}, g as (select *, case when close > open then 'Up' else 'Down' end as guess, lead(close, 6) over (partition by sym order by ts) as later from c),
x as (select *, case when later is null or later = close then 'open' when (later > close) = (guess = 'Up') then 'right' else 'wrong' end as grade from g)
select sym, guess, grade, count(*) as n from x group by 1, 2, 3""")
def grade_predictions(spark, d):
    c = by_type(spark, d).withColumn("guess", F.when(F.col("close") > F.col("open"), "Up").otherwise("Down"))
    return learning.grade_predictions(c, 6).groupBy("sym", "guess", "grade").agg(F.count("*").alias("n"))


@query(f"""with {SIGNS}, p as (select label, unnest(range(1, len(r) + 1)) as i, unnest(r) as x from e), s as (select label, i, sum(x) as x from p group by 1, 2), t as (select label, list(x order by i) as p from s group by 1),
m as (select e.vec_id, t.label as guess, list_cosine_similarity(e.r, t.p) as c from e, t), k as (select *, row_number() over (partition by vec_id order by c desc) as place, lead(c) over (partition by vec_id order by c desc) as second from m)
select vec_id, guess, round(c, 6) as cosine, round(c - second, 6) as margin from k where place = 1""")
def reckoner(spark, d):
    s = signs(spark, d)
    out = learning.reckon(s, learning.prototypes(s, "r", "label"), "r", V.cosine)
    return rounded(out.select("vec_id", "guess", "cosine", "margin"))


# --- provenance ----------------------------------------------------------------------------------------------------


@query("select o.o_orderkey as id, case when max(l_shipdate) is null then 'unanchored' when o.o_orderdate >= max(l_shipdate) then 'possible' else 'impossible' end as verdict from orders o left join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey, o.o_orderdate")
def causal_time(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("claimed_at"))
    return provenance.causal(claims, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("publication_time")))


@query("""with b as (select s_suppkey as r, s_nationkey as v from supplier), k as (select l_orderkey as id, l_suppkey as r, l_suppkey % 25 as v from lineitem),
j as (select k.id, coalesce(k.v = b.v, false) as ok from k left join b using (r)) select id, case when bool_and(ok) then 'valid' else 'invalid' end as verdict from j group by 1""")
def time_witness(spark, d):
    beacons = table(spark, d, "supplier").select(F.lit("s").alias("name"), F.col("s_suppkey").alias("round"), F.col("s_nationkey").cast("long").alias("value"))
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("s").alias("name"), F.col("l_suppkey").alias("round"), (F.col("l_suppkey") % 25).alias("value"))
    return provenance.witnesses(claims, beacons)


@query("""with recursive p as (select c_custkey as form, case when c_custkey >= 10 then c_custkey // 2 end as next, case when c_custkey < 10 then c_nationkey end as terminal from customer),
r(form, here, n) as (select form, form, 0 from p union all select r.form, p.next, n + 1 from r join p on r.here = p.form where p.next is not null and n < 16)
select r.form, max(p.terminal)::bigint as terminal from r left join p on r.here = p.form group by 1""")
def chain_resolution(spark, d):
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("form"), F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 2)).alias("next"), F.when(F.col("c_custkey") < 10, F.col("c_nationkey").cast("long")).alias("terminal"))
    return provenance.resolve(p)


@query("with s as (select l_partkey as part, l_returnflag as flag, sum(l_extendedprice) as score from lineitem group by 1, 2), k as (select *, row_number() over (partition by part order by score desc, flag) as place, lead(score) over (partition by part order by score desc, flag) as second from s) select part, flag, round(score - coalesce(second, 0), 4) as margin from k where place = 1")
def margin_classification(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_extendedprice").alias("score"))
    return provenance.top_two(s, "part", "flag", "score").withColumn("margin", F.round("margin", 4))


@query("with m as (select event_type as asset, sum(case when user_id % 2 = 0 then value else -value end) as balance from events group by 1), p as (select event_type as asset, avg(value) as price from events group by 1) select asset, round(balance, 4) as balance, round(price, 6) as price, round(balance * price, 2) as value from m join p using (asset)")
def asset_balances(spark, d):
    e = table(spark, d, "events")
    moves = e.select(F.col("event_type").alias("asset"), F.when(F.col("user_id") % 2 == 0, "deposit").otherwise("withdraw").alias("kind"), F.col("value").alias("amount"))
    b = treasury.balances(moves, e.groupBy(F.col("event_type").alias("asset")).agg(F.avg("value").alias("price")))
    return b.select("asset", F.round("balance", 4).alias("balance"), F.round("price", 6).alias("price"), F.round("value", 2).alias("value"))
