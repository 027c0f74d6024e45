"""Queries of all recursions together, of phases, facts, lenses and trade atoms. The SQL is written from the definitions, not
from the operators' tables: facts are formulas over the unrounded SQL of the indicators, scales are weighted sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import folds, indicators, rhythms, vocabulary
from candlemill.plans.catalogue import NUMBERED, ORACLES, RAW, by_type, div, over, query, recursive, rounded

_W = "(13.0/14)", "(1.0/14)"


def _wilder(x: str, name: str, skip: int, src: str) -> str:
    return recursive(x, 14, *_W, name, skip, src)


def _dfa(size: int, square: float) -> str:
    """Root mean square about the lines of whole segments of the profile p; square is the sum of squared places."""
    seg = f"p[s * {size} + 1:(s + 1) * {size}]"
    rest = f"{size} * list_var_pop({seg}) - pow(list_sum(list_transform(range(1, {size + 1}), lambda j: (j - 1 - {(size - 1) / 2}) * p[s * {size} + j])), 2) / {square}"
    return f"sqrt(greatest(list_sum(list_transform(range(0, len(p) // {size}), lambda s: {rest})), 0) / ((len(p) // {size}) * {size}))"


_STEP4 = "list_avg(list_transform(list_filter(range(0, 4), lambda m: (len(c) - 1 - m) // 4 >= 1), lambda m: list_sum(list_transform(range(1, (len(c) - 1 - m) // 4 + 1), lambda j: abs(c[m + 1 + 4 * j] - c[m + 1 + 4 * (j - 1)]))) * (len(c) - 1) / (((len(c) - 1 - m) // 4) * 4) / 4))"
#: CTEs that end in fo: every recursion's column, unrounded.
FOLDS = f"""{NUMBERED}, {recursive('close', 20, '(1 - 2.0/21)', '(2.0/21)', 'e20')}, {_wilder('t', 'at14', 0, 'tr')}, {_wilder('gain', 'wg', 1, 'tr')}, {_wilder('fall', 'wf', 1, 'tr')},
{recursive('close', 12, '(1 - 2.0/13)', '(2.0/13)', 'e12')}, {recursive('close', 26, '(1 - 2.0/27)', '(2.0/27)', 'e26')}, mc as (select e12.sym, e12.i, e12.v - e26.v as macd from e12 join e26 using (sym, i)), {recursive('macd', 9, '(1 - 2.0/10)', '(2.0/10)', 'sg', 25, 'mc')},
mv as (select *, high - lag(high) over (partition by sym order by i) as up, lag(low) over (partition by sym order by i) - low as dn from tr), dm as (select *, case when up > dn and up > 0 then up else 0 end as plus, case when dn > up and dn > 0 then dn else 0 end as minus from mv),
{_wilder('t', 'wt', 1, 'dm')}, {_wilder('plus', 'wp', 1, 'dm')}, {_wilder('minus', 'wm', 1, 'dm')},
di as materialized (select n.sym, n.i, coalesce(wt.v, 0) as t, coalesce(100 * {div('wp.v', 'wt.v')}, 0) as p, coalesce(100 * {div('wm.v', 'wt.v')}, 0) as m from n left join wt using (sym, i) left join wp using (sym, i) left join wm using (sym, i)),
rd as (select sym, i as at, row_number() over (partition by sym order by i) as i, 100 * abs(p - m) / (p + m) as dx from di where i >= 15 and t > 0 and p + m > 0), {_wilder('dx', 'wx', 0, 'rd')}, ax as (select rd.sym, rd.at as i, wx.v as adx from rd join wx using (sym, i)),
j1 as materialized (select n.*, e20.v as ema20, at14.v as atr, case when coalesce(wf.v, 0) = 0 then 100 else 100 - 100 / (1 + wg.v / wf.v) end as rsi, mc.macd - coalesce(sg.v, 0) as macd_hist, di.p as plus_di, di.m as minus_di, ax.adx as ax
    from n join e20 using (sym, i) join at14 using (sym, i) left join wg using (sym, i) left join wf using (sym, i) join mc using (sym, i) left join sg using (sym, i) join di using (sym, i) left join ax using (sym, i)),
j2 as (select *, coalesce(last_value(ax ignore nulls) over (partition by sym order by i), 0) as adx, ema20 + 2 * atr as kelt_upper, ema20 - 2 * atr as kelt_lower, max(high) {over(12)} - min(low) {over(12)} as reach, sum(atr) {over(14)} as total, avg(close) {over(20)} as m20, coalesce(stddev_pop(close) {over(20)}, 0) as s20,
    median(atr) {over(2016)} as atr_median, list(close) {over(48)} as l, list(close) {over(30)} as c, list(close) {over(20)} as pl, list(rsi) {over(20)} as rl from j1),
j3 as (select *, list_transform(range(1, len(l)), lambda k: case when l[k] <> 0 then (l[k + 1] - l[k]) / l[k] else 0 end) as r, list_avg(l) as la from j2),
j4 as (select *, list_avg(r) as ra, list_stddev_pop(r) as rs, list_concat([0.0], list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: x - la)))) as p, len(pl) // 2 as h from j3),
j5 as (select *, list_transform(range(1, len(r) + 1), lambda k: list_sum(list_transform(r[1:k], lambda x: x - ra))) as walk, {_dfa(4, 5.0)} as f4, {_dfa(8, 42.0)} as f8,
    list_sum(list_transform(range(1, len(c)), lambda k: abs(c[k + 1] - c[k]))) as len1, {_STEP4} as len4,
    list_min(pl[1:h]) as al, list_min(pl[h + 1:]) as bl, list_max(pl[1:h]) as ah, list_max(pl[h + 1:]) as bh, list_min(rl[1:h]) as ql, list_min(rl[h + 1:]) as ul, list_max(rl[1:h]) as qh, list_max(rl[h + 1:]) as uh from j4),
fo as materialized (select sym, ts, i, open, high, low, close, volume, ema20, atr, rsi, macd_hist, plus_di, minus_di, adx, kelt_upper, kelt_lower, {div('close - kelt_lower', 'kelt_upper - kelt_lower', '0.5')} as kelt_pos, {div(div('4 * s20', 'm20'), div('kelt_upper - kelt_lower', 'close'))} as squeeze, {div('atr', 'close')} as atr_ratio,
    case when i >= 14 and reach > 0 and total > 0 then 100 * ln(total / reach) / ln(14) else 50 end as choppiness, atr_median,
    case when len(l) < 8 or rs = 0 or list_max(walk) = list_min(walk) then 0.5 else ln((list_max(walk) - list_min(walk)) / rs) / ln(len(r)) end as hurst,
    case when len(l) < 16 or f4 <= 0 or f8 <= 0 then 0.5 else ln(f8 / f4) / ln(2) end as dfa_alpha,
    case when len(c) < 10 or len1 <= 0 or len4 <= 0 then 1.5 else least(2, greatest(1, ln(len1 / len4) / ln(4))) end as fractal_dim,
    case when len(pl) >= 5 and bl < al and ul > ql then abs((bl - al) - (ul - ql)) else 0 end as rsi_divergence_bull, case when len(pl) >= 5 and bh > ah and uh < qh then abs((bh - ah) - (uh - qh)) else 0 end as rsi_divergence_bear from j5)"""


def _six(names, digits: int = 6) -> str:
    return ", ".join(f"case when round({n}::double, {digits}) = 0 then 0.0::double else round({n}::double, {digits}) end as {n}" for n in names)


@query(f"with {FOLDS} select sym, ts, open, high, low, close, volume, {_six([c for c in folds.COLUMNS if c != 'squeeze'])}, round(squeeze, 5) as squeeze from fo")
def fold_all(spark, d):
    out = folds.fold(by_type(spark, d))
    return rounded(out.withColumn("squeeze", F.round("squeeze", 5)))


# --- facts ---------------------------------------------------------------------------------------------------------


def _r(x: str, digits: int = 2) -> str:
    p = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {p}.0::double + 0.5::double) / {p}.0::double)"


def _clip(x: str) -> str:
    return f"greatest(-1.0::double, least(1.0::double, {x}))"


def _price(x: str) -> str:
    return f"case when close <> 0 then {_r(f'(({x}) / close)', 4)} end"


def _pct(x: str) -> str:
    return f"case when close <> 0 then {_r(_clip(f'(({x}) / (close * 0.01::double))'))} end"


def _span(x: str, flat: str) -> str:
    return f"case when high > low then {_r(f'(({x}) / (high - low))')} else {flat} end"


_MID = "(close - (cloud_top + cloud_bottom) / 2)"
#: module -> (indicators it reads, scaled facts, other facts as (name, kind, value, lo, hi)).
FACTS = {
    "oscillators": (("cci", "mfi", "stochastic", "roc", "folds"), {"rsi": _r("rsi"), "cci": _r("(cci / 300)"), "mfi": _r("(mfi / 100)"), "williams-r": _r("((williams_r + 100) / 100)")}, [(f"roc-{n}", "reciprocal", _r(f"(1 + roc_{n})"), 0.5, 2) for n in (1, 3, 6, 12)]),
    "divergence": (("folds",), {
        "rsi-divergence-bull": f"case when rsi_divergence_bull > 0 then {_r('rsi_divergence_bull')} end", "rsi-divergence-bear": f"case when rsi_divergence_bear > 0 then {_r('rsi_divergence_bear')} end",
        "divergence-spread": f"case when greatest(rsi_divergence_bull, rsi_divergence_bear) > 0 then {_r('(rsi_divergence_bull - rsi_divergence_bear)')} end"}, []),
    "fibonacci": (("range_position",), {"range-pos-12": _r("range_pos_12"), "range-pos-24": _r("range_pos_24"), "range-pos-48": _r("range_pos_48"), **{f"fib-dist-{str(x)[2:].ljust(3, '0')}": _r(f"(range_pos_48 - {x}::double)") for x in (0.236, 0.382, 0.5, 0.618, 0.786)}}, []),
    "persistence": (("autocorrelation", "folds"), {"hurst": _r("hurst"), "autocorrelation": _r("autocorrelation"), "adx": _r("(adx / 100)")}, []),
    "stochastic": (("stochastic",), {"stoch-k": _r("(stoch_k / 100)"), "stoch-d": _r("(stoch_d / 100)"), "stoch-kd-spread": _r("(stoch_k / 100 - stoch_d / 100)"), "stoch-cross-delta": _r(_clip("stoch_cross_delta"))}, []),
    "regime": (("efficiency", "variance_ratio", "entropy", "aroon", "folds"), {
        "kama-er": _r("kama_er"), "choppiness": _r("(choppiness / 100)"), "dfa-alpha": _r("(dfa_alpha / 2)"), "entropy-rate": _r("entropy_rate"), "aroon-up": _r("(aroon_up / 100)"), "aroon-down": _r("(aroon_down / 100)"), "fractal-dim": _r("(fractal_dim - 1)")},
        [("variance-ratio", "reciprocal", _r("greatest(variance_ratio, 0.001::double)"), 0.1, 10)]),
    "timeframe": (("timeframe",), {"tf-1h-trend": _r("tf_1h_body"), "tf-1h-ret": _r("tf_1h_ret", 4), "tf-4h-trend": _r("tf_4h_body"), "tf-4h-ret": _r("tf_4h_ret", 4), "tf-agreement": _r("tf_agreement"), "tf-5m-1h-align": _price("case when tf_1h_body > 0 then close - open else 0 end")}, []),
    "momentum": (("sma", "folds"), {"close-sma20": _price("close - sma20"), "close-sma50": _price("close - sma50"), "close-sma200": _price("close - sma200"), "macd-hist": _price("macd_hist"), "di-spread": _r("((plus_di - minus_di) / 100)")}, [("atr-ratio", "log", _r("greatest(atr_ratio, 0.001::double)", 4), 0.001, 0.5)]),
    "flow": (("obv", "vwap"), {"vwap-distance": _r("vwap_distance", 4), "buying-pressure": _span("close - low", "0.5"), "selling-pressure": _span("high - close", "0.5"), "body-ratio": _span("abs(close - open)", "0")}, [("obv-slope", "reciprocal", "exp(obv_slope_12)", 0.1, 10), ("volume-ratio", "reciprocal", "exp(volume_accel)", 0.1, 10)]),
    "ichimoku": (("ichimoku",), {
        "cloud-position": f"case when close <> 0 then {_r(_clip(f'({_MID} / case when cloud_top > cloud_bottom then greatest(cloud_top - cloud_bottom, close * 0.001::double) else close * 0.01::double end)'))} end",
        "tk-cross-delta": _r(_clip("tk_cross_delta")), "tk-spread": _pct("tenkan_sen - kijun_sen"), "tenkan-dist": _pct("close - tenkan_sen"), "kijun-dist": _pct("close - kijun_sen")},
        [("cloud-thickness", "log", f"case when close <> 0 then {_r('greatest((cloud_top - cloud_bottom) / close, 0.0001::double)', 4)} end", 0.0001, 0.5)]),
    "keltner": (("bollinger", "folds"), {"bb-pos": _r("bb_pos"), "kelt-pos": _r("kelt_pos"), "squeeze": _r("squeeze"), "kelt-upper-dist": _price("close - kelt_upper"), "kelt-lower-dist": _price("close - kelt_lower")}, [("bb-width", "log", _r("greatest(bb_width, 0.001::double)", 4), 0.001, 0.5)]),
    "price-action": (("price_action", "streaks"), {"gap": _r(_clip("gap / 0.05::double"), 4), "body-ratio-pa": _span("abs(close - open)", "0"), "upper-wick": _span("high - greatest(open, close)", "0"), "lower-wick": _span("least(open, close) - low", "0")},
        [("range-ratio", "log", _r("greatest(range_ratio, 0.001::double)", 4), 0.001, 0.5), ("consecutive-up", "log", "1 + consecutive_up", 1, 20), ("consecutive-down", "log", "1 + consecutive_down", 1, 20)]),
    "standard": (("sma", "roc", "obv", "folds"), {"dist-from-high": _price("close - hi48"), "dist-from-low": _price("close - lo48"), "dist-from-midpoint": _price("close - (hi48 + lo48) / 2"), "dist-from-sma200": _price("close - sma200")},
        [*((f"since-{n}", "log", f"coalesce(i - {c} + 1, n48)::double", 1, 100) for n, c in (("rsi-extreme", "last_rsi"), ("vol-spike", "last_vol"), ("large-move", "last_move"))), ("session-depth", "log", "1.0 + n48", 1, 100)]),
}
#: The mean of absolute values with weight 1 / max(n, 100), as a sum in which each value has its weight.
_LEVEL = "list_sum(list_transform(range(1, k + 1), lambda j: abs(l[j]) * case when j > 100 then 1.0 / k when k > 100 then pow(0.99, 100 - j) / k else 0.01 * pow(0.99, k - j) end))"


def scale_sql(source: str, keys: str) -> str:
    """CTEs lv(keys, ts, value, level): source has keys, ts and value."""
    return f"""sl as (select {keys}, list(value order by ts) as l, list(ts order by ts) as tt from {source} group by {keys}),
    lv as (select {keys}, unnest(tt) as ts, unnest(l) as value, unnest(list_transform(range(1, len(l) + 1), lambda k: {_LEVEL})) as level from sl)"""


def facts_sql(module: str) -> str:
    reads, scaled, others = FACTS[module]
    if "folds" in reads:
        base = f"{FOLDS}, b0 as (select * from fo)"
    else:
        base = f"{NUMBERED}, b0 as (select * from n)"
    joined = " ".join(f"join {RAW[r]} as r_{r} using (sym, ts)" for r in reads if r != "folds")
    extra = f", max(high) {over(48)} as hi48, min(low) {over(48)} as lo48, count(*) {over(48)} as n48, max(case when rsi > 80 or rsi < 20 then i end) {over(48)} as last_rsi, max(case when volume_accel > 2 then i end) {over(48)} as last_vol, max(case when abs(roc_1) > 0.02 then i end) {over(48)} as last_move" if module == "standard" else ""
    s = " union all ".join(f"select sym, ts, '{n}' as name, ({e})::double as value from x where ({e}) is not null" for n, e in scaled.items())
    o = "".join(f" union all select sym, ts, '{module}', '{n}', '{k}', round(({e})::double, 6), {float(lo)}::double, {float(hi)}::double from x where ({e}) is not null" for n, k, e, lo, hi in others)
    return f"""with {base}, x as materialized (select *{extra} from b0 {joined}), v as (select sym, ts, name, case when value = 0 then 0.0::double else value end as value from ({s})), {scale_sql('v', 'sym, name')},
    sc as (select *, {_r('greatest(round(2 * level, 10), 0.001::double)')} as s from lv)
    select sym, ts, '{module}' as module, name, 'scaled' as kind, round(case when s > 0 then {_r('(value / (s * 0.05::double))', 0)} * (s * 0.05::double) else value end, 6) as value, round(-s, 6) as lo, round(s, 6) as hi from sc{o}"""


def enriched(spark, d):
    return vocabulary.standard(indicators.time_parts(indicators.enrich(folds.fold(by_type(spark, d)))))


def _add(module: str) -> None:
    def run(spark, d):
        return rounded(vocabulary.facts(enriched(spark, d), (module,)))

    run.__name__ = "facts_" + module.replace("-", "_")
    sql = facts_sql(module)
    # No negative zeros on either side.
    query(f"select sym, ts, module, name, kind, {', '.join(f'case when {c} = 0 then 0.0::double else {c} end as {c}' for c in ('value', 'lo', 'hi'))} from ({sql})")(run)


for _module in FACTS:
    _add(_module)


_TIME = [("minute", "minute(ts)", 60), ("hour", "hour(ts)", 24), ("day-of-week", "isodow(ts) - 1", 7), ("day-of-month", "day(ts)", 31), ("month-of-year", "month(ts)", 12)]
_PAIRS = [("minute-x-hour", "minute(ts)", "hour(ts)"), ("hour-x-day-of-week", "hour(ts)", "isodow(ts) - 1"), ("day-of-week-x-month-of-year", "isodow(ts) - 1", "month(ts)")]


def _time_sql(module: str, names: tuple[str, ...], pairs: bool) -> str:
    from candlemill.plans.catalogue import BY_TYPE

    rows = [f"select sym, ts, '{module}' as module, '{n}' as name, 'circular' as kind, ({e})::double as value, 0.0::double as lo, {float(p)}::double as hi from c" for n, e, p in _TIME if n in names]
    rows += [f"select sym, ts, '{module}', '{n}', 'pair', ({a})::double, ({b})::double, 0.0::double from c" for n, a, b in _PAIRS] if pairs else []
    return f"with {BY_TYPE} " + " union all ".join(rows)


@query(_time_sql("time", tuple(n for n, _, _ in _TIME), True))
def facts_time(spark, d):
    return vocabulary.facts(indicators.time_parts(by_type(spark, d)), ("time",))


@query(_time_sql("exit-time", ("hour", "day-of-week"), False))
def facts_exit_time(spark, d):
    return vocabulary.facts(indicators.time_parts(by_type(spark, d)), ("exit-time",))


@query()
def vocabulary_facts(spark, d):
    """All modules in one pass; each has a query with SQL of its own."""
    return rounded(vocabulary.facts(enriched(spark, d)))


_LENS_ROWS = """('dow-trend', 'time momentum persistence regime timeframe'), ('dow-volume', 'time flow standard keltner'), ('dow-cycle', 'time oscillators keltner momentum standard timeframe'), ('dow-generalist', 'time momentum persistence regime timeframe flow standard keltner oscillators'),
('pring-impulse', 'time oscillators momentum persistence'), ('pring-confirmation', 'time flow oscillators divergence timeframe'), ('pring-regime', 'time regime persistence keltner'), ('pring-generalist', 'time oscillators momentum persistence flow divergence timeframe regime keltner'),
('wyckoff-effort', 'time flow price-action oscillators standard'), ('wyckoff-persistence', 'time persistence regime momentum oscillators'), ('wyckoff-position', 'time momentum standard regime divergence fibonacci'), ('core', 'regime exit-time'), ('full', 'regime exit-time phase-current phase-scalar')"""

@query(f"""with {FOLDS}, k as (select count(*) as n, count(*) filter (close <> 0) as z, count(*) filter (rsi_divergence_bull > 0) + count(*) filter (rsi_divergence_bear > 0) + count(*) filter (rsi_divergence_bull > 0 or rsi_divergence_bear > 0) as dv from fo),
m(module, fixed, priced) as (values ('time', 8, 0), ('exit-time', 2, 0), ('oscillators', 8, 0), ('fibonacci', 8, 0), ('persistence', 3, 0), ('stochastic', 4, 0), ('regime', 8, 0), ('timeframe', 5, 1), ('momentum', 2, 4), ('flow', 6, 0), ('ichimoku', 1, 5), ('keltner', 4, 2), ('price-action', 7, 0), ('standard', 4, 4), ('divergence', 0, 0)),
l(lens, ms) as (values {_LENS_ROWS}), u as (select lens, unnest(string_split(ms, ' ')) as module from l)
select lens, module, fixed * k.n + priced * k.z + case when module = 'divergence' then k.dv else 0 end as n from u join m using (module), k""")
def lens_fact_counts(spark, d):
    return vocabulary.lens_facts(vocabulary.facts(enriched(spark, d))).groupBy("lens", "module").agg(F.count("*").alias("n"))


@query(f"with {NUMBERED}, v as (select sym, ts, 'close' as name, close as value from n union all select sym, ts, 'move', coalesce(close - pc, 0) from n), {scale_sql('v', 'sym, name')} select sym, name, ts, round(value, 6) as value, round(level, 6) as ema_abs, round({_r('greatest(round(2 * level, 10), 0.001::double)')}, 6) as scale from lv")
def scale_tracker(spark, d):
    w = Window.partitionBy("sym").orderBy("ts")
    e = by_type(spark, d).withColumn("move", F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0)))
    long = e.select("sym", "ts", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("close", "move")))).alias("f")).select("sym", "ts", "f.*")
    n, level = vocabulary.tracked(F.col("value"), ["sym", "name"], ["ts"])
    out = long.withColumn("_n", n).withColumn("ema_abs", level)
    return rounded(out.select("sym", "name", "ts", "value", "ema_abs", vocabulary.scale_of(F.col("ema_abs")).alias("scale")))


# --- phases --------------------------------------------------------------------------------------------------------

# A phase takes in the row that ends it: the rows of one generation and the first of the next.
_RECORDS = ORACLES["phase_labels"].rsplit(") select j.sym", 1)[0] + """), pr as (select j.sym, j.i, j.close, ph.label, ph.direction, ph.generation from ph join j on j.sym = ph.sym and j.i = ph.i),
vo as (select sym, row_number() over (partition by sym order by ts) as i, volume from c), pv as (select pr.*, vo.volume from pr join vo using (sym, i)),
sp as (select sym, generation, any_value(label) as label, min(i) as a from pv group by 1, 2), en as (select sp.*, lead(a) over (partition by sym order by generation) as b from sp),
rc as materialized (select en.sym, en.generation, en.label, arg_max(pv.direction, pv.i) filter (pv.i < en.b) as direction, en.a - 1 as start_candle, en.b - 1 as end_candle, count(*) as duration, min(pv.close) as close_min, max(pv.close) as close_max, avg(pv.close) as close_avg, arg_min(pv.close, pv.i) as close_open, arg_max(pv.close, pv.i) as close_final, avg(pv.volume) as volume_avg
    from en join pv on pv.sym = en.sym and pv.i between en.a and en.b where en.b is not null group by en.sym, en.generation, en.label, en.a, en.b)
"""


@query(_RECORDS + "select sym, label, direction, start_candle, end_candle, duration, " + ", ".join(f"round({c}, 6) as {c}" for c in ("close_min", "close_max", "close_avg", "close_open", "close_final", "volume_avg")) + " from rc")
def phase_records(spark, d):
    return rounded(folds.phase_records(folds.fold(by_type(spark, d), ("atr",))))


_CHANGE = "case when p > 0 then " + _r("((close_avg - p) / p)", 4) + " end"


def _last_pair(label: str) -> str:
    return f"last_value(case when label = '{label}' and p is not null then struct_pack(t := {_CHANGE}) end ignore nulls) over (partition by sym order by start_candle, end_candle)"


@query(_RECORDS + f""", lb as (select *, lag(close_avg) over (partition by sym, label order by start_candle, end_candle) as p, lag(close_max - close_min) over (partition by sym order by start_candle, end_candle) as w, lag(duration) over (partition by sym order by start_candle, end_candle) as q from rc)
select sym, label, start_candle, round(({_last_pair('Valley')}).t, 6) as valley_trend, round(({_last_pair('Peak')}).t, 6) as peak_trend, case when w > 0 then {_r('((close_max - close_min) / w)')} end as range_trend, case when q > 0 then {_r('(duration / q)')} end as spacing_trend from lb""")
def phase_scalars(spark, d):
    return rounded(vocabulary.phase_scalars(folds.phase_records(folds.fold(by_type(spark, d), ("atr",)))))


@query(ORACLES["phase_labels"].rsplit(" select j.sym", 1)[0] + f""", pl as materialized (select j.sym, j.ts, ph.label, ph.direction, ph.duration from ph join j on j.sym = ph.sym and j.i = ph.i), v as (select sym, ts, 'phase-duration' as name, duration::double as value from pl), {scale_sql('v', 'sym, name')},
sc as (select *, {_r('greatest(round(2 * level, 10), 0.001::double)')} as s from lv)
select sym, ts, 'phase-current' as module, name, 'scaled' as kind, round(case when s > 0 then {_r('(value / (s * 0.05::double))', 0)} * (s * 0.05::double) else value end, 6) as value, round(-s, 6) as lo, round(s, 6) as hi from sc
union all select sym, ts, 'phase-current', 'phase-' || lower(label) || case when label = 'Transition' then '-' || lower(direction) else '' end, 'atom', 1.0::double, 0.0::double, 0.0::double from pl""")
def facts_phase_current(spark, d):
    return rounded(vocabulary.phase_current(folds.phases(folds.fold(by_type(spark, d), ("atr",)))))


# --- rhythms -------------------------------------------------------------------------------------------------------

_SPECS = "momentum 7, oscillators 9, flow 3, persistence 3, regime 8, keltner 4, timeframe 3, divergence 2, price-action 4, fibonacci 3".split(", ")


@query(f"""with m(module, n) as (values {', '.join(f"('{x.split()[0]}', {x.split()[1]})" for x in _SPECS)}), l(lens, ms) as (values {_LENS_ROWS}), u as (select lens, unnest(string_split(ms, ' ')) as module from l)
select lens, (sum(n) + (lens = 'full')::int)::bigint as specs from u join m using (module) group by 1""")
def lens_rhythm_specs(spark, d):
    return rhythms.specs(spark).groupBy("lens").agg(F.count("*").alias("specs"))


@query()
def indicator_rhythms(spark, d):
    """Every indicator's rhythm at every candle, 64 wide, as digests."""
    e = enriched(spark, d).join(folds.phases(folds.fold(by_type(spark, d), ("atr",))).select("sym", "ts", "phase_duration"), ["sym", "ts"])
    r = rhythms.indicator_rhythms(e, 64)
    return r.select("sym", "ts", "name", F.sha2(V.to_hex(F.col("rhythm")), 256).alias("rhythm"))
