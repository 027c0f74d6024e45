"""Queries of harmonic patterns, first-generation regime measures, predicates and rhythms of phases. The SQL is written from
the definitions: swings are range-joined to each candle and runs are numbered anew there; regime measures come from lists."""

from __future__ import annotations


from pyspark.sql import functions as F

from candlemill.operators import folds, patterns, phase_rhythm, predicates
from candlemill.plans.catalogue import BY_TYPE, by_type, over, query, rounded, table
from candlemill.plans.facts import _RECORDS, FOLDS
from candlemill.sources.candles import daily_orders

_LEGS = ("ab_xa", "bc_ab", "cd_ab", "ad_xa")
_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', {', '.join(f'{lo}::double, {hi}::double' for lo, hi in limits)})" for k, (name, *limits) in enumerate(patterns.TEMPLATES))
_BEFORE, _AFTER = (f"over (partition by sym order by ts rows between {a} and {b})" for a, b in (("5 preceding", "1 preceding"), ("1 following", "5 following")))
_SWINGS = f"""n as (select *, row_number() over (partition by sym order by ts) - 1 as i from c),
f as (select *, count(*) {_BEFORE} = 5 and count(*) {_AFTER} = 5 as whole, high > max(high) {_BEFORE} and high > max(high) {_AFTER} as top, low < min(low) {_BEFORE} and low < min(low) {_AFTER} as bottom from n),
s as (select sym, i, 1 as o, high as price, true as up from f where whole and top union all select sym, i, 2, low, false from f where whole and bottom)"""
_ORDERS = """k as (select (o_custkey % 20)::varchar as sym, date_trunc('day', o_orderdate)::timestamp as ts, o_totalprice as p, row_number() over (partition by o_custkey % 20, date_trunc('day', o_orderdate) order by o_orderdate, o_orderkey) as r from orders),
c as (select sym, ts, max(p) as high, min(p) as low, arg_max(p, r) as close from k group by 1, 2)"""
_HARMONICS = f"""with {_ORDERS}, {_SWINGS},
w as (select n.sym, n.ts, n.i as t, n.close, s.i, s.o, s.price, s.up from n join s on s.sym = n.sym and s.i between n.i - 250 and n.i - 5 where n.i >= 29),
g as (select *, (lag(up) over (partition by sym, t order by i, o) is distinct from up)::int as cut from w), r as (select *, sum(cut) over (partition by sym, t order by i, o) as run from g),
z as (select sym, ts, t, close, run, bool_or(up) as up, case when bool_or(up) then max(price) else min(price) end as price from r group by sym, ts, t, close, run),
l as (select sym, ts, close as d, row_number() over q - 1 as back, price as c, lead(price) over q as b, lead(price, 2) over q as a, lead(price, 3) over q as x, lead(up, 3) over q as xup from z window q as (partition by sym, t order by run desc)),
m as (select *, abs(a - b) / abs(x - a) as ab_xa, abs(b - c) / abs(a - b) as bc_ab, abs(c - d) / abs(a - b) as cd_ab, abs(a - d) / abs(x - a) as ad_xa from l where back < 3 and x is not null and abs(x - a) >= 1e-10 and abs(a - b) >= 1e-10 and abs(b - c) >= 1e-10),
t(k, pattern, {', '.join(f'{n}_lo, {n}_hi' for n in _LEGS)}) as (values {_TEMPLATE_ROWS})
select sym, ts, back::int as back, pattern, not xup as bullish, round(({' + '.join(f'1 - least(abs({n} - ({n}_lo + {n}_hi) / 2) / (({n}_hi - {n}_lo) / 2), 1)' for n in _LEGS)}) / 4, 6) as quality
from m join t on {' and '.join(f'{n} between {n}_lo and {n}_hi' for n in _LEGS)} qualify row_number() over (partition by sym, ts, back order by k) = 1"""


@query(_HARMONICS)
def harmonic_patterns(spark, d):
    """Daily candles of orders, by groups of customers."""
    return rounded(patterns.harmonics(daily_orders(table(spark, d, "orders"))))


_S = "list_sum"
_REGIME = f"""{BY_TYPE}, q as (select *, count(*) {over(60)} as n, list(close) {over(60)} as cl, list(high) {over(26)} as hl, list(low) {over(26)} as ll from c),
a as (select *, list_min(cl) > 0 as whole, case when list_min(cl) > 0 then list_transform(range(1, len(cl)), lambda k: ln(cl[k + 1] / cl[k])) end as r from q where n >= 20),
b as (select *, list_sum(list_transform(r, lambda x: x * x)) / len(r) as v1, list_sum(list_transform(range(1, len(r) - 3), lambda k: pow(list_sum(r[k:k + 4]), 2))) / (len(r) - 4) / 5 as v5,
    list_transform(r, lambda x: case when x > 0.0001 then 2 when x < -0.0001 then 0 else 1 end) as k, list_sort(list_transform(r, lambda x: abs(x))) as m,
    list_transform(range(5, len(cl) + 1), lambda j: sign(cl[j] - cl[j - 4])::int) as sg,
    list_sum(list_transform(range(1, len(cl)), lambda j: sqrt(pow(cl[j + 1] - cl[j], 2) + 1))) as path, list_max(list_transform(cl, lambda x: abs(x - cl[1]))) as far from a),
e as (select *, list_transform(range(1, len(k)), lambda j: 3 * k[j] + k[j + 1]) as pr, list_filter(list_transform([1, 2, 3, 4], lambda j: m[(len(m) * j) // 5 + 1]), lambda x: x >= 1e-10) as mk from b),
h as (select *, list_transform(range(0, 9), lambda x: len(list_filter(pr, lambda y: y = x))) as cnt, list_transform(mk, lambda x: ln(x)) as lx, list_transform(mk, lambda x: ln(len(list_filter(m, lambda y: y >= x)))) as ly from e),
o as (select sym, ts, case when v1 > 1e-20 then v5 / v1 end as vr,
    case when sg[-1] = 0 then 0 else sg[-1] * (list_position(list_reverse(list_transform(sg, lambda x: x <> sg[-1])), true) - 1) end as td_run, sg,
    100.0 * (len(hl) - list_position(list_reverse(hl), list_max(hl))) / (len(hl) - 1) as up, 100.0 * (len(ll) - list_position(list_reverse(ll), list_min(ll))) / (len(ll) - 1) as down,
    case when path > 1e-10 and far > 1e-10 and ln(len(cl)) + ln(far / path) <> 0 then greatest(1, least(2, ln(len(cl)) / (ln(len(cl)) + ln(far / path)))) end as katz,
    case when len(r) >= 20 then list_sum(list_transform(range(0, 9), lambda x: case when cnt[x + 1] > 0 then -cnt[x + 1] / len(pr) * ln(cnt[x + 1] / list_sum(cnt[(x // 3) * 3 + 1:(x // 3) * 3 + 3])) else 0 end)) / ln(3) end as conditional_entropy,
    case when len(r) >= 20 and len(mk) >= 3 and abs(len(lx) * {_S}(list_transform(lx, lambda x: x * x)) - pow({_S}(lx), 2)) > 1e-10
        then -(len(lx) * {_S}(list_transform(range(1, len(lx) + 1), lambda j: lx[j] * ly[j])) - {_S}(lx) * {_S}(ly)) / (len(lx) * {_S}(list_transform(lx, lambda x: x * x)) - pow({_S}(lx), 2)) end as b_value from h),
x as (select *, (case when td_run is not null then td_run when sg[-1] is null then 0 else sg[-1] * len(sg) end)::int as td from o)"""
_MEASURES = ("vr", "td", "up", "down", "katz", "conditional_entropy", "b_value")


@query(f"with {_REGIME} select sym, ts, td, {', '.join(f'round({m}::double, 6) as {m}' for m in _MEASURES if m != 'td')} from x")
def regime_extras(spark, d):
    return rounded(patterns.regime_extras(by_type(spark, d)))


_ZONE_SQL = " union all ".join(f"select sym, ts, '{name}' as indicator, case {' '.join(f'when {c} then {z!r}' for c, z in rules)} end as zone from x" for name, rules in patterns.ZONES.items())


@query(f"with {_REGIME} select * from ({_ZONE_SQL}) where zone is not null")
def regime_extra_zones(spark, d):
    return patterns.zone_facts(patterns.regime_extras(by_type(spark, d)))


# --- predicates ----------------------------------------------------------------------------------------------------

_SQL_FIELDS = {**predicates.FIELDS, "macd-line": "case when i >= 26 then macd_line else 0 end"}
_MAP = f"map([{', '.join(repr(n) for n in _SQL_FIELDS)}], [{', '.join(f'({e})::double' for e in _SQL_FIELDS.values())}])"
_RICH = f"""with {FOLDS}, ml as (select fo.*, mc.macd as macd_line, coalesce(sg.v, 0) as macd_signal from fo join mc using (sym, i) left join sg using (sym, i)),
iw as (select *, avg(close) {over(20)} as sma20, avg(close) {over(50)} as sma50, avg(close) {over(200)} as sma200, avg(close) {over(20)} + 2 * coalesce(stddev_pop(close) {over(20)}, 0) as bb_upper, avg(close) {over(20)} - 2 * coalesce(stddev_pop(close) {over(20)}, 0) as bb_lower,
    max(high) {over(14)} as hi, min(low) {over(14)} as lo, count(*) {over(14)} as n14, {', '.join(f'(max(high) {over(n)} + min(low) {over(n)}) / 2 as {x}' for n, x in ((9, 'tenkan_sen'), (26, 'kijun_sen'), (52, 'senkou_b')))} from ml),
ik as (select *, case when n14 = 14 then case when hi <> lo then 100 * (close - lo) / (hi - lo) else 50 end end as kk from iw),
id as (select *, coalesce(kk, 50) as stoch_k, coalesce(avg(kk) {over(3)}, 50) as stoch_d, (tenkan_sen + kijun_sen) / 2 as senkou_a, greatest((tenkan_sen + kijun_sen) / 2, senkou_b) as cloud_top, least((tenkan_sen + kijun_sen) / 2, senkou_b) as cloud_bottom from ik),
mp as (select sym, ts, i, greatest(atr_ratio, 0.001::double) * 0.1::double as touch, {_MAP} as m from id), rc as materialized (select *, lag(m) over (partition by sym order by i) as w from mp)"""
_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in predicates.PAIRS)
_NONZERO = "case when {m}[{n}] <> 0 or {n} in ('candle-range', 'candle-body', 'upper-wick', 'lower-wick') then {m}[{n}] end".format
_COMPARED = f"""{_RICH}, pr(a, b) as (values {_PAIR_ROWS}),
v as (select sym, ts, touch, a, b, w is null as is_first, b like 'prev-%' as pv, {_NONZERO(m='m', n='a')} as x, case when b like 'prev-%' then w[replace(b, 'prev-', '')] else {_NONZERO(m='m', n='b')} end as y, {_NONZERO(m='w', n='a')} as wx, {_NONZERO(m='w', n='b')} as wy from rc, pr),
u as (select *, not pv and (is_first or (wx is not null and wy is not null)) and abs(x - y) < touch as near from v where x is not null and y is not null)
select sym, ts, case when x > y then 'above' else 'below' end as predicate, a, b from u
union all select sym, ts, 'crosses-above', a, b from u where not pv and wx < wy and x >= y union all select sym, ts, 'crosses-below', a, b from u where not pv and wx > wy and x <= y
union all select sym, ts, 'touches', a, b from u where near union all select sym, ts, 'bounces-off', a, b from u where near and abs(wx - wy) < touch and abs(x - y) > abs(wx - wy)"""


@query(_COMPARED)
def predicate_facts(spark, d):
    return predicates.comparisons(predicates.fields(by_type(spark, d)))


@query(_RICH + " union all ".join(f"{',' if not k else ''} {'z as (' if not k else ''}select sym, ts, 'at' as predicate, '{n}' as a, '{z}' as b from rc where " + r.replace("x", f"m['{n}']") for k, (n, z, r) in enumerate(predicates.ZONES)) + ") select * from z")
def predicate_zones(spark, d):
    return predicates.zones(predicates.fields(by_type(spark, d)))


_CROSSED = " union all ".join(
    f"select sym, i, 'crosses-{name}' as predicate, '{a}' as a, '{b}' as b from rc where {' and '.join(f'{m}[{c!r}] <> 0' for m in 'mw' for c in ((a, b) if a.startswith('sma') else (a,)))} and w['{a}'] {before} w['{b}'] and m['{a}'] {now} m['{b}']"
    for a, b in predicates.REMEMBERED for name, before, now in (("above", "<", ">="), ("below", ">", "<="))
)


@query(f"{_RICH}, ev as ({_CROSSED}) select rc.sym, rc.ts, predicate, a, b, (rc.i - ev.i)::int as bars from ev join rc on rc.sym = ev.sym and rc.i between ev.i + 1 and ev.i + 12")
def predicate_since(spark, d):
    return predicates.since(predicates.fields(by_type(spark, d)))


# --- rhythm of phases ----------------------------------------------------------------------------------------------


def _delta(a: str, b: str) -> str:
    return f"case when abs({b}) > 0.0001 then ({a} - {b}) / abs({b}) when {b} is not null then 0 end"


_FACTS_SQL = _RECORDS + f""", fx as (select *, case when label <> 'Transition' then lower(label) when direction = 'None' then 'transition' else 'transition-' || lower(direction) end as kind,
    case when close_open > 0 then (close_final - close_open) / close_open else 0 end as mv, case when close_avg > 0 then (close_max - close_min) / close_avg else 0 end as rg, end_candle - 2016 as cut from rc),
pq as (select a.*, (select count(*) from fx m where m.sym = a.sym and m.start_candle <= a.start_candle and m.start_candle >= a.cut) as phases,
    lag(start_candle) over p >= cut as has_p, lag(duration) over p as pd, lag(mv) over p as pm, lag(volume_avg) over p as pv, lag(start_candle) over s >= cut as has_s, lag(duration) over s as sd, lag(mv) over s as sm, lag(volume_avg) over s as sv
    from fx a window p as (partition by sym order by start_candle), s as (partition by sym, kind order by start_candle)),
ff as (select sym, end_candle, phases, kind, duration::double as rec_duration, mv as rec_move, rg as rec_range, volume_avg as rec_volume,
    case when has_p then {_delta('duration', 'pd')} end as prior_duration_delta, case when has_p then mv - pm end as prior_move_delta, case when has_p then {_delta('volume_avg', 'pv')} end as prior_volume_delta,
    case when has_s then mv - sm end as same_move_delta, case when has_s then {_delta('duration', 'sd')} end as same_duration_delta, case when has_s then {_delta('volume_avg', 'sv')} end as same_volume_delta from pq)
select n.sym, n.ts, phases, kind, {', '.join(f'round({x}::double, 6) + 0 as {x}' for x in phase_rhythm.NAMES)} from n asof left join ff on ff.sym = n.sym and n.i - 1 >= ff.end_candle"""


@query(_FACTS_SQL)
def phase_rhythm_facts(spark, d):
    """At each candle the facts of the phase that closed last, and how many phases are in memory."""
    base = by_type(spark, d)
    h = phase_rhythm.histories(folds.phase_records(folds.fold(base, ("atr",)))).withColumn("last", F.element_at("history", -1))
    facts = h.select("sym", "end_candle", F.size("history").alias("phases"), "last.*")
    return rounded(phase_rhythm.at_candles(base, facts, ["phases", "kind", *phase_rhythm.NAMES]))


@query()
def phase_rhythms(spark, d):
    """At each candle the rhythm of the phases closed by then, at the full width, as a digest."""
    base = by_type(spark, d)
    r = phase_rhythm.rhythms(folds.phase_records(folds.fold(base, ("atr",))))
    return phase_rhythm.at_candles(base, r.select("sym", "end_candle", "phases", F.sha2("rhythm", 256).alias("rhythm")), ["phases", "rhythm"])
