"""Queries of flips, streaks, coverage and accumulation, and their SQL: the labeler as a recursive query, positions as joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.operators import folds, phase_trades
from candlemill.plans.catalogue import NUMBERED, by_type, query, recursive, rounded

_FLIPS = f"""with recursive {NUMBERED}, {recursive('t', 14, '(13.0/14)', '(1.0/14)', 'a', 0, 'tr')},
j as materialized (select n.sym, n.i - 1 as pos, n.close, a.v as atr, row_number() over (partition by n.sym order by n.i) as k from n join a on n.sym = a.sym and n.i = a.i where a.v >= 0.01),
st(sym, multiplier, k, kind, extreme, since, ended, low, began, price, pos) as (
    select sym, m.multiplier::double, k, 'rising', close, pos, null::varchar, null::double, null::bigint, close, pos from j, (select unnest([1.5, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30]) as multiplier) m where k = 1
    union all
    select sym, multiplier, k, case when not turned then kind when kind = 'rising' then 'falling' else 'rising' end, case when turned then close else tracked end, case when turned then pos else since end,
        case when turned then kind end, case when turned then tracked end, case when turned then since end, close, pos
    from (select *, case when kind = 'rising' then close > tracked + multiplier * atr else close < tracked - multiplier * atr end as turned
        from (select j.sym, st.multiplier, j.k, st.kind, st.since, j.close, j.atr, j.pos, case when st.kind = 'rising' then least(st.extreme, j.close) else greatest(st.extreme, j.close) end as tracked
            from st join j on j.sym = st.sym and j.k = st.k + 1))),
f as materialized (select sym, multiplier, row_number() over (partition by sym, multiplier order by pos) as flip, ended as kind, began as start, pos as "end", price, low as extreme from st where ended is not null),
td as (select *, case when kind = 'rising' then 'short' else 'long' end as direction, lead(price) over w as exit, lead("end") over w - "end" as held from f window w as (partition by sym, multiplier order by flip)),
tr2 as (select sym, multiplier, flip, direction, price as entry, exit, case when price <> 0 then case when direction = 'long' then exit - price else price - exit end / price end as residue, held from td where exit is not null),
tn as (select *, residue - 0.007 as net from tr2),
b as (select *, coalesce(case when kind = 'rising' then extreme > lag(extreme) over w else extreme < lag(extreme) over w end, false) as beats from f window w as (partition by sym, multiplier, kind order by flip)),
isl as (select *, count(*) filter (not beats) over (partition by sym, multiplier, kind order by flip) as island from b),
cnt as materialized (select *, count(*) filter (beats) over (partition by sym, multiplier, kind, island order by flip) as beaten, lead(start) over (partition by sym, multiplier order by flip) as ns, lead("end") over (partition by sym, multiplier order by flip) as ne from isl),
cv as materialized (select distinct sym, multiplier, case when kind = 'rising' then 'buy' else 'sell' end as side, unnest(range(s, e + 1)) as row from (select *, start as s, "end" as e from cnt where beaten >= 2 union all select *, ns, ne from cnt where beaten >= 2 and ns is not null))
"""


def found(spark, d):
    return phase_trades.sweep(folds.fold(by_type(spark, d), ("atr",)))


@query(_FLIPS + 'select sym, multiplier, flip, kind, start, "end", round(price, 6) as price, round(extreme, 6) as extreme from f')
def flip_phases(spark, d):
    return rounded(found(spark, d))


@query(_FLIPS + "select sym, multiplier, flip, direction, round(entry, 6) as entry, round(exit, 6) as exit, round(residue, 6) as residue, round(net, 6) as net, held from tn")
def flip_trades(spark, d):
    return rounded(phase_trades.flip_trades(found(spark, d)))


_SUMMARY = "count(*) as trades, round(avg((residue > 0)::int), 6) as gross_rate, round(avg((net > 0)::int), 6) as net_rate, round(avg(held), 6) as held, round(avg(residue), 6) as residue, round(avg(net), 6) as net, round(sum(net), 6) as total"


@query(_FLIPS + f"select sym, multiplier, {_SUMMARY} from tn group by 1, 2")
def flip_sweep(spark, d):
    return rounded(phase_trades.trade_summary(phase_trades.flip_trades(found(spark, d))))


@query(_FLIPS + f"select sym, multiplier, direction, {_SUMMARY} from tn group by 1, 2, 3")
def flip_directions(spark, d):
    return rounded(phase_trades.trade_summary(phase_trades.flip_trades(found(spark, d)), "direction"))


@query(_FLIPS + "select sym, multiplier, case when net < -0.03 then 0 when net < -0.01 then 1 when net < 0 then 2 when net < 0.01 then 3 when net < 0.03 then 4 else 5 end as bucket, count(*) as n from tn where net is not null group by 1, 2, 3")
def flip_buckets(spark, d):
    t = phase_trades.flip_trades(found(spark, d)).where("net is not null")
    return t.groupBy("sym", "multiplier", phase_trades.bucket(F.col("net")).alias("bucket")).agg(F.count("*").alias("n"))


@query(_FLIPS + "select sym, multiplier, kind, (max(beaten) + 1)::bigint as length, min(flip) as first, max(flip) as last from cnt group by sym, multiplier, kind, island having max(beaten) >= 2")
def flip_streaks(spark, d):
    return phase_trades.streaks(found(spark, d))


@query(_FLIPS + """, p as (select sym, multiplier, row, count(*) filter (side = 'buy') as b, count(*) filter (side = 'sell') as s from cv group by 1, 2, 3), len as (select sym, count(*) as total from n group by 1),
g as (select sym, multiplier, sum(b)::bigint as buy, sum(s)::bigint as sell, count(*) as either, sum(b * s)::bigint as both from p group by 1, 2) select g.*, total - either as neither from g join len using (sym)""")
def flip_coverage(spark, d):
    c = by_type(spark, d)
    return phase_trades.coverage(phase_trades.covered(found(spark, d)), c.groupBy("sym").agg(F.count("*").alias("total")))


@query(_FLIPS + """, i as (select *, row - row_number() over (partition by sym, multiplier, side order by row) as island from cv), r as (select sym, multiplier, side, island, count(*) as n from i group by all)
select sym, multiplier, side, count(*) as runs, round(avg(n), 6) as mean, max(n) as longest, min(n) as shortest, list_sort(list(n))[count(*) // 2 + 1] as median from r group by 1, 2, 3""")
def flip_coverage_runs(spark, d):
    return rounded(phase_trades.coverage_runs(phase_trades.covered(found(spark, d))))


# A position's fate, by joins: its first stop, its first break with something left, and the breaks before both.
@query(_FLIPS + """, z as materialized (select sym, i - 1 as pos, close, high, low, max(i - 1) over (partition by sym) as last from n),
ac as (select sym, case when kind = 'rising' then 'long' else 'short' end as side, "end" as a, lead("end") over (partition by sym, kind order by flip) as b, beaten from cnt where multiplier = 2),
en as materialized (select distinct z.sym, ac.side, z.pos, z.close as price from ac join z on ac.sym = z.sym and ac.beaten >= 2 and z.pos between ac.a and coalesce(ac.b, z.last)),
bx as (select sym, case when kind = 'rising' then 'long' else 'short' end as side, "end" as pos, coalesce(case when kind = 'rising' then extreme <= lag(extreme) over w else extreme >= lag(extreme) over w end, false) as broken from f where multiplier = 2 window w as (partition by sym, kind order by flip)),
ps as (select en.*, unnest([0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3])::double as stop from en),
sp as materialized (select ps.sym, ps.side, ps.pos, ps.stop, any_value(ps.price) as price, min(case when case when ps.side = 'long' then z.low <= ps.price * (1 - stop) else z.high >= ps.price * (1 + stop) end then z.pos end) as stop_at from ps left join z on z.sym = ps.sym and z.pos > ps.pos group by 1, 2, 3, 4),
br as materialized (select sp.*, z.pos as break_at, 50 * case when sp.side = 'long' then z.close / sp.price else sp.price / z.close end - 50 - 50 * 0.0035 as rest from sp join bx on bx.sym = sp.sym and bx.side = sp.side and bx.broken and bx.pos > sp.pos join z on z.sym = bx.sym and z.pos = bx.pos where sp.stop_at is null or bx.pos < sp.stop_at),
gr as (select sym, side, pos, stop, min(break_at) filter (rest > 0) as grace_at, arg_min(rest, break_at) filter (rest > 0) as rest from br group by 1, 2, 3, 4),
hl as (select br.sym, br.stop, count(*) as held from br join gr using (sym, side, pos, stop) where br.rest <= 0 and (gr.grace_at is null or br.break_at < gr.grace_at) group by 1, 2),
ou as (select sp.sym, sp.side, sp.stop, sp.price, gr.grace_at is not null as grace, gr.grace_at is null and stop_at is not null as stopped, coalesce(gr.rest, 0) as rest, case when sp.side = 'long' then 1 - sp.stop else 1 / (1 + sp.stop) end as ratio from sp left join gr using (sym, side, pos, stop)),
lc as (select sym, close as last_close from z where pos = last),
su as (select ou.sym, stop, count(*) filter (grace) as grace, count(*) filter (stopped) as stopped, count(*) filter (not grace and not stopped) as open, sum(50 * 1.0035) as deployed,
    sum(case when grace then 50 when stopped then 50 * ratio * 0.9965 else 0 end) as recovered, sum(case when grace then rest else 0 end) as residue, sum(case when stopped then 50 * 1.0035 - 50 * ratio * 0.9965 else 0 end) as lost,
    sum(50 * 0.0035 + case when grace then 50 * 0.0035 when stopped then 50 * ratio * 0.0035 else 0 end) as fees, sum(case when grace or stopped then 0 when side = 'long' then 50 * last_close / price else 50 * price / last_close end) as worth
    from ou join lc using (sym) group by 1, 2),
al as (select distinct z.sym, s.stop::double as stop from z, (select unnest([0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3]) as stop) s)
select sym, stop, coalesce(grace, 0) as grace, coalesce(stopped, 0) as stopped, coalesce(held, 0) as held, coalesce(open, 0) as open, """ + ", ".join(f"round(coalesce({c}, 0)::double, 4) as {c}" for c in ("deployed", "recovered", "residue", "lost", "fees", "worth")) + """, round(coalesce(recovered + residue - deployed + worth, 0)::double, 4) as net from al left join su using (sym, stop) left join hl using (sym, stop)""")
def accumulation_stops(spark, d):
    folded = folds.fold(by_type(spark, d), ("atr",))
    candles = folded.withColumn("at", F.row_number().over(Window.partitionBy("sym").orderBy("ts")).cast("long") - 1)
    two = phase_trades.sweep(folded, (2.0,))
    out = phase_trades.accumulate(phase_trades.positions(two, candles), phase_trades.breaks(two), candles)
    return out.select(*(F.round(c, 4).alias(c) if t == "double" and c != "stop" else F.col(c) for c, t in out.dtypes))
