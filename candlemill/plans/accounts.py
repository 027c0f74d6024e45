"""Queries of papers and positions that follow the price, and of a portfolio's account. The SQL folds what Spark windows, and
windows what Spark folds in part: the account as a recursive query."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import folds, papers, phase_rhythm, portfolio, rhythms, vocabulary
from candlemill.operators.series import as_of
from candlemill.plans.catalogue import BY_TYPE, by_type, query, rounded
from candlemill.plans.facts import _RECORDS

HORIZON, EVERY, TRAIL, STOP, ATR = 48, 24, 0.05, 0.3, 0.02


def numbered(spark, d):
    return by_type(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("sym").orderBy("ts")).cast("long") - 1)


def entries(spark, d):
    e = numbered(spark, d).where((F.col("at") % EVERY == 0) & (F.col("close") > 0))
    return e.select("sym", F.col("at").alias("paper"), F.col("at").alias("opened"), F.when(F.floor(F.col("at") / EVERY) % 2 == 0, "Up").otherwise("Down").alias("direction"), F.col("close").alias("entry"), F.lit(TRAIL).alias("trail_distance"), F.lit(STOP).alias("stop_distance"), F.lit(ATR).alias("atr"))


def walked(spark, d):
    return papers.walk(entries(spark, d), numbered(spark, d), HORIZON)


_NUM = f"{BY_TYPE}, n as (select *, row_number() over (partition by sym order by ts) - 1 as pos from c)"
_TRAIL = f"""with recursive {_NUM},
w(sym, paper, pos, direction, entry, price, extreme, trail, signaled, ended, grace) as (
    select sym, pos, pos, case when pos // {EVERY} % 2 = 0 then 'Up' else 'Down' end, close, close, close, close, false, false, false from n where pos % {EVERY} = 0 and close > 0
    union all
    select sym, paper, pos, direction, entry, price, x, t, case when stopped then signaled else sg end, stopped or (sg and case when direction = 'Up' then price <= t else price >= t end), (not stopped and sg) or (stopped and signaled)
    from (select *, case when direction = 'Up' then price <= entry - entry * {STOP} else price >= entry + entry * {STOP} end as stopped, case when direction = 'Up' then x >= entry + entry * {TRAIL} else x <= entry - entry * {TRAIL} end as sg
        from (select *, case when direction = 'Up' then greatest(trail, x - x * {TRAIL}) else least(trail, x + x * {TRAIL}) end as t
            from (select w.sym, w.paper, n.pos, w.direction, w.entry, n.close as price, w.trail, w.signaled, case when w.direction = 'Up' then greatest(w.extreme, n.close) else least(w.extreme, n.close) end as x
                from w join n on n.sym = w.sym and n.pos = w.pos + 1 where not w.ended and n.pos <= w.paper + {HORIZON}))))
"""


@query(_TRAIL + "select sym, paper, max(direction) as direction, max(pos) filter (ended) as resolved_at, coalesce(bool_or(grace) filter (ended), false) as grace, round(arg_max(extreme, pos), 6) as extreme, round(arg_max(trail, pos), 6) as trail_level from w group by 1, 2")
def trailing_papers(spark, d):
    t = papers.trailing(walked(spark, d))
    return rounded(t.groupBy("sym", "paper").agg(F.max("direction").alias("direction"), F.max("resolved_at").alias("resolved_at"), F.max("grace").alias("grace"), F.max_by("extreme", "at").alias("extreme"), F.max_by("trail_level", "at").alias("trail_level")))


def paper_states(spark, d):
    """Live papers with the phases that closed before each row, as the atoms read them."""
    records = folds.phase_records(folds.fold(by_type(spark, d), ("atr",)))
    live = papers.trailing(walked(spark, d)).where("resolved_at is null or at < resolved_at")
    closed = records.select(F.col("sym").alias("r_sym"), "label", "start_candle", F.col("end_candle").alias("closed_at"))
    # Of phases closed by a row and in memory: their mean as of the last of them. Of those since the entry: phases that start and close within the paper's rows.
    means = phase_rhythm.means(records).withColumnRenamed("end_candle", "at")
    counts = live.select("sym", "paper", "opened", "at").join(closed, (F.col("sym") == F.col("r_sym")) & (F.col("at") == F.col("closed_at")), "left")
    inside = (F.col("start_candle") >= F.col("opened")).cast("int")
    upto = Window.partitionBy("sym", "paper").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("sym", "paper", "at", F.coalesce(F.sum(inside).over(upto), F.lit(0)).alias("phases_since"), F.coalesce(F.sum(inside * (F.col("label") == "Peak").cast("int")).over(upto), F.lit(0)).alias("phases_survived"))
    out = as_of(live.join(counts, ["sym", "paper", "at"]), means, ["phase_avg"], at="at")
    return vocabulary.trade_state(out.withColumn("signaled", F.col("signaled").cast("double")))


def _atom(place: int, name: str, kind: str, value: str, lo: float, hi: float) -> str:
    return f"select sym, pos as at, paper, {place} as place, '{name}' as name, '{kind}' as kind, round(({value})::double, 6) as value, {lo}::double as lo, {hi}::double as hi from q"


_ATOMS = [
    ("exit-excursion", "log", "greatest(ex, 0.0001)", 0.0001, 0.5), ("exit-retracement", "linear", "rt", -1.0, 1.0), ("exit-age", "log", "greatest(age, 1)", 1.0, 100.0), ("exit-peak-age", "log", "greatest(age - peak, 1)", 1.0, 100.0), ("exit-signaled", "linear", "signaled::int", -1.0, 1.0),
    ("exit-trail-distance", "log", f"{TRAIL}", 0.0001, 0.5), ("exit-stop-distance", "log", f"{STOP}", 0.0001, 0.5), ("exit-r-multiple", "log", f"greatest(ex / {STOP}, 0.0001)", 0.0001, 10.0), ("exit-heat", "linear", f"least(case when greatest(ex - rt * ex, 0) > 0.0001 then {TRAIL} / greatest(ex - rt * ex, 0) else 1 end, 1)", -1.0, 1.0),
    ("exit-trail-cushion", "linear", "case when ex > 0.0001 then least(abs(price - trail) / abs(extreme - entry), 1) else 0 end", -1.0, 1.0),
]


@query(_TRAIL + """, lv as (select *, pos - paper as age from w where not ended),
q as (select *, abs((extreme - entry) / entry) as ex, case when abs((extreme - entry) / entry) > 0.0001 then least(abs((extreme - price) / (extreme - entry)), 1) else 0 end as rt, max(case when abs(price - extreme) < 1e-10 then age end) over (partition by sym, paper order by pos) as peak from lv) """ + " union all ".join(_atom(i, *a) for i, a in enumerate(_ATOMS, 1)))
def trade_atoms(spark, d):
    """The ten atoms of a paper's own; trade_atoms_phases has the three that read phases."""
    return rounded(vocabulary.trade_atoms(paper_states(spark, d)).where("place <= 10"))


_PHASE_ATOMS = [("phases-since-entry", "log", "greatest(since, 1)", 1.0, 100.0), ("phases-survived", "log", "greatest(survived, 1)", 1.0, 100.0), ("entry-vs-phase-avg", "linear", "case when entry = 0 or phase_avg is null then 0 else (entry - phase_avg) / entry end", -1.0, 1.0)]
_WALK = re.sub(r"\bn\b", "np", _TRAIL[_TRAIL.index("w(sym, paper") :])


@query(f"""{_RECORDS}, np as (select sym, i - 1 as pos, close from n), {_WALK}, lv as (select * from w where not ended),
hm as (select e.sym, e.end_candle, avg(m.close_avg) as phase_avg from rc e join rc m on m.sym = e.sym and m.end_candle <= e.end_candle and m.start_candle >= e.end_candle - 2016 group by 1, 2),
ct as (select lv.sym, lv.paper, lv.pos, count(rc.sym) as since, count(*) filter (rc.label = 'Peak') as survived from lv left join rc on rc.sym = lv.sym and rc.start_candle >= lv.paper and rc.end_candle <= lv.pos group by 1, 2, 3),
q as (select lv.*, ct.since, ct.survived, hm.phase_avg from lv join ct using (sym, paper, pos) asof left join hm on hm.sym = lv.sym and lv.pos >= hm.end_candle) """ + " union all ".join(_atom(i, *a) for i, a in enumerate(_PHASE_ATOMS, 11)))
def trade_atoms_phases(spark, d):
    return rounded(vocabulary.trade_atoms(paper_states(spark, d)).where("place > 10"))


@query(_TRAIL + """, lv as (select *, pos - paper as age from w where not ended) select count(*) * 5 as core, count(*) * 13 as "full" from lv""")
def trade_atom_lenses(spark, d):
    """How many atoms the core and the full lens read."""
    s = paper_states(spark, d)
    core, full = vocabulary.trade_atoms(s, full=False).agg(F.count("*").alias("core")), vocabulary.trade_atoms(s).agg(F.count("*").alias("full"))
    return core.crossJoin(full)  # a row each


K_STOP, K_TRAIL, K_TP = 3.0, 5.0, 8.0


@query(f"""with recursive {_NUM},
p(sym, paper, pos, entry, price, extreme, stop, worst, exit) as (
    select sym, pos, pos, close, close, close, close * (1 - {K_STOP} * {ATR}), 0.0::double, null::varchar from n where pos % {EVERY} = 0 and close > 0
    union all
    select sym, paper, pos, entry, price, x, s, least(worst, price / entry - 1), case when price <= s then 'StopLoss' when price >= entry * (1 + {K_TP} * {ATR}) then 'TakeProfit' end
    from (select *, greatest(stop, x * (1 - {K_TRAIL} * {ATR})) as s from (select p.sym, p.paper, n.pos, p.entry, n.close as price, p.stop, p.worst, greatest(p.extreme, n.close) as x from p join n on n.sym = p.sym and n.pos = p.pos + 1 where p.exit is null and n.pos <= p.paper + {HORIZON})))
select sym, paper, max(exit) as exit, max(pos) filter (exit is not null) as exit_at, round(arg_max(stop, pos), 6) as stop, round(arg_max(worst, pos), 6) as max_adverse from p group by 1, 2""")
def stop_target_positions(spark, d):
    return rounded(papers.positions(walked(spark, d), K_STOP, K_TRAIL, K_TP))


def _side(s: str, up: bool) -> str:
    cmp, rev, ext = (">=", "<=", "greatest") if up else ("<=", ">=", "least")
    sign, other = ("-", "+") if up else ("+", "-")
    return f"""{s}(sym, paper, pos, entry, price, extreme, stop, mfe, mae, done) as (
    select sym, pos, pos, close, close, close, close * (1 {sign} {K_STOP} * {ATR}), 0.0::double, 0.0::double, false from n where pos % {EVERY} = 0 and close > 0
    union all
    select sym, paper, pos, entry, price, x, t, greatest(mfe, m), least(mae, m), price {rev} t or price {cmp} entry * (1 {other} {K_TP} * {ATR})
    from (select *, {ext}(stop, x * (1 {sign} {K_TRAIL} * {ATR})) as t, {'price - entry' if up else 'entry - price'} as m from (select {s}.sym, {s}.paper, n.pos, {s}.entry, n.close as price, {s}.stop, {s}.mfe, {s}.mae, {ext}({s}.extreme, n.close) as x from {s} join n on n.sym = {s}.sym and n.pos = {s}.pos + 1 where not {s}.done and n.pos <= {s}.paper + {HORIZON})))"""


@query(f"""with recursive {_NUM}, {_side('u', True)}, {_side('v', False)},
a as (select sym, paper, max(mfe) as buy_mfe, min(mae) as buy_mae, bool_or(done) as bd from u group by 1, 2), b as (select sym, paper, max(mfe) as sell_mfe, min(mae) as sell_mae, bool_or(done) as sd from v group by 1, 2),
g as (select *, (buy_mfe - abs(buy_mae)) - (sell_mfe - abs(sell_mae)) as gap from a join b using (sym, paper))
select sym, paper, round(buy_mfe, 6) as buy_mfe, round(buy_mae, 6) + 0 as buy_mae, round(sell_mfe, 6) as sell_mfe, round(sell_mae, 6) + 0 as sell_mae, case when bd and sd then case when gap > 0 then 'Win' else 'Loss' end end as outcome, round(case when bd and sd then greatest(abs(gap), 0.01) end, 6) as weight from g""")
def dual_excursions(spark, d):
    return rounded(papers.excursions(walked(spark, d), K_STOP, K_TRAIL, K_TP))


def trades(spark, d):
    e = numbered(spark, d).where("open > 0")
    move = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.col("close") - F.col("open")) / F.col("open")))
    direction = F.when(F.col("at") % 3 == 0, "Short").otherwise("Long")
    return e.select("sym", F.col("at").alias("i"), portfolio.net_return(move, direction, 0.0035, 0.001).alias("net"), F.lit(0.05).alias("frac"))


_ACCOUNT = f"""with recursive {_NUM}, nt as (select sym, pos as i, row_number() over (partition by sym order by pos) as k, 0.9955::double * (1 + case when pos % 3 = 0 then -1 else 1 end * greatest(-0.5, least(0.5, (close - open) / open))) * 0.9955::double - 1 as net from n where open > 0),
ac(sym, k, i, net, equity, peak, bottom, since, done) as (
    select sym, 0::bigint, null::bigint, null::double, 10000.0::double, 10000.0::double, 10000.0::double, 0::bigint, []::double[] from (select distinct sym from nt)
    union all
    select sym, k, i, net, e, p * 0.999::double + e * 0.001::double, least(b, e), case when e < b then 0 else s + 1 end, dd from (
        select *, case when e > peak then e else peak end as p, case when e > peak then e else bottom end as b, case when e > peak then 0 else since end as s, case when e > peak and bottom < peak * 0.999::double then list_append(done, (peak - bottom) / peak)[-20:] else done end as dd
        from (select nt.sym, nt.k, nt.i, nt.net, ac.equity + ac.equity * 0.05::double * nt.net as e, ac.peak, ac.bottom, ac.since, ac.done from ac join nt on nt.sym = ac.sym and nt.k = ac.k + 1))),
g as materialized (select *, coalesce(list_max(done), 0) as worst from ac where k > 0)
"""


@query(_ACCOUNT + "select sym, i, round(net, 6) as net, round(equity, 4) as equity, round(peak, 4) as peak, round(bottom, 4) as bottom, since as since_bottom, round(worst, 6) as worst from g")
def portfolio_account(spark, d):
    a = portfolio.account(trades(spark, d))
    return rounded(a.select("sym", "i", "net", *(F.round(c, 4).alias(c) for c in ("equity", "peak", "bottom")), "since_bottom", "worst"))


def _lastn(n: int) -> str:
    return f"over (partition by sym order by k rows between {n - 1} preceding and current row)"


@query(_ACCOUNT + f""", h as (select *, (net > 0)::int as won, list(net) {_lastn(50)} as r, list(case when net > 0 then 1.0 else -1.0 end) {_lastn(50)} as w, case when peak > 0 then (peak - equity) / peak else 0 end as dd, lag(equity, 4) over (partition by sym order by k) as e5, max(k) filter (net > 0) over (partition by sym order by k) as lw, max(k) filter (net <= 0) over (partition by sym order by k) as ll from g),
s as (select *, avg(won) {_lastn(10)} as w10, avg(won) {_lastn(50)} as w50, avg(won) {_lastn(200)} as w200, avg(won) over (partition by sym order by k) as wa, list_avg(r) as m, list_stddev_pop(r) as v, list_avg(w) as mw, list_var_pop(w) as vw, sum(1 - won) {_lastn(20)} / 20 as ld, case when won = 1 then k - coalesce(ll, 0) else coalesce(lw, 0) - k end as st from h)
select sym, i, round(equity, 4) as equity, round(dd, 6) + 0 as drawdown, round(case when k >= 5 then dd - case when peak > 0 then (peak - e5) / peak else 0 end else 0 end, 6) + 0 as velocity, round(case when peak > bottom and dd > 0.005 then greatest(0, least(1, (equity - bottom) / (peak - bottom))) else 1 end, 6) as recovery, round(case when worst > 0.001 then dd / worst else 0 end, 5) + 0 as historical,
    round(w10, 6) as win_10, round(w50, 6) as win_50, round(w200, 6) as win_200, round(wa, 6) as win_all, round(w10 - w50, 6) + 0 as trajectory, round(w10 - w200, 6) + 0 as divergence, round(case when k >= 5 then v else 0 end, 6) as vol, round(case when k >= 5 and v > 1e-10 then m / v else 0 end, 6) + 0 as sharpe,
    round(case when k >= 5 and v > 1e-10 then list_sum(list_transform(r, lambda x: pow((x - m) / v, 3))) / len(r) else 0 end, 6) + 0 as skew, round(case when k >= 5 then least(0, list_min(r)) else 0 end, 6) as worst_trade, round(case when k >= 5 then greatest(0, list_max(r)) else 0 end, 6) as best_trade,
    round(case when k >= 20 and vw > 1e-10 then list_sum(list_transform(range(1, len(w)), lambda j: (w[j] - mw) * (w[j + 1] - mw))) / ((len(w) - 1) * vw) else 0 end, 6) + 0 as autocorrelation, round(case when k >= 20 then ld else 0 end, 6) as loss_density, case when k >= 20 and won = 0 then least(-st, 50) else 0 end as losses_in_a_row,
    round(since / 100.0::double, 6) as duration, round(k / 1000.0::double, 6) as trade_density, round(sqrt(k) / 30, 6) as trade_frequency, case when k < 20 then 0.0::double when round(case when k >= 20 and vw > 1e-10 then list_sum(list_transform(range(1, len(w)), lambda j: (w[j] - mw) * (w[j + 1] - mw))) / ((len(w) - 1) * vw) else 0 end, 9) < 0 then -1.0 else 1.0 end as autocorrelation_sign, round(equity / 10000 - 1, 6) + 0 as gain, st as streak, dd < 0.02 and w50 > 0.55 and m > 0 as healthy from s""")
def risk_branches(spark, d):
    r = portfolio.risk_branches(portfolio.account(trades(spark, d)))
    return rounded(r.drop("peak", "bottom", "since_bottom", "worst").withColumn("equity", F.round("equity", 4)).withColumn("historical", F.round("historical", 5)))


@query("""select l_orderkey, l_linenumber, round(case when conv < 0.1 or phase = 'Observe' then null when flip <= 0 then base when conv >= flip then least(base * conv / flip, 0.05) end, 6) as fraction
from (select *, case when phase = 'Tentative' then 0.005 when phase = 'Confident' then case when edge < 0.05 then 0.005 when edge < 0.1 then 0.01 else least(edge * 0.1, 0.02) end end as base
    from (select l_orderkey, l_linenumber, ['Observe', 'Tentative', 'Confident'][l_linenumber % 3 + 1] as phase, greatest(0.45 + 2 * l_tax - 0.5, 0) as edge, l_quantity / 50.0 as conv, case when l_returnflag = 'R' then 0 else 0.3 end as flip from lineitem))""")
def position_fractions(spark, d):
    x = table_of(spark, d)
    return rounded(x.select("l_orderkey", "l_linenumber", portfolio.position_fraction(x).alias("fraction")))


def table_of(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", F.get(F.array(F.lit("Observe"), F.lit("Tentative"), F.lit("Confident")), (F.col("l_linenumber") % 3).cast("int")).alias("phase"), (0.45 + 2 * F.col("l_tax")).alias("accuracy"), (F.col("l_quantity") / 50.0).alias("conviction"), F.lit(0.1).alias("least"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(0.3).alias("flip"))


@query(_TRAIL + f""", lv as (select *, pos - paper as age, case when direction = 'Up' then 1 else -1 end * (price - entry) / entry as gain from w where not ended), fn as (select sym, pos, count(*) as done, sum(grace::int) as ok from w where ended group by 1, 2),
cm as (select n.sym, n.pos, coalesce(sum(done) over h, 0) as done, coalesce(sum(ok) over h, 0) as ok from n left join fn using (sym, pos) window h as (partition by n.sym order by n.pos))
select sym, pos as at, round(avg(age), 6) as avg_age, round(avg(age / {HORIZON}), 6) as avg_tp, round(avg(gain), 6) + 0 as avg_unrealized, round(any_value(case when done > 0 then ok / done else 0 end), 6) as grace_rate, count(*) as active from lv join cm using (sym, pos) group by 1, 2""")
def portfolio_snapshots(spark, d):
    return rounded(snapshots(spark, d))


def snapshots(spark, d):
    return rhythms.snapshots(papers.trailing(walked(spark, d)), numbered(spark, d).select("sym", "at"), HORIZON)


@query()
def portfolio_rhythms(spark, d):
    r = rhythms.portfolio_rhythms(snapshots(spark, d), 256)
    return r.select("sym", "at", "name", F.sha2(V.to_hex(F.col("rhythm")), 256).alias("rhythm"))
