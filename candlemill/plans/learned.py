"""Queries of sizing, bands, gates, stops, change points, funding and the treasury's service, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import folds, learning, simulator, treasury
from candlemill.operators.series import numbered
from candlemill.plans.catalogue import _SIMULATED, BY_TYPE, SIGNS, by_type, labelled, outcomes, query, rounded, signs, table
from candlemill.plans.facts import FOLDS

# Predictions of five observers: the higher the value the likelier right.
_RESOLVED = "r as (select event_type as sym, event_id as id, value / 500 as conviction, (event_id * 7919 % 100) < 50 + value as correct from events)"


def resolved(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("sym"), F.col("event_id").alias("id"), (F.col("value") / 500).alias("conviction"), (F.col("event_id") * 7919 % 100 < 50 + F.col("value")).alias("correct"))


_BINS = f"""with {_RESOLVED}, i as (select *, row_number() over (partition by sym order by conviction, id) - 1 as i, count(*) over (partition by sym) as n from r),
g as (select sym, least(i // (n // 20), 19)::int as bin, count(*) as n, avg(conviction) as x, avg(correct::int) as acc from i where n // 20 >= 10 group by 1, 2),
cf as (select sym, exp(regr_intercept(ln(acc - 0.5), x)) as a, regr_slope(ln(acc - 0.5), x) as b, count(*) as bins from g where acc > 0.505 group by 1 having count(*) >= 3)
"""


@query(_BINS + "select sym, bin, n, round(x, 6) as x, round(acc, 6) as acc from g")
def conviction_curve(spark, d):
    return rounded(learning.conviction_bins(resolved(spark, d)))


@query(_BINS + "select sym, round(a, 6) as a, round(b, 6) as b, bins from cf")
def curve_fit(spark, d):
    return rounded(learning.curve_fit(learning.conviction_bins(resolved(spark, d))))


@query(_BINS + """, q as (select sym, conviction as c, a, b, least(0.95, 0.5 + a * exp(b * conviction)) as w from r join cf using (sym)), s as (select sym, list(conviction order by conviction) as l from r group by 1)
select sym, count(*) as n, round(avg(w), 6) as win_rate, round(sum(case when 2 * w - 1 > 0 then (2 * w - 1) / 2 / 0.01 end) / count(*), 4) as half_kelly, round(any_value(case when b > 0 and ln(0.05 / a) / b > 0 and ln(0.05 / a) / b < 1 then ln(0.05 / a) / b end), 6) as auto_threshold, round(any_value(s.l[least((len(s.l) * 0.85::double)::int, len(s.l) - 1) + 1]), 6) as quantile_threshold
from q join s using (sym) group by 1""".replace("(len(s.l) * 0.85::double)::int", "floor(len(s.l) * 0.85::double)::int"))
def kelly_sizing(spark, d):
    r = resolved(spark, d)
    fit = learning.curve_fit(learning.conviction_bins(r))
    q = r.join(fit, "sym").withColumn("w", learning.win_rate(F.col("conviction"), F.col("a"), F.col("b")))
    g = q.groupBy("sym").agg(F.count("*").alias("n"), F.avg("w").alias("win_rate"), (F.sum(learning.half_kelly(F.col("w"), 0.01)) / F.count("*")).alias("half_kelly"), F.first("a").alias("a"), F.first("b").alias("b"))
    g = g.join(learning.quantile_threshold(r, 0.85), "sym", "left")
    return rounded(g.select("sym", "n", "win_rate", F.round("half_kelly", 4).alias("half_kelly"), learning.conviction_threshold(F.col("a"), F.col("b"), 0.55).alias("auto_threshold"), F.col("threshold").alias("quantile_threshold")))


@query(f"with {BY_TYPE}, m as (select *, abs(close - open) as mv from c) select sym, ts, round(case when avg(mv) over w > 0 then mv / avg(mv) over w end, 6) as weight from m window w as (partition by sym order by ts rows unbounded preceding)")
def signal_weights(spark, d):
    return rounded(learning.signal_weight(by_type(spark, d).withColumn("mv", F.col("close") - F.col("open")), "mv").select("sym", "ts", "weight"))


@query(f"""with {_RESOLVED}, k as (select unnest(range(3, 18)) as k), b as (select sym, k, count(*) as n, avg(correct::int) as acc from k join r on conviction >= k * 0.01::double and conviction < (k + 4) * 0.01::double where sym in (select sym from r group by 1 having count(*) >= 500) group by 1, 2 having count(*) >= 200),
o as (select *, row_number() over (partition by sym order by acc desc, k) as p from b) select sym, round(k * 0.01::double, 6) as low, round((k + 4) * 0.01::double, 6) as high, n, round(acc, 6) as accuracy from o where p = 1 and acc > 0.51""")
def proven_bands(spark, d):
    return rounded(learning.proven_band(resolved(spark, d), 10_000))


@query("select l_suppkey as broker, avg((l_returnflag = 'N')::int) > 0.5 or count(*) filter (l_returnflag = 'N') < 50 or count(*) filter (l_returnflag <> 'N') < 50 as gate from lineitem group by 1")
def broker_gate(spark, d):
    n = F.col("l_returnflag") == "N"
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("broker")).agg(F.avg(n.cast("int")).alias("p"), F.count_if(n).alias("graces"), F.count_if(~n).alias("violences"))
    return g.select("broker", learning.broker_gate(F.col("graces"), F.col("violences"), F.col("p")).alias("gate"))


@query("""with g as (select l_returnflag as learner, l_linenumber::int as epoch, count(*) as n, avg((l_discount > 0.04)::int) as a from lineitem group by 1, 2)
select learner, epoch, n, round(a, 6) as accuracy, a >= 0.55 as snapshot, count(*) filter (a >= 0.55) over (partition by learner order by epoch) as snapshots from g""")
def engram_gate(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("learner"), F.col("l_linenumber").cast("int").alias("epoch"), (F.col("l_discount") > 0.04).alias("correct"))
    return rounded(learning.engram_gate(x, "learner", "epoch", "correct"))


@query(f"""with {SIGNS}, q as (select vec_id as query, r as q from e where vec_id % 200 = 0), m as (select query, q, vec_id, r, row_number() over (partition by query order by vec_id desc) as back from q join e on vec_id <> query and vec_id // 200 <= query // 200),
w as (select query, vec_id % 10 / 100.0 as dist, case when list_cosine_similarity(r, q) > 0 then list_cosine_similarity(r, q) * greatest(vec_id % 3 / 50.0, 0.01) end as w from m where back <= 100)
select query, round(case when coalesce(sum(w), 0) < 1e-10 then 0.015 else sum(w * dist) / sum(w) end, 6) as distance, count(w) as used from w group by 1""")
def learned_stop(spark, d):
    """Each two-hundredth vector asks the hundred last ones of its own two hundred and of those before, in the order of ids: they
    are the rows up to the last of its block, by their numbers, however far back their ids lie."""
    s = signs(spark, d).select("vec_id", "r").withColumn("all", F.lit(0))
    s = numbered(s, key="all", order="vec_id", out="place", slot=F.floor(F.col("vec_id") / 10_000))
    block = F.floor(F.col("vec_id") / 200)
    ends = s.groupBy(block.alias("block")).agg(F.max("place").alias("end"))
    asked = s.where("vec_id % 200 = 0").select(F.col("vec_id").alias("query"), F.col("r").alias("q"), block.alias("block")).join(ends, "block")
    reached = asked.select("query", "q", F.explode(F.sequence(F.greatest(F.lit(0), F.col("end") - 100), F.col("end"))).alias("place"))
    m = s.join(reached, "place").where("vec_id <> query")
    m = m.select("query", F.col("vec_id").alias("i"), (F.col("vec_id") % 10 / 100.0).alias("distance"), (F.col("vec_id") % 3 / 50.0).alias("weight"), "q", "r")
    return rounded(learning.learned_stop(m, V.cosine(F.col("r"), F.col("q")), most=100))


@query(f"""with recursive {BY_TYPE}, n as (select sym, row_number() over (partition by sym order by ts) - 1 as pos, close from c),
w as materialized (select sym, pos // 240 as win, list(close order by pos) as l, case when var_pop(close) < 1e-20 or count(*) < 2 then 1e10 else 2 * var_pop(close) * ln(count(*)) end as pen from n group by 1, 2),
cs as materialized (select *, list_concat([0.0::double], list_transform(range(1, len(l) + 1), lambda k: list_sum(l[1:k]))) as s, list_concat([0.0::double], list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: x * x)))) as q from w),
dp(sym, win, t, best, last) as (
    select sym, win, 0::bigint, [0.0::double], [0::bigint] from cs
    union all
    select sym, win, t + 1, list_append(best, list_min(costs) + pen), list_append(last, (list_position(costs, list_min(costs)) - 1)::bigint)
    from (select dp.sym, dp.win, dp.t, dp.best, dp.last, cs.pen, list_transform(range(0, dp.t + 1), lambda a: dp.best[a + 1] + (cs.q[dp.t + 2] - cs.q[a + 1] - pow(cs.s[dp.t + 2] - cs.s[a + 1], 2) / (dp.t + 1 - a))) as costs from dp join cs using (sym, win) where dp.t < len(cs.l))),
fin as (select dp.sym, dp.win, cs.l, dp.last, len(cs.l)::bigint as n from dp join cs using (sym, win) where dp.t = len(cs.l)),
bt(sym, win, a, b) as (select sym, win, case when n < 3 then 0 else last[n + 1] end, n from fin union all select bt.sym, bt.win, fin.last[bt.a + 1], bt.a from bt join fin using (sym, win) where bt.a > 0)
select bt.sym, bt.win, bt.a as start, bt.b - bt.a as length, round(list_avg(fin.l[bt.a + 1:bt.b]), 6) as mean, case when bt.b = fin.n then case when fin.n < 5 or abs(fin.l[fin.n] - fin.l[bt.a + 1]) < 1e-10 then 'None' when fin.l[fin.n] > fin.l[bt.a + 1] then 'Up' else 'Down' end end as direction from bt join fin using (sym, win)""")
def change_points(spark, d):
    return rounded(learning.change_points(by_type(spark, d)))


@query(f"""with {BY_TYPE}, n as (select sym, ts, close, list(close) over (partition by sym order by ts rows between 1 following and 24 following) as raw, minute(ts) % 2 = 0 and hour(ts) % 2 = 0 as up from c),
o as (select sym, ts, case when up then close else 1 / close end as e, list_transform(list_filter(raw, lambda x: x > 0), lambda x: case when up then x else 1 / x end) as p from n where close > 0),
t as (select *, unnest(range(1, 21)) * 0.005::double as dist from o where len(p) > 0),
hw as (select *, list_position(list_transform(range(1, len(p) + 1), lambda k: p[k] <= greatest(e, coalesce(list_max(p[1:k - 1]), e)) * (1 - dist)), true) as ft, list_position(list_transform(p, lambda x: x <= e * (1 - dist)), true) as fs from t),
g as (select sym, ts, dist, (case when coalesce(ft, 0) > 0 then p[ft] else p[len(p)] end) / e - 1 as gt, (case when coalesce(fs, 0) > 0 then p[fs] else p[len(p)] end) / e - 1 as gs from hw),
v as (select *, gt - 0.0035 - (1 + gt) * 0.0035 as nt, gs - 0.0035 - (1 + gs) * 0.0035 as ns from g),
k as (select *, row_number() over (partition by sym, ts order by nt desc, dist) as rt, row_number() over (partition by sym, ts order by ns desc, dist) as rs from v)
select sym || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') as id, round(max(dist) filter (rt = 1), 6) as trail, round(max(nt) + 1e-9, 4) as trail_net, round(max(dist) filter (rs = 1), 6) as stop, round(max(ns) + 1e-9, 4) as stop_net from k group by sym, ts""")
def best_distances(spark, d):
    ahead = F.collect_list("close").over(Window.partitionBy("sym").orderBy("ts").rowsBetween(1, 24))
    e = by_type(spark, d).withColumn("path", ahead).where("close > 0").withColumn("path", F.filter("path", lambda x: x > 0))
    e = e.select(F.concat_ws("/", "sym", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("id"), F.col("close").alias("entry"), F.when((F.minute("ts") % 2 == 0) & (F.hour("ts") % 2 == 0), "Up").otherwise("Down").alias("direction"), "path")
    b = simulator.best_distances(e)
    return rounded(b.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("trail_net", "stop_net")}))


@query(_SIMULATED + """, tg as (select s.sym, s.thinker, s.i, s.close, s.label, s.generation <> lag(s.generation) over (partition by s.sym, s.thinker order by s.i) as turned from sig s)
select o.sym, o.thinker, o.paper_id, tg.i::bigint as at, tg.label as phase_label, case when o.state = 'Violence' or tg.i = o.resolved_at then 'Exit' else 'Hold' end as label,
    round(case when n.close <> 0 then (tg.close - n.close) / n.close else 0 end * case when o.direction = 'Up' then 1 else -1 end, 6) + 0 as price_move
from outcomes o join tg on tg.sym = o.sym and tg.thinker = o.thinker and tg.turned and tg.i > o.opened_at and tg.i <= o.resolved_at join sig n on n.sym = o.sym and n.thinker = o.thinker and n.i = o.opened_at""")
def label_trails(spark, d):
    rows = labelled(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("sym").orderBy("ts")))
    return rounded(simulator.label_trails(outcomes(spark, d), rows))


@query("""with p as (select o_orderkey as id, o_orderpriority as source, o_totalprice / 40000000 as edge from orders),
c(source, capital) as (values ('1-URGENT', 1000000.0::double), ('2-HIGH', 0.0), ('3-MEDIUM', 500000.0), ('4-NOT SPECIFIED', 500000.0)), k as (select *, case when edge >= 0.007 then row_number() over (partition by source, edge >= 0.007 order by edge desc, id) end as k from p),
l as (select k.*, coalesce(capital, 0) * pow(0.007::double / 1.007, k - 1) as held from k left join c using (source))
select id, source, round(edge, 6) as edge, round(case when held > 0 then held / 1.007 end, 6) + 0 as amount, case when edge < 0.007 then 'edge below venue cost' when held > 0 then null else 'insufficient capital' end as reason from l""")
def proposal_funding(spark, d):
    """By order priority as source."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") / 40_000_000).alias("edge"))
    capital = spark.createDataFrame([("1-URGENT", 1e6), ("2-HIGH", 0.0), ("3-MEDIUM", 5e5), ("4-NOT SPECIFIED", 5e5)], "source string, amount double")
    return rounded(treasury.fund(o, capital, 0.0035))


def service_requests(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 10
    tick = F.col("event_id") % 50 == 9
    kind = F.when(tick, "Tick").when(k <= 5, "SubmitPaper").when(k <= 7, "SubmitExit").when(k == 8, "SubmitReal").otherwise("BatchGetPaperStates")
    return e.select(
        (F.col("user_id") % 8).alias("treasury"), "event_id", F.floor(F.col("user_id") % 16 / 8).alias("owner"), kind.alias("kind"), F.floor(F.col("event_id") / 20).alias("candle"), F.col("value").alias("price"),
        F.when(F.col("event_id") % 3 == 0, "USDC").when(F.col("event_id") % 3 == 1, "WBTC").otherwise("ETH").alias("asset"), (1 + F.col("event_id") * 7 % 400).alias("paper_id"), F.array(F.lit(1), F.lit(5), F.lit(99_999)).cast("array<long>").alias("paper_ids"),
    )


@query("""with r as (select event_id as e, user_id % 8 as treasury, user_id % 16 // 8 as owner, value as price, event_id // 20 as candle, case when event_id % 50 = 9 then 'Tick' when event_id % 10 <= 5 then 'SubmitPaper' when event_id % 10 <= 7 then 'SubmitExit' when event_id % 10 = 8 then 'SubmitReal' else 'BatchGetPaperStates' end as kind,
    case event_id % 3 when 0 then 'USDC' when 1 then 'WBTC' else 'ETH' end as asset, 1 + event_id * 7 % 400 as paper_id from events),
p as materialized (select *, row_number() over (partition by treasury order by e) as id, case when price > 0 then 10000 * 0.9965::double / price else 0 end as units from r where kind = 'SubmitPaper'),
dt as materialized (select p.treasury, p.id, min(t.e) as death from p join r t on t.treasury = p.treasury and t.kind = 'Tick' and t.candle >= 288 and t.e > p.e group by 1, 2),
ex as materialized (select p.treasury, p.id, p.owner, arg_min(x.e, x.e) as at, arg_min(p.units * x.price - 10000 - p.units * x.price * 0.0035::double, x.e) as residue from p join r x on x.treasury = p.treasury and x.kind = 'SubmitExit' and x.paper_id = p.id and x.e > p.e left join dt on dt.treasury = p.treasury and dt.id = p.id
    where p.units * x.price - 10000 - p.units * x.price * 0.0035::double > 0 and (dt.death is null or x.e < dt.death) group by 1, 2, 3),
lf as materialized (select p.*, ex.at as grace_at, case when ex.at is null then dt.death end as fail_at from p left join ex using (treasury, id) left join dt using (treasury, id)),
rl as (select r.e, r.treasury, r.asset, (select count(*) from lf where lf.treasury = r.treasury and lf.owner = r.owner and lf.e < r.e) as sub, (select count(*) from lf where lf.treasury = r.treasury and lf.owner = r.owner and lf.grace_at < r.e) as ok, (select count(*) from lf where lf.treasury = r.treasury and lf.owner = r.owner and lf.fail_at < r.e) as bad from r where kind = 'SubmitReal'),
gt as (select *, row_number() over (partition by treasury, asset order by e) as k, case asset when 'USDC' then 420.0::double when 'WBTC' then 110.0::double else 0.0::double end as b from rl where sub >= 50 and ok + bad > 0 and ok / (ok + bad) > 0.5),
gr as (select *, row_number() over (partition by treasury order by e) as id, least(50, b - 50 * (k - 1)) as amount from gt where b - 50 * (k - 1) > 0),
bs as (select r.e, string_agg(w.id || ':' || coalesce(case when lf.e > r.e then null when lf.grace_at < r.e then 'Grace' when lf.fail_at < r.e then 'Violence' when lf.e < r.e then 'Active' end, 'None'), ',' order by w.o) as states from r cross join (values (1, 1), (2, 5), (3, 99999)) w(o, id) left join lf on lf.treasury = r.treasury and lf.id = w.id where r.kind = 'BatchGetPaperStates' group by 1)
select r.treasury, r.e as event_id, r.owner, r.kind, coalesce(p.id, gr.id) as issued, round(case when p.id is not null then 10000 else gr.amount end::double, 6) as amount, round(ex.residue, 6) as residue, bs.states
from r left join p on p.e = r.e left join gr on gr.e = r.e left join ex on ex.treasury = r.treasury and ex.at = r.e left join bs on bs.e = r.e where r.kind <> 'Tick'""")
def treasury_service(spark, d):
    return rounded(treasury.serve(service_requests(spark, d), {"USDC": 420.0, "WBTC": 110.0}))


@query(f"with {FOLDS}, f as (select sym, ts, i, atr, first_value(case when atr > 0 then atr end ignore nulls) over (partition by sym order by i) as ref from fo) select sym, ts, case when atr > 0 and ref > 0 then floor(288 * (ref / atr) + 0.5)::bigint else 288 end as deadline from f")
def atr_deadlines(spark, d):
    f = folds.fold(by_type(spark, d), ("atr",)).select("sym", "ts", "atr")
    first = F.first(F.when(F.col("atr") > 0, F.col("atr")), True).over(Window.partitionBy("sym").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("ref", first).select("sym", "ts", treasury.scaled_deadline(288, F.coalesce("ref", F.lit(0.0)), F.col("atr")).alias("deadline"))


@query()
def vector_anomaly(spark, d):
    """Distance of each vector from its class's eight leading directions."""
    return rounded(learning.anomaly(signs(spark, d).select("vec_id", "label", "r"), "label", "r").select("vec_id", "residual"))
