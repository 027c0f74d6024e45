"""Queries of the vector algebra on neighbouring vectors and on values, and their SQL on lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.plans.catalogue import SIGNS, query, signs, table


def digits(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",")


def _digits(v: str) -> str:
    return f"list_aggregate(list_transform({v}, lambda y: y::int::varchar), 'string_agg', ',')"


def _turned(v: str, by: str) -> str:
    return f"list_transform(range(0, len({v})), lambda j: {v}[((j - {by}) % len({v}) + len({v})) % len({v}) + 1])"


def _each(expr: str, sign: bool = True) -> str:
    return f"list_transform(range(1, len(l[1]) + 1), lambda i: {'sign(' if sign else '('}{expr}))"


_FIVES = f"with {SIGNS}, g as (select vec_id // 5 as g, list(v order by vec_id) as l from e group by 1 having count(*) = 5), t as (select g, l, {', '.join(f'{_turned(f"l[{k + 1}]", str(k))} as p{k}' for k in range(5))}, {', '.join(f'{_turned(f"l[{k + 1}]", "1")} as q{k}' for k in range(5))} from g)"


def fives(spark, d):
    """Each five vectors in a row, as an array."""
    g = signs(spark, d).groupBy(F.floor(F.col("vec_id") / 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("l"))
    return g.where(F.size("l") == 5).select("g", F.transform("l", lambda x: x["v"]).alias("l"))


@query(f"""{_FIVES} select g, {_digits(_each('p0[i] * p1[i] * p2[i] * p3[i] * p4[i]', False))} as chained, {_digits(_each('p0[i] + p1[i] + p2[i] + p3[i] + p4[i]'))} as bundled,
{_digits(_each('l[1][i] * q1[i] + l[2][i] * q2[i] + l[3][i] * q3[i] + l[4][i] * q4[i]'))} as bigrams from t""")
def vector_sequences(spark, d):
    l = F.col("l")  # noqa: E741
    return fives(spark, d).select("g", digits(V.sequential(l)).alias("chained"), digits(V.sequential(l, bundled=True)).alias("bundled"), digits(V.ngrams(l, 2)).alias("bigrams"))


@query(f"""{_FIVES} select g, {_digits(_each('0.7::double * l[1][i] - 0.2::double * l[2][i]'))} as blended, {_digits(_each('l[1][i] + 2 * l[2][i]'))} as amplified, {_digits(_each('l[1][i] - l[2][i]'))} as subtracted,
{_digits(_each('l[1][i] * l[2][i] + l[3][i] * l[4][i]'))} as map, {_digits(_each('(l[1][i] * l[2][i] + l[3][i] * l[4][i]) * l[1][i]'))} as got from t""")
def vector_blends(spark, d):
    """Weighted blends, and a map of two keys with what it holds under the first."""
    a, b, c, e = (F.col("l")[k] for k in range(4))
    m = V.map_bundle(F.array(a, c), F.array(b, e))
    return fives(spark, d).select("g", digits(V.blend(a, b, 0.7, -0.2)).alias("blended"), digits(V.amplify(a, b, 2.0)).alias("amplified"), digits(V.subtract(a, b)).alias("subtracted"), digits(m).alias("map"), digits(V.map_get(m, a)).alias("got"))


_SHARE = lambda x, lo, hi: f"floor(greatest(0, least(1, ({x} - ({lo})) / (({hi}) - ({lo})))) * 64 + 0.5)::bigint"


@query(f"""select event_id, {_SHARE('value', '0', '50')} as linear, {_SHARE('ln(value + 1)', 'ln(1)', 'ln(1000)')} as logarithmic, {_SHARE('ln(value + 0.5)', 'ln(1 / 100.0::double)', 'ln(100)')} as reciprocal_log from events where value >= 0""")
def vector_scalars(spark, d):
    """How many of 64 places each encoding of a value fills."""
    v = F.col("value")
    ones = lambda x: F.size(F.filter(x, lambda y: y > 0)).cast("long")
    e = table(spark, d, "events").where("value >= 0")
    return e.select("event_id", ones(V.linear(v, F.lit(50.0), 64)).alias("linear"), ones(V.logarithmic(v + 1, 1.0, 1000.0, 64)).alias("logarithmic"), ones(V.reciprocal_log(v + 0.5, 100.0, 64)).alias("reciprocal_log"))


_FAMILIES = f"""with {SIGNS}, g as (select vec_id // 13 as g, count(*) as n, list(v order by vec_id) as l from e where vec_id % 13 <= (vec_id // 13) % 13 group by 1),
b as (select g, n, n > 8 as over, {_digits("list_transform(range(1, len(l[1]) + 1), lambda i: sign(list_sum(list_transform(l, lambda x: x[i]))))")} as v from g)"""


@query(f"{_FAMILIES} select g, n, v as silent, v as warned, over as warning, case when not over then v end as held, over as error from b")
def capacity_guard(spark, d):
    """Bundles of one to thirteen vectors of 64 places, which carry eight, under the guards that don't stop the query."""
    s = signs(spark, d).where(F.col("vec_id") % 13 <= F.floor(F.col("vec_id") / 13) % 13)
    g = s.groupBy(F.floor(F.col("vec_id") / 13).alias("g")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("l"))
    made = {m: V.guarded_bundle(F.col("l"), 64, m) for m in V.GUARDS if m != "abort"}
    return g.select("g", "n", digits(made["silent"]["vector"]).alias("silent"), digits(made["warn"]["vector"]).alias("warned"), made["warn"]["overflow"].alias("warning"), digits(made["error"]["vector"]).alias("held"), made["error"]["overflow"].alias("error"))
