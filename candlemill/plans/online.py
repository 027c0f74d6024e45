"""Queries of online learning and of lookups by likeness, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.operators import online, retrieval
from candlemill.plans.catalogue import SIGNS, query, rounded, signs, table


@query()
def subspace_residuals(spark, d):
    """Each vector's distance from the subspace of those of its class with smaller ids."""
    found = online.subspace_residuals(signs(spark, d), key="label", id_col="vec_id", vector="r")
    return rounded(found.select("key", F.col("id").alias("vec_id"), "residual"))


@query("""with v as (select l_returnflag as flag, l_linenumber as line, floor(greatest(0, least(1, l_discount / 0.1)) * 256 + 0.5)::int as lv, 1 + l_quantity as w from lineitem where l_tax < 0.04),
g as (select flag, line, lv, sum(w) as w from v group by 1, 2, 3), p as (select flag, line, pos, sign(sum(case when lv >= pos then w else -w end)) as a from g, (select unnest(range(1, 257)) as pos) group by 1, 2, 3),
s as (select unnest(range(21)) as step), c as (select step, 0.0::double + step * 0.005::double as value, floor(greatest(0, least(1, (0.0::double + step * 0.005::double) / 0.1)) * 256 + 0.5)::int as m from s),
x as (select flag, line, step, value, sum(case when pos <= m then a else -a end) / (sqrt(sum(abs(a))) * 16) as cosine from p, c group by 1, 2, 3, 4)
select flag, line, round(value, 6) as value, round(cosine, 6) as cosine from x qualify row_number() over (partition by flag, line order by cosine desc, step) = 1""")
def scalar_extract(spark, d):
    """Which discount is most like the lightly taxed lines', by flag and line number, out of twenty-one."""
    rows = table(spark, d, "lineitem").withColumns({"flag": F.col("l_returnflag"), "line": F.col("l_linenumber")})
    b = online.accumulate(rows, ["flag", "line"], F.col("l_discount"), F.when(F.col("l_tax") < 0.04, "Grace").otherwise("Violence"), F.col("l_quantity"), 0.0, 0.1, 256)
    return rounded(online.extract(b, ["flag", "line"], 0.0, 0.1, 21, 256))


@query(f"""with {SIGNS}, x as (select vec_id % 3 as key, vec_id as id, label, r, row_number() over (partition by vec_id % 3 order by vec_id) - 1 as i from e), y as (select *, i // 50 as epoch from x),
q as (select distinct key, epoch from y where epoch > 0), w as (select q.key, q.epoch, y.label, pow(0.98::double, q.epoch * 50 - 1 - y.i) as w, unnest(range(1, 1 + len(r))) as pos, unnest(r) as val from q join y on y.key = q.key and y.epoch < q.epoch),
s as (select key, epoch, label, pos, sum(w * val) as v, sum(w) as n from w group by 1, 2, 3, 4), p as (select key, epoch, label, list(v order by pos) as v, max(n) as n from s group by 1, 2, 3),
c as (select y.*, p.label as guess, p.n, list_cosine_similarity(r, p.v) as cs from y join p using (key, epoch)), o as (select *, row_number() over g as k, lead(cs) over g as nx from c window g as (partition by key, id order by cs desc, guess))
select y.key, y.id, o.guess, round(o.cs - coalesce(o.nx, 0), 6) as conviction, round(o.n, 6) as experience, y.epoch from y left join o on o.key = y.key and o.id = y.id and o.k = 1""")
def decaying_reckoner(spark, d):
    s = signs(spark, d).withColumn("key", F.col("vec_id") % 3)
    return rounded(online.decaying_reckoner(s, key="key", id_col="vec_id", label="label", vector="r", cosine=V.cosine, decay=0.98, interval=50))


# --- lookups -------------------------------------------------------------------------------------------------------

COINCIDENT = 0.35


def _lookup(spark, d):
    rows = retrieval.entries(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rows, rows.where("id % 20 = 0")


_DISTINCT = "d as (select min(vec_id) as id, list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id is not null and embedding is not null group by embedding), q as (select * from d where id % 20 = 0), s as (select q.id as query, d.id, list_cosine_similarity(q.v, d.v) as cosine from q join d on d.id <> q.id)"


@query()
def nearest_by_index(spark, d):
    """Every twentieth vector asks for the one most like it, through the index; the tests measure its recall."""
    rows, _ = _lookup(spark, d)
    fitted = retrieval.centres(retrieval.valid(table(spark, d, "embeddings"), "vec_id", "embedding"))
    index = retrieval.build_cells(rows, fitted)
    return rounded(retrieval.search_cells(index.where("id % 20 = 0"), index, fitted))


@query(f"with {_DISTINCT} select query, id, round(cosine, 6) as cosine from s qualify row_number() over (partition by query order by cosine desc, id) = 1")
def nearest_by_comparison(spark, d):
    rows, asked = _lookup(spark, d)
    return rounded(retrieval.all_pairs_best(asked, rows))


@query(f"with {_DISTINCT} select query, id, round(cosine, 6) as cosine from s where id < query and cosine >= {COINCIDENT} qualify row_number() over (partition by query order by id) = 1")
def first_coincident(spark, d):
    """Of the vectors inserted before, the first that is as good as the same."""
    rows, asked = _lookup(spark, d)
    return rounded(retrieval.all_pairs_best(asked, rows, COINCIDENT))
