"""Queries of journals, releases, audits and trees, and their SQL, which chains hashes by recursion over all blocks at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.operators import forms, journal, trees
from candlemill.operators.series import numbered
from candlemill.plans.catalogue import BY_TYPE, by_type, query, table

BLOCK = 256


def entries(spark, d):
    """Orders as entries of a journal, in order of their keys."""
    o = table(spark, d, "orders")
    body = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", F.floor(F.col("o_totalprice") * 100).cast("string"))
    rows = numbered(o.select(F.lit(0).alias("all"), "o_orderkey", body.alias("body")), key="all", order="o_orderkey", out="seq", slot=F.floor(F.col("o_orderkey") / 10_000))
    return rows.select("seq", "body")


_CHAIN = f"""with recursive b as (select row_number() over (order by o_orderkey) - 1 as seq, o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || floor(o_totalprice * 100)::bigint as body from orders),
g as materialized (select *, seq // {BLOCK} as block, seq % {BLOCK} as k from b),
ch(block, k, seq, body, hash) as (select block, k, seq, body, sha256('block ' || block || '|' || seq || '|' || body) from g where k = 0
    union all select g.block, g.k, g.seq, g.body, sha256(ch.hash || '|' || g.seq || '|' || g.body) from ch join g on g.block = ch.block and g.k = ch.k + 1),
en as (select block, count(*) as n, arg_max(hash, seq) as last from ch group by 1), hd(block, n, last, head) as (select block, n, last, sha256('|' || last) from en where block = 0 union all select en.block, en.n, en.last, sha256(hd.head || '|' || en.last) from hd join en on en.block = hd.block + 1)
"""


@query(_CHAIN + "select seq, body, hash from ch")
def journal_entries(spark, d):
    return journal.build(entries(spark, d), BLOCK)


@query(_CHAIN + "select block, n, last, head from hd")
def journal_heads(spark, d):
    return journal.heads(journal.build(entries(spark, d), BLOCK), BLOCK)


def tampered(j):
    """A journal with bodies changed, bodies changed and hashed anew, entries lost, and a last entry lost."""
    changed = j.withColumn("body", F.when(F.col("seq") % 1000 == 7, F.concat("body", F.lit("0"))).when(F.col("seq") % 2000 == 11, F.concat("body", F.lit("1"))).otherwise(F.col("body")))
    before = F.lag("hash").over(Window.partitionBy(F.floor(F.col("seq") / BLOCK)).orderBy("seq"))
    hashed = changed.withColumn("hash", F.when(F.col("seq") % 2000 == 11, F.sha2(F.concat_ws("|", before, F.col("seq").cast("string"), "body").cast("binary"), 256)).otherwise(F.col("hash")))
    return hashed.where(f"seq % 1500 <> 303 and seq % {BLOCK * 20} <> {BLOCK * 3 - 1}")


@query(_CHAIN + f""", t0 as (select block, seq, case when seq % 1000 = 7 then body || '0' when seq % 2000 = 11 then body || '1' else body end as body, hash, lag(hash) over (partition by block order by seq) as bh from ch),
t as (select block, seq, body, case when seq % 2000 = 11 then sha256(bh || '|' || seq || '|' || body) else hash end as hash from t0 where seq % 1500 <> 303 and seq % {BLOCK * 20} <> {BLOCK * 3 - 1}),
l as (select *, lag(seq) over w as ps, lag(hash) over w as ph from t window w as (partition by block order by seq)),
f as (select block, seq, case when seq > coalesce(ps + 1, block * {BLOCK}) then 'gap' when hash <> sha256(coalesce(ph, 'block ' || block) || '|' || seq || '|' || body) then 'hash' end as fault from l),
e as (select block, count(*) as n, arg_max(hash, seq) as last from t group by 1)
select block, seq, fault from f where fault is not null union all select hd.block, null, 'end' from hd left join e using (block) where e.n is distinct from hd.n or e.last is distinct from hd.last""")
def journal_audit(spark, d):
    """The faults of a damaged journal against the heads of the sound one: every damage names its place."""
    sound = journal.build(entries(spark, d), BLOCK)
    return journal.audit(tampered(sound), journal.heads(sound, BLOCK), BLOCK)


_FORM = "o_custkey % 50 || ' ' || o_orderpriority || ' ' || {}"


@query(f"""with r as (select sha256({_FORM.format('o_orderstatus')}) as address, max({{'seq': o_orderkey, 'name': (o_custkey % 50)::varchar, 'version': o_orderpriority}}) as r from orders group by 1),
q as (select o_orderkey as id, sha256({_FORM.format("'F'")}) as address, {_FORM.format('o_orderstatus')} as form from orders where o_orderkey % 7 = 0)
select id, r.r.seq as seq, r.r.name as name, r.r.version as version, r.address is not null and q.address = sha256(form) as sound from q left join r using (address)""")
def release_fetch(spark, d):
    """Every seventh order asks for the finished form of itself and expects its own."""
    o = table(spark, d, "orders")
    form = lambda status: F.concat_ws(" ", F.col("o_custkey") % 50, "o_orderpriority", status)
    registry = journal.publish(o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).cast("string").alias("name"), F.col("o_orderpriority").alias("version"), form(F.col("o_orderstatus")).alias("form")))
    asked = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), journal.address(form(F.lit("F"))).alias("address"), form(F.col("o_orderstatus")).alias("form"))
    return journal.fetch(asked, registry)


@query("""with s as (select user_id as trace, event_id as place, event_type || ' ' || props as form from events), a as (select trace, place, form, sha256(case when place % 97 = 0 then form || '!' else form end) as receipt, place % 211 = 0 as lost from s)
select trace, count(*) filter (not lost) as steps, bool_and(not lost and receipt = sha256(form)) as sound, min(place) filter (lost or receipt <> sha256(form)) as first_fault from a group by 1""")
def trace_audit(spark, d):
    """Users' events as steps of agents: some receipts are of another form, some steps are lost."""
    e = table(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("place"), F.concat_ws(" ", "event_type", "props").alias("form"))
    said = F.when(F.col("place") % 97 == 0, F.concat("form", F.lit("!"))).otherwise(F.col("form"))
    return journal.audit_traces(e.where("place % 211 <> 0").select("trace", "place", journal.address(said).alias("receipt")), e)


# --- trees ---------------------------------------------------------------------------------------------------------

BASE, DEPTH = 8, 8


def customers(spark, d):
    """A tree for each region's nation, of its customers' numbers."""
    return trees.trie(table(spark, d, "customer"), F.col("c_nationkey"), F.col("c_custkey"), BASE, DEPTH)


@query("select c_custkey as query, c_custkey as value, true as like_it from customer")
def tree_walks(spark, d):
    """Every customer is found again by its path through the vectors of its nation's tree."""
    known = trees.steps(table(spark, d, "customer"), F.col("c_nationkey"), F.col("c_custkey"), BASE, DEPTH)
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.col("c_nationkey").cast("string").alias("tree"), F.array(*(F.floor(F.col("c_custkey") / BASE ** (DEPTH - 1 - k)).cast("int") % BASE for k in range(DEPTH))).alias("path"))
    found = trees.follow(asked, known, DEPTH, BASE)
    return found.select("query", "value", (F.col("cosine") > 0.2).alias("like_it"))


_LEVELS = "l8 as (select c_nationkey as tree, c_custkey as n, '(leaf ' || c_custkey || ')' as text from customer)" + "".join(
    f", l{k - 1} as (select tree, n // 8 as n, '(node' || string_agg(' ' || n % 8 || ' ' || text, '' order by n % 8) || ')' as text from l{k} group by tree, n // 8)" for k in range(8, 0, -1)
)


@query(f"with {_LEVELS} select tree::varchar as tree, length(text) as chars, sha256(text) as digest from l0")
def tree_texts(spark, d):
    t = trees.canonical(customers(spark, d))
    return t.select("tree", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("select c_nationkey::varchar as tree, list_aggregate(list_transform(range(0, 8), lambda k: (c_custkey // (8 ** (7 - k))::bigint) % 8), 'string_agg', '.') as path, c_custkey as value from customer")
def tree_leaves(spark, d):
    f = trees.flatten(customers(spark, d))
    return f.select("tree", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "value")


# --- forms ---------------------------------------------------------------------------------------------------------


def form_nodes(spark, d):
    """Each day of a kind of event as a form: a bundle of when it was, how much came, and the sequence of its closes."""
    c = by_type(spark, d)
    day = F.date_trunc("day", "ts")
    g = c.groupBy("sym", day.alias("day")).agg(F.sum("volume").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("l"))
    form = F.concat_ws(" ", "sym", F.date_format("day", "yyyy-MM-dd"))
    node = lambda n, up, place, kind, name=None, *args: F.struct(F.lit(n).alias("node"), F.lit(up).alias("parent"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name"), F.array(*args).cast("array<double>").alias("args"))
    fixed = [
        node("r", None, 0, "bundle"), node("w", "r", 0, "bind"), node("wn", "w", 0, "atom", "day-of-week"), node("wv", "w", 1, "circular", None, F.dayofweek("day") - 1, F.lit(7)),
        node("v", "r", 1, "bind"), node("vn", "v", 0, "atom", "volume"), node("vv", "v", 1, "log", None, F.col("n")), node("s", "r", 2, "sequential"), node("q", "r", 3, "bundle"), node("qm", "q", 0, "atom", "mark"), node("qp", "q", 1, "permute", None, F.lit(2)), node("qa", "qp", 0, "atom", "event"),
    ]
    closes = F.transform("l", lambda x, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("node"), F.lit("s").alias("parent"), i.alias("place"), F.lit("linear").alias("kind"), F.lit(None).cast("string").alias("name"), F.array(x["close"], F.lit(500.0)).alias("args")))
    return g.select(form.alias("form"), F.explode(F.concat(F.array(*fixed), closes)).alias("x")).select("form", "x.*")


_NUM = r"regexp_replace(round({}::double, 4)::decimal(30,4)::varchar, '\.?0+$', '')".format
_FORMS = f"""with {BY_TYPE}, x as (select sym || ' ' || strftime(ts, '%Y-%m-%d') as form, dayofweek(date_trunc('day', ts)) as w, volume, close, ts from c),
g as (select form, any_value(w) as w, sum(volume) as n, list('(linear ' || {_NUM('close')} || ' 500)' order by ts) as cl from x group by 1)"""
_EDN = f"""'(bundle\n  (bind\n    (atom "day-of-week")\n    (circular ' || {_NUM('w')} || ' 7))\n  (bind\n    (atom "volume")\n    (log ' || {_NUM('n')} || '))\n  (sequential' || list_aggregate(list_transform(cl, lambda y: '\n    ' || y), 'string_agg', '') || ')\n  (bundle\n    (atom "mark")\n    (permute\n      (atom "event")\n      2)))'"""


@query(f"{_FORMS} select form, length({_EDN}) as chars, sha256({_EDN}) as digest from g")
def form_texts(spark, d):
    t = forms.to_edn(form_nodes(spark, d))
    return t.select("form", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"""{_FORMS}, f as (select form, unnest(list_concat(cl, ['(bind\n  (atom "day-of-week")\n  (circular ' || {_NUM('w')} || ' 7))', '(bind\n  (atom "volume")\n  (log ' || {_NUM('n')} || '))', '(permute\n  (atom "event")\n  2)'])) as text from g)
select form, text from f""")
def form_facts(spark, d):
    return forms.collect_facts(form_nodes(spark, d)).select("form", "text")


@query()
def form_presence(spark, d):
    p = forms.presence(form_nodes(spark, d))
    return p.select("form", "node", F.round("presence", 6).alias("presence"))
