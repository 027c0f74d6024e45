"""Nested forms as node tables: canonical text, the facts in them, their vectors, and how present each fact is.

A form is rows (form, node, parent, place, kind, name, args): the root has no parent; place orders a parent's children. Kinds
with children: bundle, sequential, bind (two), permute (one, args[0] is the shift). Leaves: atom (name), linear (value,
scale), log (value), circular (value, period), thermometer (value, min, max). Forms may be of any depth: a step works on
one level of all forms, and there are as many steps as levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions import vectors as V
from candlemill.sources.staging import staged

NESTED = ("bundle", "sequential")
_BREAK = "\x01"


def number(x: Column) -> Column:
    """To four digits, without trailing zeros."""
    return F.regexp_replace(F.round(x, 4).cast("decimal(30,4)").cast("string"), r"\.?0+$", "")


def leveled(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with level, from the roots down, and the number of levels; a node whose ancestors don't reach a root goes."""
    rows = staged(nodes, "forms")
    level = 0
    found = staged(rows.where("parent is null").withColumn("level", F.lit(0)), "level")
    made = found
    while True:
        above = found.select("form", F.col("node").alias("parent"))
        found = staged(rows.join(above, ["form", "parent"]).select(*nodes.columns, F.lit(level + 1).alias("level")), "level")
        if found.isEmpty():
            return staged(made, "levels"), level + 1
        made, level = made.unionByName(found), level + 1


def _leaf_text() -> Column:
    args = F.array_join(F.transform("args", number), " ")
    return F.when(F.col("kind") == "atom", F.concat(F.lit('(atom "'), F.col("name"), F.lit('")'))).otherwise(F.concat(F.lit("("), F.col("kind"), F.lit(" "), args, F.lit(")")))


def texts(levels: DataFrame, n: int) -> DataFrame:
    """The nodes of leveled with text: each one's form in extensible data notation, two blanks deeper with each level below it."""
    below, made = None, None
    for level in range(n - 1, -1, -1):
        here = levels.where(F.col("level") == level)
        if below is None:
            here = here.withColumn("text", _leaf_text())
        else:
            kids = below.groupBy("form", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_kids")).withColumnRenamed("parent", "node")
            deeper = F.transform("_kids", lambda k: F.concat(F.lit(_BREAK + "  "), F.replace(k["text"], F.lit(_BREAK), F.lit(_BREAK + "  "))))
            shift = F.when(F.col("kind") == "permute", F.concat(F.lit(_BREAK + "  "), number(F.col("args")[0]))).otherwise("")
            inner = F.concat(F.lit("("), F.col("kind"), F.array_join(deeper, ""), shift, F.lit(")"))
            here = here.join(kids, ["form", "node"], "left").withColumn("text", F.when(F.col("_kids").isNull(), _leaf_text()).otherwise(inner)).drop("_kids")
        below = staged(here, "texts")
        made = below if made is None else made.unionByName(below)
    return made.withColumn("text", F.translate("text", _BREAK, "\n"))


def to_edn(nodes: DataFrame) -> DataFrame:
    """form, text: equal forms have equal text."""
    return texts(*leveled(nodes)).where("level = 0").select("form", "text")


def collect_facts(nodes: DataFrame) -> DataFrame:
    """form, node, text: what a form states: bundles and sequences are opened, however deep; of what is in them atoms are names
    without a value, and everything else is a fact as it stands."""
    levels, n = leveled(nodes)
    return facts_of(levels, n).join(texts(levels, n).select("form", "node", "text"), ["form", "node"])


def facts_of(levels: DataFrame, n: int) -> DataFrame:
    """form, node of the facts of leveled forms: the open nodes of one level lead to those of the next."""
    open_ = levels.where("level = 0").select("form", "node", "kind")
    facts = open_.where(~F.col("kind").isin("atom", *NESTED))
    for level in range(1, n):
        above = open_.where(F.col("kind").isin(*NESTED)).select("form", F.col("node").alias("parent"))
        open_ = levels.where(F.col("level") == level).join(above, ["form", "parent"]).select("form", "node", "kind")
        facts = facts.unionByName(open_.where(~F.col("kind").isin("atom", *NESTED)))
    return facts.select("form", "node")


def _leaf_vector(d: int) -> Column:
    a = lambda i: F.get("args", F.lit(i))
    angle = a(0) * (2 * 3.141592653589793) / F.when(a(1) != 0, a(1))
    wheel = V.blend(V.atom(F.lit("cos"), d, "basis"), V.atom(F.lit("sin"), d, "basis"), F.cos(angle), F.sin(angle))
    return (
        F.when(F.col("kind") == "atom", V.atom(F.col("name"), d))
        .when(F.col("kind") == "linear", V.thermometer(a(0), -a(1), a(1), d))
        .when(F.col("kind") == "log", V.logarithmic(F.greatest(a(0), F.lit(1e-5)), 1e-5, 1e5, d))
        .when(F.col("kind") == "circular", wheel)
        .when(F.col("kind") == "thermometer", V.thermometer(a(0), a(1), a(2), d))
    )


def vectors(levels: DataFrame, n: int, d: int = 1024) -> DataFrame:
    """form, node, parent, level, vector: leaves by their kind, and what is above from its children: bound, bundled, shifted by a
    fixed number of places, or each shifted by its own place and bundled."""
    below, made = None, None
    for level in range(n - 1, -1, -1):
        here = levels.where(F.col("level") == level)
        own = _leaf_vector(d)
        if below is not None:
            kids = below.groupBy("form", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "vector"))).alias("_k")).withColumnRenamed("parent", "node")
            here = here.join(kids, ["form", "node"], "left")
            each = F.transform("_k", lambda k: k["vector"])
            turned = lambda v, by: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.get(v, F.pmod(j - by, F.lit(d)).cast("int")))
            placed = F.transform(each, lambda v, i: turned(v, i))
            own = (
                F.when(F.col("_k").isNull(), own).when(F.col("kind") == "bind", V.bind(each[0], F.get(each, F.lit(1))))
                .when(F.col("kind") == "permute", turned(each[0], F.get("args", F.lit(0)).cast("int"))).when(F.col("kind") == "sequential", V.bundle(placed)).otherwise(V.bundle(each))
            )
        below = staged(here.withColumn("vector", own).select("form", "node", "parent", "place", "level", "vector"), "vectors")
        made = below if made is None else made.unionByName(below)
    return made


def presence(nodes: DataFrame, d: int = 1024) -> DataFrame:
    """form, node, presence: the cosine of each fact's vector with its form's."""
    levels, n = leveled(nodes)
    made = vectors(levels, n, d)
    roots = made.where("level = 0").select("form", F.col("vector").alias("_whole"))
    own = made.join(facts_of(levels, n), ["form", "node"]).join(roots, "form")
    return own.select("form", "node", V.cosine(F.col("vector"), F.col("_whole")).alias("presence"))
