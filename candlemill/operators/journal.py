"""Append-only journals whose entries are chained by hashes, a registry of releases by content, and audits of traces.

Entries of a block are chained one to the next; the last hash of every block is chained into the heads. Blocks are built
and checked side by side; only heads, one row a block, follow one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _link(before: Column, seq: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, seq.cast("string"), body).cast("binary"), 256)


def _start(block: Column) -> Column:
    """What the first entry of a block is chained to."""
    return F.concat(F.lit("block "), block.cast("string"))


def build(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """entries (seq, from 0 without gaps; body): seq, body, hash. A null body counts as empty."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        last, out = f"block {int(pdf['seq'].iloc[0]) // block}", []
        for seq, body in zip(pdf["seq"], pdf["body"], strict=True):
            last = hashlib.sha256(f"{last}|{seq}|{body}".encode()).hexdigest()
            out.append(last)
        return pdf.assign(hash=out)[["seq", "body", "hash"]]

    rows = entries.select(F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("body"), F.lit("")).alias("body"))
    return rows.groupBy(F.floor(F.col("seq") / block).alias("block")).applyInPandas(chain, "seq long, body string, hash string")


def heads(journal: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, n, last (its last hash), head: each block's last hash chained to the head before. The head of the last block
    stands for the whole journal."""
    ends = journal.groupBy(F.floor(F.col("seq") / block).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "seq").alias("last"))

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = ""
        for pdf in frames:
            out = []
            for last in pdf["last"]:
                head = hashlib.sha256(f"{head}|{last}".encode()).hexdigest()
                out.append(head)
            yield pdf.assign(head=out)

    return ends.coalesce(1).sortWithinPartitions("block").mapInPandas(carry, "block long, n long, last string, head string")


def audit(journal: DataFrame, published: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, seq, fault of a journal against published heads; an empty result is a sound journal.

    gap: entries before seq are missing; again: seq occurs twice; hash: seq's body or hash isn't what was chained; end: the
    block's last entry or number isn't what was published; head: a published head doesn't follow from the one before.
    Every entry is compared with the one stored before it, so a block is checked without the others.
    """
    at = F.floor(F.col("seq") / block)
    by = Window.partitionBy("block").orderBy("seq", "hash")
    rows = journal.select(at.alias("block"), "seq", F.coalesce(F.col("body"), F.lit("")).alias("body"), "hash").withColumns({"_seq": F.lag("seq").over(by), "_hash": F.lag("hash").over(by)})
    first = F.col("_seq").isNull()
    due = F.when(first, F.col("block") * block).otherwise(F.col("_seq") + 1)
    right = _link(F.coalesce("_hash", _start(F.col("block"))), F.col("seq"), F.col("body"))
    fault = F.when(F.col("seq") < due, "again").when(F.col("seq") > due, "gap").when(F.coalesce(F.col("hash") != right, F.lit(True)), "hash")
    faults = rows.select("block", "seq", fault.alias("fault")).where("fault is not null")
    found = journal.groupBy(at.alias("block")).agg(F.count(F.lit(1)).alias("_n"), F.max_by("hash", "seq").alias("_last"))
    ends = published.join(found, "block", "full").where(~F.col("last").eqNullSafe(F.col("_last")) | ~F.col("n").eqNullSafe(F.col("_n")))
    ends = ends.select("block", F.lit(None).cast("long").alias("seq"), F.lit("end").alias("fault"))
    before = published.select((F.col("block") + 1).alias("block"), F.col("head").alias("_head"))
    follow = published.join(before, "block", "left").where(F.col("head") != F.sha2(F.concat_ws("|", F.coalesce("_head", F.lit("")), "last").cast("binary"), 256))
    return faults.unionByName(ends).unionByName(follow.select("block", F.lit(None).cast("long").alias("seq"), F.lit("head").alias("fault")))


# --- releases and traces -------------------------------------------------------------------------------------------


def address(form: Column) -> Column:
    """The content's own name."""
    return F.sha2(form.cast("binary"), 256)


def publish(releases: DataFrame) -> DataFrame:
    """releases (seq, name, version, form): the registry, address, seq, name, version: of releases of one content the last."""
    latest = releases.groupBy(address(F.col("form")).alias("address")).agg(F.max(F.struct("seq", "name", "version")).alias("r"))
    return latest.select("address", "r.*")


def fetch(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (id, address, form: what the consumer expects): what the registry holds there, and sound: it is there and is
    what was expected."""
    found = requests.join(registry, "address", "left")
    return found.select("id", "seq", "name", "version", (F.col("seq").isNotNull() & (F.col("address") == address(F.col("form")))).alias("sound"))


def audit_traces(steps: DataFrame, expected: DataFrame) -> DataFrame:
    """steps (trace, place, receipt), expected (trace, place, form): trace, steps, sound, first_fault.

    A trace is sound if every place has a step and an expectation and each receipt is its form's; first_fault is the first
    place where that fails. A step exchanged for another or put elsewhere fails at its place.
    """
    both = steps.join(expected.withColumn("_due", F.lit(True)), ["trace", "place"], "full")
    ok = F.coalesce((F.col("receipt") == address(F.col("form"))) & F.col("_due"), F.lit(False))
    return both.groupBy("trace").agg(F.count("receipt").alias("steps"), F.bool_and(ok).alias("sound"), F.min(F.when(~ok, F.col("place"))).alias("first_fault"))
