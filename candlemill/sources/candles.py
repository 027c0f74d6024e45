"""Candle sources: OHLCV files, and candles built from event tables.

A candle is (sym, ts, open, high, low, close, volume). Ordering by ts within sym is total: builders make one row for each
bucket, and readers reject repeated times downstream only by the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close", "volume")
OHLCV = T.StructType([T.StructField("ts", T.TimestampType(), False), *(T.StructField(c, T.DoubleType(), False) for c in PRICES)])


def read_ohlcv(spark: SparkSession, path: str, sym: str = "BTC/USDC") -> DataFrame:
    """Parquet with ts (micro- or milliseconds) and prices; a missing column, another type or a null fails the query."""
    raw = spark.read.parquet(path)
    missing = {f.name for f in OHLCV} - set(raw.columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    kinds = dict(raw.dtypes)
    if not kinds["ts"].startswith("timestamp") or any(kinds[c] != "double" for c in PRICES):
        raise ValueError("ts must be a timestamp and prices doubles")
    whole = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast(kinds[c])).alias(c)
    return raw.select(F.lit(sym).alias("sym"), *(whole(f.name) for f in OHLCV))


def read_streams(spark: SparkSession, specs: list[str]) -> DataFrame:
    """SOURCE:TARGET:PATH for each stream, one table with sym SOURCE/TARGET."""
    out = None
    for spec in specs:
        source, target, path = spec.split(":", 2)
        one = read_ohlcv(spark, path, f"{source}/{target}")
        out = one if out is None else out.unionByName(one)
    return out


def bucketed(df: DataFrame, sym, bucket, price: str, order: list[str], volume) -> DataFrame:
    """Candles from rows: only buckets with rows exist."""
    key = F.struct(*order)
    return df.groupBy(sym.alias("sym"), bucket.alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), volume.cast("double").alias("volume")
    )


def hourly(events: DataFrame) -> DataFrame:
    return bucketed(events, F.lit("all"), F.date_trunc("hour", "ts"), "value", ["ts", "event_id"], F.count("*"))


def hourly_by_type(events: DataFrame) -> DataFrame:
    return bucketed(events, F.col("event_type"), F.date_trunc("hour", "ts"), "value", ["ts", "event_id"], F.count("*"))


def daily_lineitem(lineitem: DataFrame) -> DataFrame:
    return bucketed(lineitem, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), "l_extendedprice", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.sum("l_quantity"))


def daily_orders(orders: DataFrame, groups: int = 20) -> DataFrame:
    """Prices of orders by day, a series for each of groups groups of customers."""
    return bucketed(orders, F.pmod("o_custkey", F.lit(groups)).cast("string"), F.date_trunc("day", "o_orderdate"), "o_totalprice", ["o_orderdate", "o_orderkey"], F.count("*"))


def open_bounded(candles: DataFrame, n: int) -> DataFrame:
    """The first n candles in time; none where n <= 0."""
    return candles.orderBy("ts", "sym").limit(max(n, 0))


def skip(candles: DataFrame, n: int, m: int) -> DataFrame:
    """m candles of each series after its first n."""
    place = F.row_number().over(Window.partitionBy("sym").orderBy("ts"))
    return candles.withColumn("place", place).where((F.col("place") > n) & (F.col("place") <= n + m)).drop("place")


def strided(candles: DataFrame, windows: int, stride: int, length: int) -> DataFrame:
    """Overlapping samples: window w has the length candles of a series from w * stride on. A row goes straight to its windows."""
    at = F.row_number().over(Window.partitionBy("sym").orderBy("ts")) - 1
    placed = candles.withColumn("at", at)
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - length + 1) / stride)).cast("int")
    last = F.least(F.lit(windows - 1), F.floor(F.col("at") / stride)).cast("int")
    return placed.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))
