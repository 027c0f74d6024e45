"""Deadlines on event time: they fire without a request, after a restart too, and leave no state behind."""

import pandas as pd

from candlemill.streaming import timers

SCHEMA = "owner long, event_id long, ts timestamp, kind string, price double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minutes):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)).to_pydatetime()


def test_deadlines_fire_by_themselves_and_after_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:

        def step(rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            s = spark.readStream.schema(SCHEMA).parquet(str(source))
            q = timers.stream_deadlines(s, "60 minutes", "1 minute").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()  # every step is a new run
            return sorted((r.owner, r.paper_id, r.resolved_at, r.state) for r in spark.read.schema(timers.OUT).parquet(str(out)).collect()), q.lastProgress

        got, _ = step([(1, 10, at(0), "Submit", 100.0), (1, 11, at(5), "Submit", 200.0), (2, 12, at(6), "Submit", 100.0)])
        assert got == []
        got, _ = step([(1, 13, at(20), "Exit", 120.0)])  # leaves the first with a gain, the second would lose
        assert got == [(1, 10, at(20), "Grace")]
        got, progress = step([(3, 14, at(70), "Submit", 50.0)])  # another owner's event moves the time on; 1 and 2 stay silent
        assert got == [(1, 10, at(20), "Grace"), (1, 11, at(65), "Violence"), (2, 12, at(66), "Violence")]
        got, progress = step([(4, 15, at(500), "Exit", 1.0)])
        assert got[-1] == (3, 14, at(130), "Violence") and len(got) == 4
        assert progress["stateOperators"][0]["numRowsTotal"] == 0  # nothing is open, nothing is kept
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
