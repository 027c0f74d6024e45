"""Sinks: ledger and telemetry tables as partitioned Parquet, in batches and from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The tables' columns.
TABLES = {
    "observer_snapshots": "candle long, observer_idx long, lens string, disc_strength double, conviction double, experience double, resolved long, recalib_count long, recalib_wins long, recalib_total long, last_prediction string, us_elapsed long, thought_ast string, fact_count long",
    "regime_observer_snapshots": "candle long, regime_idx long, lens string, us_elapsed long, thought_ast string, fact_count long",
    "broker_snapshots": "candle long, broker_slot_idx long, grace_count long, violence_count long, paper_count long, expected_value double, fact_count long, thought_ast string",
    "phase_snapshots": "candle long, close double, phase_label string, phase_direction string, phase_duration long, phase_count long, phase_history_len long",
    "telemetry": "namespace string, id string, dimensions string, timestamp_ns long, metric_name string, metric_value double, metric_unit string",
    "metric": "start_time_ns long, end_time_ns long, namespace string, uuid string, tags map<string,string>, metric_name string, metric_value double, metric_unit string",
    "log": "time_ns long, namespace string, caller string, level string, uuid string, tags map<string,string>, data string",
}


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ", 1)) for f in schema.replace("map<string,string>", "map<string;string>").split(",")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns, in order and cast; ValueError names those that it lacks."""
    fields = _fields(TABLES[table])
    missing = [n for n, _ in fields if n not in df.columns]
    if missing:
        raise ValueError(f"{table} needs {', '.join(missing)}")
    return df.select(*(F.col(n).cast(t.replace(";", ",")).alias(n) for n, t in fields))


def append(df: DataFrame, base: str, table: str, run_name: str) -> None:
    """Append rows of a run; a run is a partition, so that readers of one pass over the others."""
    conform(df, table).withColumn("run_name", F.lit(run_name)).write.mode("append").partitionBy("run_name").parquet(f"{base.rstrip('/')}/{table}")


def append_stream(stream: DataFrame, base: str, table: str, run_name: str, checkpoint: str, trigger: str = "5 seconds") -> StreamingQuery:
    """The same from a stream, a micro-batch each trigger; the checkpoint makes it write every row once."""
    rows = conform(stream, table).withColumn("run_name", F.lit(run_name))
    return rows.writeStream.format("parquet").partitionBy("run_name").option("path", f"{base.rstrip('/')}/{table}").option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
