"""Papers that end by themselves: keyed state with event-time timers, and state that goes when nothing is left in it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

_PAPER = StructType([StructField("entry_price", DoubleType()), StructField("deadline", LongType())])
_ID = StructType([StructField("paper_id", LongType())])
OUT = StructType([StructField("owner", LongType()), StructField("paper_id", LongType()), StructField("resolved_at", TimestampType()), StructField("state", StringType()), StructField("residue", DoubleType())])


class Papers(StatefulProcessor):
    """The open papers of an owner. A paper's deadline is a timer on event time: it fires once the watermark has passed, whether
    or not its owner ever asks again, and after a restart, as timers are part of the state. An owner without open papers keeps
    no state."""

    def __init__(self, horizon_ms: int, fee: float, notional: float):
        self.horizon_ms, self.fee, self.notional = horizon_ms, fee, notional

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.papers = handle.getMapState("papers", _ID, _PAPER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").itertuples():
            at = int(r.ts.timestamp() * 1000)
            if r.kind == "Submit":
                deadline = at + self.horizon_ms
                self.papers.updateValue((r.event_id,), (r.price, deadline))
                self.handle.registerTimer(deadline)
            elif r.kind == "Exit" and self.papers.exists():
                open_ = sorted((i[0], p[0], p[1]) for i, p in self.papers.iterator())
                for paper, entry, deadline in open_:
                    gain = (self.notional * (1 - self.fee) / entry if entry > 0 else 0.0) * r.price * (1 - self.fee) - self.notional
                    if gain > 0 and at < deadline:
                        self.papers.removeKey((paper,))
                        out.append((key[0], paper, r.ts, "Grace", gain))
                        break
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(i[0] for i, p in self.papers.iterator() if p[1] == now) if self.papers.exists() else []
        for paper in due:
            self.papers.removeKey((paper,))
        yield _frame([(key[0], paper, pd.Timestamp(now, unit="ms"), "Violence", None) for paper in due])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["owner", "paper_id", "resolved_at", "state", "residue"]).astype({"residue": "float64", "resolved_at": "datetime64[ns]"})


def stream_deadlines(requests: DataFrame, horizon: str = "2 hours", late: str = "10 minutes", fee_bps: float = 35.0, notional: float = 10_000.0) -> DataFrame:
    """requests (owner, event_id, ts, kind: Submit or Exit, price): outcomes as papers end. A submission opens a paper under its
    event's id; an exit closes the oldest open paper that it leaves with a gain; a paper that nobody closes within the horizon ends as
    Violence at its deadline. Requests later than the watermark are dropped, as everywhere in streams.

    The state lives in RocksDB: spark.sql.streaming.stateStore.providerClass must name its provider.
    """
    processor = Papers(int(pd.Timedelta(horizon).total_seconds() * 1000), fee_bps / 1e4, notional)
    keyed = requests.withWatermark("ts", late).groupBy("owner")
    return keyed.transformWithStateInPandas(processor, OUT, "Append", "EventTime")
