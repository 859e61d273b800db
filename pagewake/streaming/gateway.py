"""The gateway's state for each origin as streams: budget windows and cached access policies.

State is keyed by origin and kept in RocksDB; a restart goes on from the checkpoint. The rows of an origin are taken in order of
time within a micro-batch, whose size the source bounds (`maxFilesPerTrigger`, `maxBytesPerTrigger`), and batches are taken as they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagewake.sources.folders import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SLOTS = "id bigint, window_start double, slot int, admitted boolean"
POLICIES = "id bigint, outcome string, observed_at double, expires_at double"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")


class BudgetWindows(StatefulProcessor):
    """A fixed window of an origin opens with its first request after the last one's end; its requests take slots up to a limit."""

    def __init__(self, seconds: float, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start double, used int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, used = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for i, at in _in_order(rows)[["id", "at"]].itertuples(index=False):
            if start is None or at >= start + self.seconds:
                start, used = float(at), 0
            used += 1
            out.append((i, start, used, used <= self.limit))
        self.window.update((start, used))
        yield pd.DataFrame(out, columns=["id", "window_start", "slot", "admitted"]).astype({"slot": "int32"})


class PolicyCache(StatefulProcessor):
    """A policy holds from the request that fetched it until `ttl` seconds later.

    Requests are hits, misses (the origin had no policy yet) or expired (it had, but no longer). A timer drops a policy when the watermark passes its end;
    that an origin was met stays known.
    """

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.policy = handle.getValueState("policy", "observed_at double")
        self.met = handle.getValueState("met", "met boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        observed = self.policy.get()[0] if self.policy.exists() else None
        met, out = self.met.exists(), []
        for i, at in _in_order(rows)[["id", "at"]].itertuples(index=False):
            if observed is not None and observed <= at < observed + self.ttl:
                outcome = "hit"
            else:
                outcome, observed, met = "expired" if met else "miss", float(at), True
            out.append((i, outcome, observed, observed + self.ttl))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.policy.update((observed,))
        self.met.update((True,))
        self.handle.registerTimer(int((observed + self.ttl) * 1000))
        yield pd.DataFrame(out, columns=["id", "outcome", "observed_at", "expires_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.policy.exists() and (self.policy.get()[0] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.policy.clear()
        return iter([])


def budget_windows(requests: DataFrame, seconds: float, limit: int) -> DataFrame:
    """id, window_start, slot, admitted of a stream of id, origin, at (seconds)."""
    return requests.groupBy("origin").transformWithStateInPandas(statefulProcessor=BudgetWindows(seconds, limit), outputStructType=SLOTS, outputMode="Append", timeMode="None")


def cached_policies(requests: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """id, outcome, observed_at, expires_at of a stream of id, origin, at (seconds), ts (the same as a timestamp)."""
    timed = requests.withWatermark("ts", late)
    return timed.groupBy("origin").transformWithStateInPandas(statefulProcessor=PolicyCache(ttl), outputStructType=POLICIES, outputMode="Append", timeMode="EventTime")


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is available to a Parquet table, each micro-batch once; state goes to RocksDB."""
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The stream's rows as a table of the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    append(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
