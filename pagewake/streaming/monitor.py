"""Monitoring as a stream: each micro-batch of captures becomes events and a new version of the sites' state.

Events and state of a batch lie under its number. A batch that is run again reads the state of the batch before it and
overwrites its own, so the tables are the same as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pagewake.operators import site_events

STATE = "site string, seq bigint, text string, links array<string>"
EVENTS = "site string, seq bigint, change_type string, summary string, sample string"


@dataclass(frozen=True)
class Monitor:
    """Tables of a monitor in a shared folder: events/batch=n and state/batch=n."""

    folder: str

    def state(self, spark: SparkSession, number: int) -> DataFrame:
        """The latest capture of each site after batch `number`; none before the first."""
        rows = spark.read.schema(STATE)
        return rows.parquet(f"{self.folder}/state/batch={number}") if number >= 0 else spark.createDataFrame([], STATE)

    def events(self, spark: SparkSession) -> DataFrame:
        """The events of all batches, with `batch`, the number of each."""
        return spark.read.schema(f"{EVENTS}, batch bigint").option("basePath", f"{self.folder}/events").parquet(f"{self.folder}/events/batch=*")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Writes the events and the state of a batch of captures; running it again changes nothing."""
        batch = batch.select("site", "seq", "text", "links")
        known = self.state(batch.sparkSession, number - 1)
        site_events.events(batch, known).write.mode("overwrite").parquet(f"{self.folder}/events/batch={number}")
        site_events.latest(batch, known).write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")

    def run(self, captures: DataFrame) -> StreamingQuery:
        """Takes what is available."""
        return captures.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()


@dataclass
class Runs(StreamingQueryListener):
    """Records the starts, progress and ends of the queries of a session, failures with their messages, as rows."""

    rows: list[tuple[str, str, int, str]] = field(default_factory=list)

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.id), "started", -1, ""))

    def onQueryProgress(self, event) -> None:
        self.rows.append((str(event.progress.id), "batch", event.progress.batchId, ""))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.id), "failed" if event.exception else "ended", -1, event.exception or ""))


def guarded(apply: Callable[[DataFrame, int], None], failures: str) -> Callable[[DataFrame, int], None]:
    """A batch function whose failures are recorded as rows of a table, so that the next tick goes on."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            apply(batch, number)
        except Exception as error:  # a tick that fails must not end the schedule
            row = [(number, datetime.now(timezone.utc), f"{type(error).__name__}: {error}"[:2000])]
            batch.sparkSession.createDataFrame(row, "batch bigint, failed_at timestamp, error string").coalesce(1).write.mode("overwrite").parquet(f"{failures}/batch={number}")

    return run


def scheduled(captures: DataFrame, apply: Callable[[DataFrame, int], None], folder: str, interval: str = "60 minutes") -> StreamingQuery:
    """Runs `apply` on what has come at once and then at every interval; a failing tick is recorded in folder/failures and the next one runs."""
    return captures.writeStream.foreachBatch(guarded(apply, f"{folder}/failures")).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=interval).start()
