"""How far indexing streams are behind the chain, as they run."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.jobs import Job
from ..sources.store import EventStore
from .index import PROGRESS, next_block

SCHEMA = "job_id string, batch_id long, logs long, seen_block long, chain_head_block long, indexed_block long, lag long"


class LagListener(StreamingQueryListener):
    """Notes after each batch of the indexing streams of some jobs: the logs in it and their highest block,
    the chain's head, the block that the store has the job's logs up to, and the distance of both.

    heads: chain id -> function that gives the chain's head. Notes wait in memory until `drain` or `write`
    takes them; the oldest go when there are more than `keep`."""

    def __init__(self, store: EventStore, jobs: Mapping[str, Job], heads: Mapping[int, Callable[[], int]], keep: int = 10_000):
        self.store, self.jobs, self.heads, self.keep = store, {f"index-{j}": job for j, job in jobs.items()}, heads, keep
        self.notes: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        job = self.jobs.get(progress.name)
        if job is None:
            return
        seen = progress.observedMetrics.get(PROGRESS)
        head, indexed = self.heads[job.catalog.chain_id](), next_block(self.store, job) - 1
        note = (job.job_id, progress.batchId, seen["logs"] if seen else 0, seen["indexed_block"] if seen else None, head, indexed, max(0, head - indexed))
        with self.lock:
            self.notes = [*self.notes[1 - self.keep :], note]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def wait(self, batches: int, seconds: float = 60) -> None:
        """Until so many batches are noted: notes come a little after their batch."""
        end = time.monotonic() + seconds
        while len(self.notes) < batches and time.monotonic() < end:
            time.sleep(0.05)

    def drain(self, spark: SparkSession) -> DataFrame:
        """The notes taken since the last call."""
        with self.lock:
            taken, self.notes = self.notes, []
        return spark.createDataFrame(taken, SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the notes to a table, from which dashboards read them."""
        self.drain(spark).coalesce(1).write.mode("append").parquet(path)
