"""In-order release of chunks that arrive in any order.

`index_in_order` keeps what is announced as merged block ranges in the job's commit records; chunks are
merged by Spark, within block spans first, so no task has all of a job's. Logs are not held: the blocks
that a batch brings within reach are read from the staged logs.

`ordered_release` is the same as a stream of its own, for other consumers. Its state of a job is the next
expected block and the chunks that wait for it, a few numbers each, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.frontier import islands
from ..plans.jobs import Job, job_logs, validate_job
from ..sources.logs import block_range, read_logs
from ..sources.manifest import frontier
from ..sources.store import EventStore

RELEASED = "job_id string, chunk_start long, chunk_end long"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    def __init__(self, starts: Mapping[str, int]):
        self.starts = dict(starts)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next_start = handle.getValueState("next", "block long")
        self.waiting = handle.getMapState("waiting", "chunk_start long", "chunk_end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (job_id,) = key
        expected = self.next_start.get()[0] if self.next_start.exists() else self.starts.get(job_id, 0)
        for batch in rows:
            for start, end in zip(batch["chunk_start"], batch["chunk_end"]):
                known = self.waiting.getValue((int(start),))[0] if self.waiting.containsKey((int(start),)) else -1
                if end >= expected and end > known:
                    self.waiting.updateValue((int(start),), (int(end),))
        released = []
        # Chunks may overlap: one that begins at or before the expected block moves the frontier.
        for start, end in sorted((s[0], e[0]) for s, e in self.waiting.iterator()):
            if start > expected:
                break
            self.waiting.removeKey((start,))
            if end >= expected:
                released.append((job_id, expected, end))
                expected = end + 1
        self.next_start.update((expected,))
        yield pd.DataFrame(released, columns=["job_id", "chunk_start", "chunk_end"])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB state store: start the stream within this block."""
    before = spark.conf.get(_PROVIDER_KEY)
    spark.conf.set(_PROVIDER_KEY, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER_KEY, before)


def ordered_release(chunks: DataFrame, starts: Mapping[str, int]) -> DataFrame:
    """Stream of chunks (job_id, chunk_start, chunk_end) -> the same, each job gap-free from its start."""
    return chunks.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_InOrder(starts),
        outputStructType=RELEASED,
        outputMode="Append",
        timeMode="None",
    )


def index_in_order(
    chunks: DataFrame,
    logs: Mapping[str, DataFrame | str],
    jobs: Sequence[Job],
    store: EventStore,
    checkpoint: str,
    staged_bucket_blocks: int | None = None,
    follow: str | None = None,
) -> StreamingQuery:
    """Commit each job's logs up to its gap-free frontier, as its chunks are announced.

    chunks: stream of announcements; logs: job id -> path of the staged raw logs of its chain,
    which each batch lists anew, or a frame of logs that are all there. The bucket size of
    staged logs lets a range read prune. Without `follow` the query works off what is announced
    and stops; with it (a trigger interval such as "1 second") it keeps polling."""
    for job in jobs:
        validate_job(job)

    def commit(batch: DataFrame, batch_id: int) -> None:
        named = batch.where(F.col("job_id").isin([job.job_id for job in jobs]))
        announced: dict[str, list[tuple[int, int]]] = {}
        for r in islands(named.select("job_id", "chunk_start", "chunk_end")).collect():
            announced.setdefault(r.job_id, []).append((r.chunk_start, r.chunk_end))
        for job in jobs:
            last = store.manifest.read(job.job_id)
            # A batch that has been committed holds the same announcements when it runs again.
            if job.job_id not in announced or last.batch_id >= batch_id:
                continue
            before = frontier(last.ranges, job.start_block)
            reached = frontier([*last.ranges, *announced[job.job_id]], job.start_block)
            source = logs[job.job_id]
            rows = read_logs(store.spark, source, "parquet") if isinstance(source, str) else source
            mine = block_range(job_logs(rows, job), before + 1, reached, staged_bucket_blocks)
            store.commit_batch(mine.drop("job_id", "chain_id"), job, batch_id, processed_to=reached, covered=announced[job.job_id])

    writer = chunks.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=follow) if follow else writer.trigger(availableNow=True)
    return writer.start()
