"""Streaming indexing: raw logs in, event tables out, with resume and replay safety."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frontier import islands
from ..operators.registry import require_aligned, resume_block
from ..plans.jobs import Job, job_logs, validate_job
from ..sources.store import EventStore

PROGRESS = "indexing"


def _heartbeat(like: DataFrame) -> DataFrame:
    """A stream without rows of the same columns that has something new at each trigger, so that a
    batch runs, and the head is asked for, also while no file comes."""
    beat = like.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.lit(False))
    return beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _covered(batch: DataFrame, job: Job) -> list[tuple[int, int]]:
    """The block ranges that a batch's chunk marks cover, merged before they come to the driver."""
    marks = batch.where(F.col("chunk_start").isNotNull() & F.col("chunk_end").isNotNull())
    chunks = islands(marks.select(F.lit(job.job_id).alias("job_id"), "chunk_start", "chunk_end"))
    return [(r.chunk_start, r.chunk_end) for r in chunks.collect()]


def index_stream(
    logs: DataFrame,
    job: Job,
    store: EventStore,
    checkpoint: str,
    follow: str | None = None,
    head: int | Callable[[], int] | None = None,
) -> StreamingQuery:
    """Start indexing a stream of raw logs for one job.

    A stream of chunks (`stream_chunks`) also says which block ranges its files cover. Progress is then
    what the store has without a gap, empty ranges included; else it is the highest block seen.

    head: the highest final block, as a number or a function that is asked for each batch.
    Logs above it are held back in the store, and committed by the first batch that finds the
    head beyond them. A heartbeat makes sure that such a batch comes.

    Without `follow` the query works off what is there and stops; with it (a trigger
    interval such as "1 second") it keeps polling. The checkpoint makes a restart go on
    after the last finished batch, batches replace their own output when they run again,
    and logs that were delivered before are not stored twice."""
    validate_job(job)
    require_aligned(store.job_registry(job), job.catalog.chain_id, job.catalog.hashes)
    chunked = "chunk_end" in logs.columns

    def final() -> int | None:
        return head() if callable(head) else head

    def commit(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            mine = job_logs(held, job).drop("job_id", "chain_id") if chunked else held
            store.commit_batch(mine, job, batch_id, head=final(), covered=_covered(held, job) if chunked else None)
        finally:
            held.unpersist()

    # Marks of chunks must reach the batch, so the job's filters wait until then.
    wanted = logs if chunked else job_logs(logs, job).drop("job_id", "chain_id")
    wanted = wanted.observe(PROGRESS, F.max("block_number").alias("indexed_block"), F.count("block_number").alias("logs"))
    if head is not None:
        wanted = wanted.unionByName(_heartbeat(wanted))
    writer = wanted.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.queryName(f"index-{job.job_id}")
    writer = writer.trigger(processingTime=follow) if follow else writer.trigger(availableNow=True)
    return writer.start()


def observed(query: StreamingQuery) -> tuple[int | None, int]:
    """Highest block and number of logs of the last batch, for monitoring."""
    metrics = (query.lastProgress or {}).get("observedMetrics", {}).get(PROGRESS)
    return (metrics["indexed_block"], metrics["logs"]) if metrics else (None, 0)


def backfill(logs: DataFrame, job: Job, store: EventStore, checkpoint: str, head: int | Callable[[], int] | None = None) -> None:
    """Index what is there and wait for the end."""
    query = index_stream(logs, job, store, checkpoint, head=head)
    query.awaitTermination()


def next_block(store: EventStore, job: Job) -> int:
    """Where the job goes on: its start, or the block after its slowest event."""
    row = resume_block(store.job_registry(job), job.catalog.chain_id, job.catalog.hashes, job.start_block).first()
    return row.resume_block
