"""Index jobs: what to read, and several of them in one run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import FilterMap, by_contract, by_events, by_params, topic_filters
from ..operators.routing import decode
from ..sources.catalog import Catalog
from ..sources.logs import DEFAULT_BLOCK_RANGE, block_range


@dataclass(frozen=True)
class Job:
    """One unit of indexing: a chain, optionally a contract, its events and a start block.

    from_abi: all events of an ABI file; such a job takes every log of its contract and
    leaves unknown events to the routing step."""

    job_id: str
    catalog: Catalog
    contract: str | None = None
    start_block: int = 0
    block_range: int = DEFAULT_BLOCK_RANGE
    filters: Mapping[str, FilterMap] = field(default_factory=dict)
    from_abi: bool = False
    strict: bool = False


def validate_job(job: Job) -> None:
    """Raise ValueError for a job whose filters cannot be applied, before anything runs."""
    if not job.catalog.events:
        raise ValueError("the job names no events")
    if job.block_range < 1:
        raise ValueError("block_range must be at least 1")
    if not job.filters:
        return
    if job.from_abi or len(job.catalog.events) > 1:
        raise ValueError("parameter filters need a job of its own for each event")
    for name, filters in job.filters.items():
        topic_filters(job.catalog.event(name), filters)


def job_logs(logs: DataFrame, job: Job, head: int | None = None) -> DataFrame:
    """The raw logs a job listens to, tagged with its id and chain."""
    validate_job(job)
    rows = by_contract(logs, job.contract).where(F.col("block_number") >= job.start_block)
    if head is not None:
        rows = block_range(rows, job.start_block, head)
    if job.from_abi:
        pass
    elif len(job.catalog.events) == 1:
        event = job.catalog.events[0]
        filters = next(iter(job.filters.values()), None)
        rows = by_params(rows, event, filters)
    else:
        rows = by_events(rows, job.catalog.events)
    return rows.withColumns(
        {"job_id": F.lit(job.job_id), "chain_id": F.lit(job.catalog.chain_id).cast("long")}
    )


def run_jobs(sources: Mapping[str, DataFrame], jobs: Sequence[Job], head: int | None = None) -> dict[str, DataFrame]:
    """Event tables over all jobs (sources: job id -> raw logs of its chain).

    Jobs are checked first; each has its own plan, and tables that several jobs of a chain
    feed are their union."""
    if len({job.job_id for job in jobs}) != len(jobs):
        raise ValueError("job ids must be unique")
    for job in jobs:
        validate_job(job)
    parts: dict[str, list[DataFrame]] = {}
    for job in jobs:
        mine = job_logs(sources[job.job_id], job, head)
        for name, event in job.catalog.tables.items():
            rows = decode(mine, event).withColumn("job_id", F.lit(job.job_id))
            parts.setdefault(name, []).append(rows)
    return {name: reduce(DataFrame.unionByName, frames) for name, frames in parts.items()}
