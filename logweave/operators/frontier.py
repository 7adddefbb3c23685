"""How far a job is complete when its chunks arrive in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ISLAND_SPAN = 1_000_000


def _reach(partition: list[str]):
    """Highest end among the chunks before the current one."""
    return (
        Window.partitionBy(*partition)
        .orderBy("chunk_start", "chunk_end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def islands(chunks: DataFrame, span: int = _ISLAND_SPAN) -> DataFrame:
    """Merge touching chunks within block spans: job_id, chunk_start, chunk_end.

    A job's history shrinks to about one row a span before anything orders it as a whole,
    so no task sees all chunks of a job that holds most of them."""
    cut = chunks.withColumn("__span", F.floor(F.col("chunk_start") / span))
    flagged = cut.withColumn(
        "__new",
        F.coalesce(
            F.col("chunk_start") > F.max("chunk_end").over(_reach(["job_id", "__span"])) + 1, F.lit(True)
        ).cast("int"),
    )
    running = Window.partitionBy("job_id", "__span").orderBy("chunk_start", "chunk_end").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        flagged.withColumn("__island", F.sum("__new").over(running))
        .groupBy("job_id", "__span", "__island")
        .agg(F.min("chunk_start").alias("chunk_start"), F.max("chunk_end").alias("chunk_end"))
        .drop("__span", "__island")
    )


def contiguous_frontier(chunks: DataFrame, starts: DataFrame, span: int = _ISLAND_SPAN) -> DataFrame:
    """job_id, frontier: the last block of the gap-free prefix from each job's start.

    starts: job_id, start_block. A job whose first chunk is missing stands at start - 1.
    Chunks that lie before the start do not count."""
    own = chunks.join(starts, "job_id").where(F.col("chunk_end") >= F.col("start_block"))
    merged = islands(own.select("job_id", "chunk_start", "chunk_end"), span).join(starts, "job_id")
    reach = F.greatest(F.col("start_block") - 1, F.max("chunk_end").over(_reach(["job_id"])))
    gap = F.min(F.when(F.col("chunk_start") > F.col("__reach") + 1, F.col("chunk_start"))).over(
        Window.partitionBy("job_id")
    )
    before_gap = (
        merged.withColumn("__reach", F.coalesce(reach, F.col("start_block") - 1))
        .withColumn("__gap", gap)
        .where(F.col("__gap").isNull() | (F.col("chunk_start") < F.col("__gap")))
        .groupBy("job_id")
        .agg(F.max("chunk_end").alias("__end"))
    )
    return starts.join(before_gap, "job_id", "left").select(
        "job_id", F.coalesce("__end", F.col("start_block") - 1).alias("frontier")
    )
