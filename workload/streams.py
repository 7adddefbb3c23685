"""Registered streaming queries: the token logs as files, indexed into a store."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.frontier import contiguous_frontier
from logweave.operators.registry import resume_block
from logweave.operators.routing import decode
from logweave.plans.jobs import Job
from logweave.sources import logs as L
from logweave.sources.manifest import Record
from logweave.sources.store import EventStore, export, scratch_dir
from logweave.streaming.index import backfill, index_stream, next_block
from logweave.streaming.lag import LagListener
from logweave.streaming.release import index_in_order

from . import adapters as Z
from .registry import E_CTE, T_CTE, query

BUCKET = 1_000
JOB = Job("tokens", Z.TOKEN_CATALOG, start_block=1)
TRANSFER_TABLE = Z.TOKEN_CATALOG.table("Transfer")


def write_dump(logs: DataFrame, path: str) -> None:
    """Logs as JSON lines in files of ascending block ranges, as many as the session shuffles to."""
    L.to_json_records(logs.repartitionByRange("block_number")).write.mode("append").json(path)


@query("stream_index", f"WITH {T_CTE} SELECT * FROM t")
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "stream-index")
    write_dump(Z.token_logs(spark, sf), f"{root}/in")
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    backfill(L.stream_logs(spark, f"{root}/in", max_files=4), JOB, store, f"{root}/checkpoint")
    return store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]


@query(
    "stream_resume",
    f"""WITH {E_CTE} SELECT '{TRANSFER_TABLE}' AS table_name, count(*) FILTER (event_type = 'purchase') AS event_count, max(bn) + 1 AS next_block,
      count(DISTINCT bn) AS blocks FROM e
    UNION ALL SELECT '{Z.TOKEN_CATALOG.table("Mint")}', count(*) FILTER (event_type = 'signup'), max(bn) + 1, count(DISTINCT bn) FROM e""",
)
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Index the lower half, stop, add the rest plus a replay of the lower half, go on."""
    root = scratch_dir(spark, "stream-resume")
    logs = Z.token_logs(spark, sf)
    middle = logs.agg(F.floor(F.max("block_number") / 2).alias("m")).first().m
    store = EventStore(spark, f"{root}/store", BUCKET)
    # The contract's whole stream is read, so blocks and progress cover every log.
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)

    def run() -> None:
        backfill(L.stream_logs(spark, f"{root}/in"), job, store, f"{root}/checkpoint")

    low = logs.where(F.col("block_number") <= middle)
    write_dump(low, f"{root}/in")
    run()
    write_dump(low, f"{root}/in")
    write_dump(logs.where(F.col("block_number") > middle), f"{root}/in")
    run()
    run()
    data = store.data(Z.TOKEN_CATALOG)
    blocks = data.blocks.count()
    parts = [
        data.tables[Z.TOKEN_CATALOG.table(n)]
        .agg(F.count("*").alias("event_count"))
        .select(
            F.lit(Z.TOKEN_CATALOG.table(n)).alias("table_name"),
            "event_count",
            F.lit(next_block(store, job)).cast("long").alias("next_block"),
            F.lit(blocks).cast("long").alias("blocks"),
        )
        for n in ("Transfer", "Mint")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_out_of_order",
    f"""WITH {E_CTE}, h AS (SELECT max(bn) AS h FROM e), c AS (SELECT (h - 1) // 4 + 1 AS size FROM h)
    SELECT step, max(frontier) AS frontier, count(*) FILTER (bn <= frontier AND event_type = 'purchase') AS visible FROM (
      SELECT 1 AS step, 0 AS frontier UNION ALL SELECT 2, (SELECT 2 * size FROM c) UNION ALL SELECT 3, (SELECT 2 * size FROM c) UNION ALL SELECT 4, (SELECT 4 * size FROM c)), e
    GROUP BY step""",
)
def stream_out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """Four chunks announced as 2, 1, 4, 3, one run each: nothing, 1+2, nothing, 3+4."""
    root = scratch_dir(spark, "stream-order")
    logs = Z.token_logs(spark, sf)
    L.stage_logs(logs, f"{root}/staged", BUCKET)
    staged = spark.read.parquet(f"{root}/staged")
    size = staged.agg(F.floor((F.max("block_number") - 1) / 4).alias("s")).first().s + 1
    store = EventStore(spark, f"{root}/store", BUCKET)
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    seen = []
    for step, chunk in enumerate((2, 1, 4, 3), start=1):
        announced = spark.createDataFrame(
            [("tokens", (chunk - 1) * size + 1, chunk * size)], "job_id string, chunk_start long, chunk_end long"
        )
        announced.write.mode("append").parquet(f"{root}/chunks")
        arrivals = spark.readStream.schema(announced.schema).parquet(f"{root}/chunks")
        index_in_order(arrivals, {"tokens": f"{root}/staged"}, [job], store, f"{root}/checkpoint", BUCKET).awaitTermination()
        visible = store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE].count()
        seen.append((step, next_block(store, job) - 1, visible))
    return spark.createDataFrame(seen, "step int, frontier long, visible long")


@query("stream_moving_head", f"WITH {T_CTE} SELECT * FROM t")
def stream_moving_head(spark: SparkSession, sf: str) -> DataFrame:
    """The head stands at half of the blocks, then, on the same checkpoint, at the last."""
    root = scratch_dir(spark, "stream-head")
    logs = Z.token_logs(spark, sf)
    top = logs.agg(F.max("block_number").alias("m")).first().m
    write_dump(logs, f"{root}/in")
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    for head in (top // 2, top):
        backfill(L.stream_logs(spark, f"{root}/in"), JOB, store, f"{root}/checkpoint", head=head)
    return store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]


@query("stream_late_staging", f"WITH {T_CTE} SELECT * FROM t")
def stream_late_staging(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks overlap, and the upper half of the logs is staged after the stream ran for the first time."""
    root = scratch_dir(spark, "stream-late")
    logs = Z.token_logs(spark, sf)
    top = logs.agg(F.max("block_number").alias("m")).first().m
    middle = top // 2
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    halves = (
        (logs.where(F.col("block_number") <= middle), [(1, middle - 1), (middle // 2, middle)]),
        (logs.where(F.col("block_number") > middle), [(middle, top - 1), (middle + 1, top)]),
    )
    for rows, chunks in halves:
        L.stage_logs(rows, f"{root}/staged", BUCKET)
        announced = spark.createDataFrame([("tokens", a, b) for a, b in chunks], "job_id string, chunk_start long, chunk_end long")
        announced.write.mode("append").parquet(f"{root}/chunks")
        arrivals = spark.readStream.schema(announced.schema).parquet(f"{root}/chunks")
        index_in_order(arrivals, {"tokens": f"{root}/staged"}, [job], store, f"{root}/checkpoint", BUCKET).awaitTermination()
    return store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]


@query(
    "stream_overlapping_chunks",
    f"""WITH {E_CTE} SELECT 'tokens' AS job_id, max(bn) + 50 AS frontier, max(bn) + 51 AS next_block, count(*) FILTER (event_type = 'purchase') AS visible FROM e""",
)
def stream_overlapping_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks overlap, and the last ones hold no log; stream and batch frontier are the same."""
    root = scratch_dir(spark, "stream-overlap")
    logs = Z.token_logs(spark, sf)
    L.stage_logs(logs, f"{root}/staged", BUCKET)
    top = logs.agg(F.max("block_number").alias("m")).first().m
    third = top // 3
    spans = [(1, third), (third - 5, 2 * third), (2 * third + 1, top), (top - 3, top + 20), (top + 21, top + 50), (top + 60, top + 70)]
    chunks = spark.createDataFrame([("tokens", a, b) for a, b in spans], "job_id string, chunk_start long, chunk_end long")
    chunks.write.parquet(f"{root}/chunks")
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    arrivals = spark.readStream.schema(chunks.schema).parquet(f"{root}/chunks")
    index_in_order(arrivals, {"tokens": f"{root}/staged"}, [job], store, f"{root}/checkpoint", BUCKET).awaitTermination()
    starts = chunks.select("job_id").distinct().withColumn("start_block", F.lit(1).cast("long"))
    resumed = resume_block(store.job_registry(job), Z.CHAIN, Z.TOKEN_CATALOG.hashes, 1).withColumnRenamed("resume_block", "next_block")
    visible = store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE].agg(F.count("*").alias("visible"))
    return contiguous_frontier(chunks, starts).crossJoin(resumed).crossJoin(visible)


@query("export_round_trip", f"WITH {T_CTE} SELECT 'parquet' AS format, * FROM t UNION ALL SELECT 'csv', * FROM t")
def export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table as exported in either format, read again."""
    root = scratch_dir(spark, "export")
    rows = decode(Z.token_logs(spark, sf), Z.TRANSFER)
    for fmt in ("parquet", "csv"):
        export(rows, f"{root}/{fmt}", fmt)
    text = spark.read.schema(rows.schema).option("header", True).csv(f"{root}/csv")
    parts = {"parquet": spark.read.parquet(f"{root}/parquet"), "csv": text}
    one, two = (df.select(F.lit(fmt).alias("format"), *rows.columns) for fmt, df in parts.items())
    return one.unionByName(two)


class _Crash(EventStore):
    """A store whose commits end before the marker."""

    def _commit(self, job: Job, batch_id: int, reached: int | None, record: Record) -> None:
        raise RuntimeError("the driver is lost")


@query(
    "store_two_jobs",
    f"""WITH {E_CTE} SELECT 'one crashed' AS state, count(*) FILTER (event_type = 'purchase') AS transfers, count(DISTINCT bn) AS blocks FROM e
    UNION ALL SELECT 'both committed', count(*) FILTER (event_type = 'purchase'), count(DISTINCT bn) FROM e""",
)
def store_two_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Of two jobs with the same logs one is lost before its marker; it runs again later."""
    root = scratch_dir(spark, "store-jobs")
    logs = Z.token_logs(spark, sf)
    one, two = (Job(name, Z.TOKEN_CATALOG, start_block=1, from_abi=True) for name in ("one", "two"))
    store, lost = EventStore(spark, root, BUCKET), _Crash(spark, root, BUCKET)

    def seen(state: str) -> DataFrame:
        data = store.data(Z.TOKEN_CATALOG)
        transfers = data.tables[TRANSFER_TABLE].agg(F.count("*").alias("transfers"))
        blocks = data.blocks.agg(F.count("*").alias("blocks"))
        return transfers.crossJoin(blocks).select(F.lit(state).alias("state"), "transfers", "blocks")

    try:
        lost.commit_batch(logs, two, 0)
    except RuntimeError:
        pass
    store.commit_batch(logs, one, 0)
    first = seen("one crashed")
    first.write.parquet(f"{root}/first")
    store.commit_batch(logs, two, 0)
    return spark.read.parquet(f"{root}/first").unionByName(seen("both committed"))


@query(
    "store_sparse_commits",
    f"WITH {T_CTE} SELECT count(*) AS transfers FROM t",
)
def store_sparse_commits(spark: SparkSession, sf: str) -> DataFrame:
    """A job is in batches 1, 3 and 5; the marker of 5 is lost, so 3 stays the last one."""
    root = scratch_dir(spark, "store-sparse")
    logs = Z.token_logs(spark, sf)
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    store, lost = EventStore(spark, root, BUCKET), _Crash(spark, root, BUCKET)
    middle = logs.agg(F.floor(F.max("block_number") / 2).alias("m")).first().m
    store.commit_batch(logs.where(F.col("block_number") <= middle), job, 1)
    store.commit_batch(logs.where(F.col("block_number") > middle), job, 3)
    try:
        lost.commit_batch(logs, job, 5)
    except RuntimeError:
        pass
    return store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE].agg(F.count("*").alias("transfers"))


@query("store_compacted", f"WITH {T_CTE} SELECT * FROM t")
def store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Eight commits, compaction, two more commits and compaction again, then a vacuum: the rows that a
    reader began with before, and those that one finds after, are the same but for the later commits."""
    root = scratch_dir(spark, "store-compacted")
    L.stage_logs(Z.token_logs(spark, sf), f"{root}/staged", BUCKET)
    logs = spark.read.parquet(f"{root}/staged")
    job = Job("tokens", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    part = F.pmod("block_number", F.lit(10))
    for batch in range(8):
        store.commit_batch(logs.where(part == batch), job, batch)
    before = store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]
    store.compact(Z.TOKEN_CATALOG)
    for batch in (8, 9):
        store.commit_batch(logs.where((part == batch) | (part == 0)), job, batch)
    store.compact(Z.TOKEN_CATALOG)
    old = before.where(part < 8)
    old.write.parquet(f"{root}/old")
    store.vacuum(keep=1)
    now = store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]
    return spark.read.parquet(f"{root}/old").unionByName(now.where(part >= 8)).intersectAll(now)


@query(
    "store_disjoint_jobs",
    f"""WITH {E_CTE}, m AS (SELECT max(bn) // 2 AS middle, max(bn) // 4 AS quarter FROM e)
    SELECT 'transfers' AS what, count(*) FILTER (event_type = 'purchase') AS n FROM e
    UNION ALL SELECT 'blocks', count(DISTINCT bn) FROM e
    UNION ALL SELECT 'twice', count(*) FILTER (event_type = 'purchase' AND bn BETWEEN quarter AND middle) FROM e, m""",
)
def store_disjoint_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs meet at the middle, a third has a quarter of the blocks again: only that is made unique."""
    root = scratch_dir(spark, "store-disjoint")
    L.stage_logs(Z.token_logs(spark, sf), f"{root}/staged", BUCKET)
    logs = spark.read.parquet(f"{root}/staged")
    top = logs.agg(F.max("block_number").alias("m")).first().m
    middle, quarter = top // 2, top // 4
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    again = Job("again", Z.TOKEN_CATALOG, start_block=1, from_abi=True)
    spans = {"low": (1, middle), "high": (middle + 1, top), "again": (quarter, middle)}
    for name, (lo, hi) in spans.items():
        store.commit_batch(L.block_range(logs, lo, hi, BUCKET), Job(name, Z.TOKEN_CATALOG, start_block=1, from_abi=True), 0)
    data = store.data(Z.TOKEN_CATALOG)
    mine = [e.path for e in store.manifest.snapshot().own(again.job_id, TRANSFER_TABLE)]
    parts = {
        "transfers": data.tables[TRANSFER_TABLE],
        "blocks": data.blocks,
        "twice": spark.read.parquet(*[f"{root}/store/{p}" for p in mine]),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, rows in parts.items()])


@query(
    "stream_empty_ranges",
    f"""WITH {E_CTE}, h AS (SELECT max(bn) AS h, max(bn) // 40 + 1 AS size FROM e)
    SELECT step, last_block, transfers FROM (
      SELECT 1 AS step, 0 AS last_block UNION ALL SELECT 2, 21 * (SELECT size FROM h) UNION ALL SELECT 3, 50 * (SELECT size FROM h)) s,
      (SELECT count(*) FILTER (event_type = 'purchase' AND bn > (SELECT 20 * size FROM h)) AS high, count(*) FILTER (event_type = 'purchase') AS whole,
        count(*) FILTER (event_type = 'purchase' AND (bn <= (SELECT 21 * size FROM h) OR bn > (SELECT 30 * size FROM h))) AS both_ends FROM e) c,
      LATERAL (SELECT CASE step WHEN 1 THEN (SELECT count(*) FROM e WHERE event_type = 'purchase' AND bn > (SELECT 30 * size FROM h)) WHEN 2 THEN both_ends ELSE whole END AS transfers)""",
)
def stream_empty_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk files beyond the last log, then the lower half, then what was left out: progress is the
    covered range, that of `contiguous_frontier`, with ranges that hold no log."""
    root = scratch_dir(spark, "stream-ranges")
    L.stage_logs(Z.token_logs(spark, sf), f"{root}/staged", BUCKET)
    logs = spark.read.parquet(f"{root}/staged")
    size = logs.agg(F.max("block_number").alias("m")).first().m // 40 + 1
    plan = L.chunk_plan(spark, 1, 50 * size, size)
    number = F.floor((F.col("chunk_start") - 1) / size)
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    starts = spark.createDataFrame([("tokens", 1)], "job_id string, start_block long")
    steps = []
    for step, chosen in enumerate((number >= 30, number <= 20, (number > 20) & (number < 30)), 1):
        L.write_chunks(logs, plan.where(chosen), f"{root}/in", 1, size)
        backfill(L.stream_chunks(spark, f"{root}/in", max_files=5), JOB, store, f"{root}/checkpoint")
        last = next_block(store, JOB) - 1
        assert contiguous_frontier(store.coverage("tokens"), starts).first().frontier == last
        transfers = store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE].count()
        steps.append((step, last, transfers))
    return spark.createDataFrame(steps, "step int, last_block long, transfers long")


@query("stream_follow_head", f"WITH {T_CTE} SELECT 'held' AS state, count(*) FILTER (block_number <= (SELECT max(bn) // 2 FROM e)) AS transfers FROM t UNION ALL SELECT 'released', count(*) FROM t")
def stream_follow_head(spark: SparkSession, sf: str) -> DataFrame:
    """A stream in follow mode whose head moves from the middle to the top while no file comes."""
    root = scratch_dir(spark, "stream-follow")
    logs = Z.token_logs(spark, sf)
    top = logs.agg(F.max("block_number").alias("m")).first().m
    write_dump(logs, f"{root}/in")
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    head = {"at": top // 2}
    seen = lambda: store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE].count()
    running = index_stream(L.stream_logs(spark, f"{root}/in"), JOB, store, f"{root}/checkpoint", follow="1 second", head=lambda: head["at"])
    counts = []
    try:
        for state, stand in (("held", top // 2), ("released", top)):
            head["at"] = stand
            end = time.monotonic() + 120
            while next_block(store, JOB) <= stand and time.monotonic() < end:
                time.sleep(0.2)
            counts.append((state, seen()))
    finally:
        running.stop()
    return spark.createDataFrame(counts, "state string, transfers long")


@query(
    "stream_lag",
    f"""WITH {E_CTE} SELECT 'tokens' AS job_id, sum(CASE WHEN event_type IN ('purchase', 'click', 'signup', 'view') THEN 1 ELSE 0 END + CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS logs,
      (SELECT max(bn) FROM e) + 12 AS chain_head_block, max(bn) AS indexed_block, (SELECT max(bn) FROM e) + 12 - max(bn) AS lag FROM e WHERE event_type IN ('purchase', 'click', 'signup', 'view')""",
)
def stream_lag(spark: SparkSession, sf: str) -> DataFrame:
    """What a listener noted of a stream of several batches, written and read again: all logs, and the
    distance from the head after the last batch."""
    root = scratch_dir(spark, "stream-lag")
    L.stage_logs(Z.token_logs(spark, sf), f"{root}/staged", BUCKET)
    logs = spark.read.parquet(f"{root}/staged")
    top = logs.agg(F.max("block_number").alias("m")).first().m
    write_dump(logs, f"{root}/in")
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    listener = LagListener(store, {"tokens": JOB}, {Z.CHAIN: lambda: top + 12})
    spark.streams.addListener(listener)
    try:
        running = index_stream(L.stream_logs(spark, f"{root}/in", max_files=4), JOB, store, f"{root}/checkpoint")
        running.awaitTermination()
        batches = store.last_commits()["tokens"] + 1
        listener.wait(batches)
        listener.write(spark, f"{root}/lag")
    finally:
        spark.streams.removeListener(listener)
    notes = spark.read.parquet(f"{root}/lag")
    last = notes.agg(*[F.max_by(c, "batch_id").alias(c) for c in ("chain_head_block", "indexed_block", "lag")])
    return notes.groupBy("job_id").agg(F.sum("logs").alias("logs")).crossJoin(last)


@query("stream_replay_after_release", f"WITH {T_CTE} SELECT * FROM t")
def stream_replay_after_release(spark: SparkSession, sf: str) -> DataFrame:
    """A batch held logs back; with the head moved, the same batch runs again before and after another
    one released them, as it does if the driver was lost before the stream's own checkpoint."""
    root = scratch_dir(spark, "stream-replay")
    L.stage_logs(Z.token_logs(spark, sf), f"{root}/staged", BUCKET)
    logs = L.read_logs(spark, f"{root}/staged", "parquet")
    top = logs.agg(F.max("block_number").alias("m")).first().m
    store = EventStore(spark, f"{root}/store", BUCKET, keys=False)
    low, high = logs.where(F.col("block_number") % 2 == 0), logs.where(F.col("block_number") % 2 == 1)
    store.commit_batch(low, JOB, 0, head=top // 3)
    store.commit_batch(high, JOB, 1, head=top // 2)
    store.commit_batch(high, JOB, 1, head=top // 2 + 5)
    store.commit_batch(high, JOB, 1, head=top)
    store.commit_batch(high, JOB, 1, head=top // 2)
    store.commit_batch(logs.limit(0), JOB, 2, head=top)
    store.commit_batch(logs.limit(0), JOB, 2, head=top)
    return store.data(Z.TOKEN_CATALOG).tables[TRANSFER_TABLE]


@query("decode_mixed_case_parquet", f"WITH {T_CTE} SELECT * FROM t")
def decode_mixed_case_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """Logs that another program wrote as Parquet, with hex in upper case."""
    root = scratch_dir(spark, "mixed-case")
    logs = Z.token_logs(spark, sf)
    shout = lambda c: F.concat(F.lit("0x"), F.upper(F.substring(c, 3, 2**31 - 1)))
    logs.withColumns({"address": shout(F.col("address")), "data": shout(F.col("data")), "topics": F.transform("topics", shout)}).write.parquet(root)
    return decode(L.read_logs(spark, root, "parquet"), Z.TRANSFER)


@query(
    "bad_quantities",
    f"WITH {E_CTE} SELECT count(*) FILTER (event_type = 'purchase' AND li <> 0) AS transfers FROM e",
)
def bad_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose log index does not fit are malformed; zero-padded ones are as good as any."""
    root = scratch_dir(spark, "quantities")
    records = L.to_json_records(Z.token_logs(spark, sf))
    odd = F.when(F.col("logIndex") == "0x0", "0xffffffff").otherwise(F.concat(F.lit("0x00000000000000000000"), F.substring("logIndex", 3, 16)))
    records.withColumn("logIndex", odd).write.json(root)
    rows = decode(L.read_logs(spark, root), Z.TRANSFER)
    return rows.where(F.col("log_index").isNotNull()).agg(F.count("*").alias("transfers"))
