"""Raw log sources: scans, block ranges, the finality cut and chunk plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import quantity
from ..schema import CHUNK_JSON, RAW_LOG, RAW_LOG_JSON

DEFAULT_BLOCK_RANGE = 100
DEFAULT_BUCKET_BLOCKS = 100_000


def normalise_logs(records: DataFrame, *more: Column) -> DataFrame:
    """Records in JSON-RPC form -> RAW_LOG: 0x quantities become numbers, hex is lower-case."""
    return records.select(
        F.lower("address").alias("address"),
        F.transform("topics", F.lower).alias("topics"),
        F.lower("data").alias("data"),
        quantity(F.col("blockNumber")).alias("block_number"),
        F.lower("blockHash").alias("block_hash"),
        quantity(F.col("blockTimestamp")).alias("block_timestamp"),
        F.lower("transactionHash").alias("transaction_hash"),
        quantity(F.col("transactionIndex")).try_cast("int").alias("transaction_index"),
        quantity(F.col("logIndex")).try_cast("int").alias("log_index"),
        F.coalesce("removed", F.lit(False)).alias("removed"),
        *more,
    )


def read_logs(spark: SparkSession, path: str, fmt: str = "json", multiline: bool = False) -> DataFrame:
    """Raw logs from JSON lines (or JSON arrays with `multiline`), or from staged Parquet."""
    if fmt == "json":
        reader = spark.read.schema(RAW_LOG_JSON).option("multiLine", multiline)
        return normalise_logs(reader.json(path))
    return lower_hex(spark.read.format(fmt).load(path))


def lower_hex(logs: DataFrame) -> DataFrame:
    """RAW_LOG with its hex in lower case. Staged logs, which have a topic0 column, were written so,
    and are left alone to keep filters on them within reach of the files."""
    if "topic0" in logs.columns:
        return logs
    lowered = {c: F.lower(c) for c in ("address", "data", "block_hash", "transaction_hash")}
    return logs.withColumns(lowered | {"topics": F.transform("topics", F.lower)})


def stream_logs(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = 1000) -> DataFrame:
    """The same as a stream over a growing directory, in batches of so many files."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        return normalise_logs(reader.schema(RAW_LOG_JSON).json(path))
    return lower_hex(reader.schema(RAW_LOG).format(fmt).load(path))


def stream_chunks(spark: SparkSession, path: str, max_files: int | None = 1000) -> DataFrame:
    """A stream over a growing directory of chunk files (`write_chunks`): logs, and marks of the block
    ranges that a file has in full, with `chunk_start` and `chunk_end` and no log."""
    reader = spark.readStream.schema(CHUNK_JSON)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = reader.json(path)
    return normalise_logs(records, quantity(F.col("chunkStart")).alias("chunk_start"), quantity(F.col("chunkEnd")).alias("chunk_end"))


def write_chunks(logs: DataFrame, plan: DataFrame, path: str, start: int, size: int) -> None:
    """Write the logs of planned chunks as JSON lines. All logs of a chunk and its mark stand in one
    file, which a stream takes as a whole; a chunk without logs is its mark alone."""
    chunk = (F.lit(start) + F.floor((F.col("block_number") - start) / size) * size).cast("long")
    rows = to_json_records(logs.where(F.col("block_number") >= start)).withColumn("block", quantity(F.col("blockNumber")))
    rows = rows.withColumn("block_number", F.col("block")).withColumn("chunk_start", chunk).join(plan, "chunk_start").drop("block", "block_number")
    marks = plan.select("chunk_start", "chunk_end", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_LOG_JSON.fields])
    hexed = lambda c: F.when(F.col("blockNumber").isNull(), F.concat(F.lit("0x"), F.lower(F.hex(c))))
    both = rows.select(*marks.columns).unionByName(marks).withColumns({"chunkStart": hexed("chunk_start"), "chunkEnd": hexed("chunk_end")})
    both.repartition("chunk_start").select(*CHUNK_JSON.names).write.mode("append").json(path)


def to_json_records(logs: DataFrame) -> DataFrame:
    """RAW_LOG -> records in JSON-RPC form, for writing log dumps."""

    def hex_quantity(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit("0x"), F.lower(F.hex(F.col(name).cast("long")))))

    return logs.select(
        "address",
        "topics",
        "data",
        hex_quantity("block_number").alias("blockNumber"),
        F.col("block_hash").alias("blockHash"),
        hex_quantity("block_timestamp").alias("blockTimestamp"),
        F.col("transaction_hash").alias("transactionHash"),
        hex_quantity("transaction_index").alias("transactionIndex"),
        hex_quantity("log_index").alias("logIndex"),
        "removed",
    )


def block_bucket(block: Column, size: int = DEFAULT_BUCKET_BLOCKS) -> Column:
    return F.floor(block / F.lit(size)).cast("long")


def topic0(logs: DataFrame) -> Column:
    """The event hash: its own column in staged logs, else the first topic."""
    return F.col("topic0") if "topic0" in logs.columns else F.get("topics", F.lit(0))


def stage_logs(logs: DataFrame, path: str, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS, partitions: int | None = None) -> None:
    """Write RAW_LOG as Parquet laid out for range scans and per-event reads.

    Range partitioning on the full log key splits even a block that holds a large share of
    the rows. Sorting each file by event and contract lets row-group statistics skip what
    a job does not ask for."""
    keys = ["block_number", "transaction_hash", "log_index"]
    logs = lower_hex(logs)
    spread = logs.repartitionByRange(partitions, *keys) if partitions else logs.repartitionByRange(*keys)
    (
        spread.withColumn("topic0", F.get("topics", F.lit(0)))
        .withColumn("block_bucket", block_bucket(F.col("block_number"), bucket_blocks))
        .sortWithinPartitions("block_bucket", "topic0", "address", "block_number")
        .write.mode("append")
        .partitionBy("block_bucket")
        .parquet(path)
    )


def hold_logs(logs: DataFrame, path: str) -> DataFrame:
    """Logs written once as they come, without a shuffle, and read again: for a batch that is costly to
    produce and that several plans read. Readers skip columns, and files by event where they can."""
    held = lower_hex(logs).withColumn("topic0", F.get("topics", F.lit(0)))
    held.write.parquet(path)
    return logs.sparkSession.read.schema(held.schema).parquet(path)


def block_range(logs: DataFrame, lo: int, hi: int, bucket_blocks: int | None = None) -> DataFrame:
    """Logs of blocks lo..hi, both included.

    Give the bucket size that staged logs were written with to prune their partitions too."""
    out = logs.where(F.col("block_number").between(lo, hi))
    if bucket_blocks and "block_bucket" in logs.columns:
        out = out.where(F.col("block_bucket").between(lo // bucket_blocks, hi // bucket_blocks))
    return out


def until_head(logs: DataFrame, head: int | DataFrame) -> DataFrame:
    """Logs up to the finalised head: a number, or a one-row frame with column `head`."""
    if isinstance(head, DataFrame):
        return logs.where(F.col("block_number") <= head.agg(F.max("head")).scalar())
    return logs.where(F.col("block_number") <= head)


def chunk_plan(spark: SparkSession, start: int, head: int, size: int = DEFAULT_BLOCK_RANGE) -> DataFrame:
    """chunk_start, chunk_end covering start..head; the last chunk may be short."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    return spark.range(start, head + 1, size).select(
        F.col("id").alias("chunk_start"),
        F.least(F.col("id") + F.lit(size - 1), F.lit(head)).alias("chunk_end"),
    )


def chunk_counts(logs: DataFrame, plan: DataFrame, start: int, size: int = DEFAULT_BLOCK_RANGE) -> DataFrame:
    """Logs per planned chunk, empty chunks kept with count 0."""
    chunk = (F.lit(start) + F.floor((F.col("block_number") - start) / size) * size).cast("long")
    counts = (
        logs.where(F.col("block_number") >= start)
        .groupBy(chunk.alias("chunk_start"))
        .agg(F.count("*").alias("n"))
    )
    return plan.join(counts, "chunk_start", "left").select(
        "chunk_start", "chunk_end", F.coalesce("n", F.lit(0)).cast("long").alias("log_count")
    )
