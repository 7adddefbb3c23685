"""Event registry: registration, lookups, progress and catalogue listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.abi_types import EventDef
from ..schema import KEY_SUFFIX, REGISTRY


class DisjointEventsError(ValueError):
    """The events of one job do not share their first block."""


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def register(registry: DataFrame, catalog_frame: DataFrame) -> DataFrame:
    """Add events that are not registered yet, with progress (0, 0)."""
    new = catalog_frame.select(
        "chain_id",
        "event_hash",
        "event_signature",
        "event_name",
        F.lit(0).cast("long").alias("first_block"),
        F.lit(0).cast("long").alias("last_block"),
    ).dropDuplicates(["chain_id", "event_hash"])
    known = registry.select("chain_id", "event_hash")
    return registry.unionByName(new.join(known, ["chain_id", "event_hash"], "left_anti").select(*registry.columns))


def event_schema(event: EventDef, keys: bool = False) -> T.StructType:
    """Columns of the event table: fixed, indexed parameters, body parameters."""
    fields = [
        T.StructField("block_number", T.LongType()),
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("contract_address", T.StringType()),
    ]
    fields += [T.StructField(p.column, T.StringType()) for p in event.stored]
    if keys:
        fields += [
            T.StructField(p.column + KEY_SUFFIX, T.StringType())
            for p in event.stored
            if p.type.kind in ("uint", "int") and not p.stored_as_topic_hash
        ]
    return T.StructType(fields)


def normalise_hash(event_hash: str) -> str:
    return event_hash.lower() if event_hash.startswith("0x") else "0x" + event_hash.lower()


def _selected(chain_id: int, hashes: Sequence[str]) -> Column:
    return (F.col("chain_id") == chain_id) & F.col("event_hash").isin([normalise_hash(h) for h in hashes])


def lookup(registry: DataFrame, event_hash: str, chain_id: int | None = None) -> DataFrame:
    """Registry rows of an event hash, with or without 0x."""
    rows = registry.where(F.col("event_hash") == normalise_hash(event_hash))
    return rows if chain_id is None else rows.where(F.col("chain_id") == chain_id)


def event_signature(registry: DataFrame, event_hash: str) -> DataFrame:
    """The signature of an event hash on any chain."""
    return lookup(registry, event_hash).select("event_signature").distinct()


def set_first_block(registry: DataFrame, chain_id: int, hashes: Sequence[str], block: int) -> DataFrame:
    return registry.withColumn(
        "first_block", F.when(_selected(chain_id, hashes), F.lit(block).cast("long")).otherwise(F.col("first_block"))
    )


def synchronize(registry: DataFrame, chain_id: int, hashes: Sequence[str], block: int | None = None) -> DataFrame:
    """Move the events to `block`, or all to the furthest among them. Progress never goes back."""
    if not hashes:
        return registry
    if block is None:
        return sync_to_max(registry, chain_id, hashes)
    moved = F.greatest(F.col("last_block"), F.lit(block).cast("long"))
    return registry.withColumn("last_block", F.when(_selected(chain_id, hashes), moved).otherwise(F.col("last_block")))


def sync_to_max(registry: DataFrame, chain_id: int, hashes: Sequence[str]) -> DataFrame:
    """Align the progress of the events to the furthest among them."""
    chosen = _selected(chain_id, hashes)
    furthest = registry.where(chosen).groupBy("chain_id").agg(F.max("last_block").alias("__furthest"))
    moved = F.when(chosen, F.col("__furthest")).otherwise(F.col("last_block"))
    return (
        registry.join(furthest, "chain_id", "left")
        .withColumn("last_block", moved)
        .select(*registry.columns)
    )


def advance(registry: DataFrame, progress: DataFrame) -> DataFrame:
    """Apply (chain_id, event_hash, block) rows: last_block becomes the larger value."""
    step = progress.groupBy("chain_id", "event_hash").agg(F.max("block").alias("__block"))
    return (
        registry.join(step, ["chain_id", "event_hash"], "left")
        .withColumn("last_block", F.greatest("last_block", "__block"))
        .drop("__block")
        .select(*registry.columns)
    )


def max_block(routed: DataFrame) -> DataFrame:
    """Highest block of a batch per event."""
    return routed.groupBy("event_hash").agg(F.max("block_number").alias("last_event_block"))


def check_aligned(registry: DataFrame, chain_id: int, hashes: Sequence[str]) -> DataFrame:
    """One row: aligned or not, and the range of first blocks."""
    return registry.where(_selected(chain_id, hashes)).agg(
        (F.count_distinct("first_block") <= 1).alias("aligned"),
        F.min("first_block").alias("min_first_block"),
        F.max("first_block").alias("max_first_block"),
    )


def require_aligned(registry: DataFrame, chain_id: int, hashes: Sequence[str]) -> None:
    if not check_aligned(registry, chain_id, hashes).first().aligned:
        raise DisjointEventsError(
            f"the events of the job are disjoint on chain {chain_id}: index each of them in a job of its own"
        )


def resume_block(registry: DataFrame, chain_id: int, hashes: Sequence[str], start_block: int) -> DataFrame:
    """Where a job goes on: after its slowest event, or at its start if that has no progress."""
    return registry.where(_selected(chain_id, hashes)).agg(
        F.when(F.min("last_block") > 0, F.min("last_block") + 1)
        .otherwise(F.lit(start_block).cast("long"))
        .alias("resume_block")
    )


def indexing_lag(registry: DataFrame, heads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Head block, indexed block and their distance per (chain, contract).

    jobs: chain_id, contract_address, event_hash; heads: chain_id, head_block."""
    indexed = (
        jobs.join(registry, ["chain_id", "event_hash"])
        .groupBy("chain_id", "contract_address")
        .agg(F.min("last_block").alias("indexed_block"))
    )
    return indexed.join(heads, "chain_id").select(
        "chain_id",
        "contract_address",
        F.col("head_block").alias("chain_head_block"),
        "indexed_block",
        F.greatest(F.col("head_block") - F.col("indexed_block"), F.lit(0)).alias("lag"),
    )


def table_name_column() -> Column:
    """Event table name from registry columns."""
    return F.concat_ws(
        "_", F.lit("event"), "chain_id", F.lower("event_name"), F.substring(F.regexp_replace("event_hash", "^0x", ""), 1, 5)
    )


def table_counts(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """table_name, event_count of all tables, as one job with one row a table and task."""
    if not tables:
        return spark.createDataFrame([], "table_name string, event_count long")
    parts = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.count("*").alias("event_count"))


def list_events(registry: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Registry rows with the row count of each event table, 0 when empty."""
    counts = table_counts(tables, registry.sparkSession)
    return (
        registry.withColumn("table_name", table_name_column())
        .join(counts, "table_name", "left")
        .select(*registry.columns, F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"))
    )


def event_status(registry: DataFrame, tables: Mapping[str, DataFrame], chain_id: int, event: EventDef) -> DataFrame:
    """Hash, progress and count of one event; no row if it is not registered."""
    row = lookup(registry, event.hash, chain_id)
    table = tables.get(event.table_name(chain_id))
    if table is None:
        count = registry.sparkSession.createDataFrame([], "n long")
    else:
        count = table.agg(F.count("*").alias("n"))
    counted = count.select(F.lit(event.hash).alias("event_hash"), F.col("n").alias("event_count"))
    return status_columns(row.join(F.broadcast(counted), "event_hash", "left"))


def status_columns(listed: DataFrame) -> DataFrame:
    """Hash, progress and count of listed events; the count is 0 as long as there is no progress."""
    count = F.when(F.col("last_block") != 0, F.coalesce("event_count", F.lit(0))).otherwise(F.lit(0))
    return listed.select(F.col("event_hash").alias("hash"), "first_block", "last_block", count.cast("long").alias("event_count"))


def with_summary(registry: DataFrame, summary: DataFrame, progress: bool) -> DataFrame:
    """Registry rows with the event_count of a batch's summary; with `progress` last_block moves, too.

    summary: event_hash, last_event_block, event_count of the registry's one chain."""
    moved = F.greatest("last_block", "last_event_block") if progress else F.col("last_block")
    return registry.join(summary, "event_hash", "left").select(
        *[moved.alias(c) if c == "last_block" else c for c in registry.columns],
        F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
    )


def unnamed_contract() -> Column:
    """contract_name: nothing names contracts, so it is NULL."""
    return F.lit(None).cast("string").alias("contract_name")


def list_contracts(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Distinct contract addresses over all event tables."""
    if not tables:
        return spark.createDataFrame([], "contract_address string, contract_name string")
    parts = [df.select("contract_address") for df in tables.values()]
    return (
        reduce(DataFrame.unionByName, parts)
        .distinct()
        .select("contract_address", unnamed_contract())
    )


def describe_tables(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """table_name, column_name, column_type, position of every table; the key columns are hidden."""
    rows = []
    for name in sorted(tables):
        fields = [f for f in tables[name].schema.fields if not f.name.endswith(KEY_SUFFIX)]
        rows += [(name, f.name, f.dataType.simpleString(), i) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, position int")


def schema_json(description: DataFrame) -> DataFrame:
    """One row per table: name and a column -> type map as JSON."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "column_name", "column_type"))),
        lambda c: F.struct(c["column_name"].alias("key"), c["column_type"].alias("value")),
    )
    return description.groupBy("table_name").agg(F.to_json(F.map_from_entries(ordered)).alias("columns"))


def event_tables(description: DataFrame) -> DataFrame:
    """Sorted names of event tables."""
    name = F.col("table_name")
    return (
        description.where(name.startswith("event_") & (name != "event_descriptor"))
        .select("table_name")
        .distinct()
        .orderBy("table_name")
    )


def progress_label(listing: DataFrame) -> DataFrame:
    """One status line per listed event."""
    first, last, count = F.col("first_block"), F.col("last_block"), F.col("event_count")
    blocks = F.concat(F.format_number(first, 0), F.lit(" → "), F.format_number(last, 0))
    return listing.withColumn(
        "label",
        F.when((last > 0) & (count > 0), F.concat(blocks, F.lit(", "), F.format_number(count, 0), F.lit(" events")))
        .when(last > 0, blocks)
        .when(first > 0, F.concat(F.lit("Starting from "), F.format_number(first, 0)))
        .otherwise(F.lit("No block data yet")),
    )


def to_api_listing(listing: DataFrame) -> DataFrame:
    """Registry listing under its outward camelCase names."""
    return listing.withColumnsRenamed(
        {
            "chain_id": "chainId",
            "event_hash": "eventHash",
            "event_signature": "eventSignature",
            "event_name": "eventName",
            "first_block": "firstBlock",
            "last_block": "lastBlock",
            "event_count": "eventCount",
        }
    )
