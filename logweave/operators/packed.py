"""Logs of many events decoded in one pass, each to a packed row, and event tables unpacked from these.

`decode` has one plan for each event; here the plan has one branch for each type that occurs, and what is
done with a log is data: a program, which says for each parameter its type and where it stands. The
program of a log's event comes by a join with the catalogue. So logs are read once for all tables, the
plan does not grow with the number of events, and a catalogue may be a frame that is never collected.

A packed row has the values of the parameters as text, in the order of the event table's columns, and, if
asked for, the order keys of its integers. Values that are NULL mark a log that does not fit: it is left
out, as `decode` does. Packed rows are written once, partitioned by event table, and unpacked when read.
A staged batch has, in the same files, what blocks and progress need of every log, also of those without a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from ..functions.abi_types import AbiType, EventDef, parse_type
from ..functions.decode import value_at, word_text
from ..functions.words import let
from ..plans.lazy import LazyTables
from ..schema import KEY_SUFFIX
from ..session import session_options
from ..sources.catalog import MAX_BROADCAST_EVENTS, Catalog
from ..sources.logs import lower_hex, topic0
from .routing import is_well_formed, well_formed

#: Distinct parameter types of a catalogue, each a branch of the plan.
MAX_TYPES = 500

_STEP = "struct<type:string,topic:int,at:int>"
PROGRAMS = f"event_hash string, event_name string, table_name string, n_topics int, head_bytes int, program array<{_STEP}>"
PACKED = T.StructType(
    [
        T.StructField("event_hash", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("contract_address", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("table_name", T.StringType()),
    ]
)
#: Logs as `stage_packed` writes them: packed rows with the block of their log, and logs without a row, which
#: have no table_name. Those of events that the catalogue does not have are without event_hash, too.
STAGED = T.StructType([*PACKED.fields[:-1], T.StructField("block_hash", T.StringType()), T.StructField("block_timestamp", T.LongType()), PACKED["table_name"]])

#: Event tables that a task writes at once, each with a row group of so many bytes, so that it need not sort its logs.
WRITERS, ROW_GROUP = 32, 16 << 20


def program_of(event: EventDef) -> list[tuple[str, int | None, int | None]]:
    """For each stored parameter: its type, and its topic or the place of its head in the body.
    Parameters that a topic holds the hash of count as bytes32."""
    steps: list[tuple[str, int | None, int | None]] = []
    for i, p in enumerate(event.indexed, start=1):
        steps.append(("bytes32" if p.stored_as_topic_hash else p.type.canonical, i, None))
    at = 0
    for p in event.body:
        steps.append((p.type.canonical, None, at))
        at += p.type.head_bytes
    return steps


def programs(catalog: DataFrame) -> DataFrame:
    """A catalogue frame with the program of each event. Signatures are parsed in Arrow batches, one for
    each event, never for a log."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            events = [EventDef.parse(s) for s in batch["event_signature"]]
            steps = [[dict(zip(("type", "topic", "at"), s)) for s in program_of(e)] for e in events]
            yield pd.DataFrame(
                {
                    "event_hash": batch["event_hash"],
                    "event_name": batch["event_name"],
                    "table_name": batch["table_name"],
                    "n_topics": [e.n_topics for e in events],
                    "head_bytes": [e.body_head_bytes for e in events],
                    "program": steps,
                }
            )

    return catalog.select("event_signature", "event_hash", "event_name", "table_name").mapInPandas(parse, PROGRAMS)


def _catalog_programs(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(e.hash, e.name, e.table_name(catalog.chain_id), e.n_topics, e.body_head_bytes, program_of(e)) for e in catalog.events]
    return spark.createDataFrame(rows, PROGRAMS)


def _types(catalog: DataFrame | Catalog, steps: DataFrame) -> tuple[list[AbiType], int]:
    """The distinct types of all programs, and the number of events."""
    if isinstance(catalog, Catalog):
        found, events = {s[0] for e in catalog.events for s in program_of(e)}, len(catalog.events)
    else:
        own = steps.select(F.posexplode_outer("program.type").alias("at", "t"))
        rows = own.groupBy("t").agg(F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("n")).limit(MAX_TYPES + 2).collect()
        found, events = {r.t for r in rows if r.t is not None}, sum(r.n for r in rows)
    if len(found) > MAX_TYPES:
        raise ValueError(f"the catalogue has more than {MAX_TYPES} parameter types")
    return [parse_type(t) for t in sorted(found)], events


def _branches(kinds: list[AbiType], step: str, word: str) -> str:
    """The value of a step, by its type. Integers of all widths share a branch."""
    alike: dict[tuple, list[AbiType]] = {}
    for kind in kinds:
        one_word = not (kind.is_dynamic or kind.is_composite)
        key = (kind.kind, kind.size if kind.kind == "fixed_bytes" else None) if one_word else (kind.canonical,)
        alike.setdefault(key, []).append(kind)
    arms = []
    for own in alike.values():
        kind = own[0]
        whole = kind.is_dynamic or kind.is_composite
        value = value_at(kind, "__body", f"{step}.at", "0", as_text=True) if whole else word_text(kind, word)
        names = ", ".join(f"'{k.canonical}'" for k in own)
        arms.append(f"WHEN {step}.type IN ({names}) THEN {value}")
    return f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS STRING)"


def _word(step: str) -> str:
    return f"CASE WHEN {step}.topic IS NOT NULL THEN lower(substring(get(topics, {step}.topic), 3, 64)) ELSE lower(hex(substring(__body, {step}.at + 1, 32))) END"


def _integer(step: str) -> str:
    return f"{step}.type LIKE 'uint%' AND {step}.type NOT LIKE '%]' OR {step}.type LIKE 'int%' AND {step}.type NOT LIKE '%]'"


def _key(step: str) -> str:
    flipped = let(_word(step), lambda w: f"CASE WHEN {step}.type LIKE 'int%' THEN concat(translate(substring({w}, 1, 1), '0123456789abcdef', '89abcdef01234567'), substring({w}, 2, 63)) ELSE {w} END")
    return flipped


def _fits() -> Column:
    """Topics are words, and the body is long enough for its fixed part."""
    topics = F.forall(F.slice("topics", F.lit(2), F.greatest(F.size("topics") - 1, F.lit(0))), lambda t: W.topic_word(t).isNotNull())
    body = (F.col("head_bytes") == 0) | F.coalesce(F.length("__body") >= F.col("head_bytes"), F.lit(False))
    return (F.size("topics") == F.col("n_topics")) & topics & body


def _with_programs(logs: DataFrame, catalog: DataFrame | Catalog, how: str = "inner") -> tuple[DataFrame, list[AbiType]]:
    """Well-formed logs of registered events with their event's program and their body as bytes, and the
    types of all programs. With how="left" all logs, of which the others have no event_hash and no program."""
    spark = logs.sparkSession
    steps = _catalog_programs(spark, catalog) if isinstance(catalog, Catalog) else programs(catalog)
    kinds, events = _types(catalog, steps)
    # Said in both cases: Spark guesses a frame's size from that of the files it comes from.
    steps = steps.drop("event_name").hint("broadcast" if events <= MAX_BROADCAST_EVENTS else "shuffle_hash")
    hashed = (well_formed(logs) if how == "inner" else logs).withColumn("event_hash", F.when(is_well_formed(logs), topic0(logs)) if how == "left" else topic0(logs))
    routed = hashed.join(steps, "event_hash", how)
    return routed.withColumn("__body", W.hex_to_bytes(F.col("data"))), kinds


def _unfolded(kinds: list[AbiType], keys: bool, when: str | None = None) -> Column:
    """Columns values and keys of a log with its program, NULL where `when` does not hold. They come from a
    generator, so that later checks look at values and do not decode again."""
    values = f"transform(program, s -> {let(_word('s'), lambda w: _branches(kinds, 's', w))})"
    order = f"transform(filter(program, s -> {_integer('s')}), s -> {_key('s')})" if keys else "CAST(array() AS array<string>)"
    if when:
        values, order = (f"CASE WHEN {when} THEN {x} END" for x in (values, order))
    return F.expr(f"inline(array(named_struct('values', {values}, 'keys', {order})))")


def mark_decodable(logs: DataFrame, catalog: DataFrame | Catalog) -> DataFrame:
    """Routed logs of all events, read once, with `decodable`: whether the log has a row in its event's
    table. Only values that may not fit their body, those of dynamic types, are decoded to see."""
    routed, kinds = _with_programs(logs, catalog)
    loose = [k for k in kinds if k.is_dynamic]
    fits = _fits()
    if loose:
        names = ", ".join(f"'{k.canonical}'" for k in loose)
        fits = fits & F.expr(f"forall(filter(program, s -> s.topic IS NULL AND s.type IN ({names})), s -> ({_branches(loose, 's', 'NULL')}) IS NOT NULL)")
    return routed.withColumn("decodable", F.coalesce(fits, F.lit(False))).drop("__body", "program", "head_bytes")


def event_summary(logs: DataFrame, catalog: DataFrame | Catalog) -> DataFrame:
    """event_hash, last_event_block, event_count in one pass over the logs.

    last_event_block is the highest block that holds a log of the event, event_count the number of
    rows in its table."""
    return (
        mark_decodable(logs, catalog)
        .groupBy("event_hash")
        .agg(F.max("block_number").alias("last_event_block"), F.count_if("decodable").alias("event_count"))
    )


def contracts_of(logs: DataFrame, catalog: DataFrame | Catalog) -> DataFrame:
    """Distinct contract addresses over all event tables, in one pass over the logs."""
    rows = mark_decodable(logs, catalog).where("decodable")
    return rows.select(F.lower("address").alias("contract_address")).distinct()


def decode_packed(logs: DataFrame, catalog: DataFrame | Catalog, keys: bool = False) -> DataFrame:
    """Packed rows (PACKED) of all logs that fit their event, from one pass over the logs.

    catalog: events as plan-time objects, or an EVENT_CATALOG frame of any size."""
    routed, kinds = _with_programs(logs, catalog)
    ready = routed.where(_fits())
    packed = ready.select(
        "event_hash",
        "block_number",
        F.lower("transaction_hash").alias("transaction_hash"),
        "log_index",
        F.lower("address").alias("contract_address"),
        _unfolded(kinds, keys),
        "table_name",
    )
    return packed.where(F.forall("values", lambda v: v.isNotNull())).select(*PACKED.names)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows once for all tables, a folder for each."""
    packed.hint("rebalance", "table_name").sortWithinPartitions("table_name", "block_number").write.partitionBy("table_name").parquet(path)


def stage_packed(logs: DataFrame, catalog: Catalog, path: str, keys: bool = False) -> DataFrame:
    """All logs that have a block, from one pass over them, written as STAGED and read again.

    Raw logs are not kept, which take several times the room of their packed rows, and nothing is shuffled or
    sorted: a task writes a file for each table it meets, in the order of its logs."""
    spark = logs.sparkSession
    routed, kinds = _with_programs(lower_hex(logs.where(F.col("block_number").isNotNull())), catalog, "left")
    fixed = [F.col(c) for c in ("block_number", "block_hash", "block_timestamp", "log_index")]
    known = F.col("n_topics").isNotNull()
    decoded = routed.withColumn("__fits", F.coalesce(_fits(), F.lit(False))).select(
        F.when(known, F.col("event_hash")).alias("event_hash"), *fixed, "transaction_hash", F.col("address").alias("contract_address"), _unfolded(kinds, keys, "__fits"), "table_name"
    )
    own = F.coalesce(F.forall("values", lambda v: v.isNotNull()), F.lit(False))
    only = {c: F.when(F.col("__own"), F.col(c)) for c in ("transaction_hash", "contract_address", "values", "keys", "table_name")}
    rows = decoded.withColumn("__own", own).withColumns(only).select(*STAGED.names)
    with session_options(spark, {"spark.sql.maxConcurrentOutputFileWriters": WRITERS}):
        rows.write.partitionBy("table_name").options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(path)
    return spark.read.schema(STAGED).parquet(path)


def unpack(packed: DataFrame, event: EventDef, keys: bool = False) -> DataFrame:
    """The event table of packed rows of one event."""
    columns = [F.get("values", F.lit(i)).alias(p.column) for i, p in enumerate(event.stored)]
    integers = [p for p in event.stored if p.type.kind in ("uint", "int")]
    order = [F.get("keys", F.lit(i)).alias(p.column + KEY_SUFFIX) for i, p in enumerate(integers)] if keys else []
    return packed.select("block_number", "transaction_hash", "log_index", "contract_address", *columns, *order)


def packed_tables(spark: SparkSession, catalog: Catalog, path: str, keys: bool = False) -> LazyTables:
    """The event tables of packed rows that `write_packed` or `stage_packed` has written; each reads its own folder."""

    def table(name: str) -> DataFrame:
        rows = spark.read.schema(PACKED).parquet(path).where(F.col("table_name") == name)
        return unpack(rows, catalog.tables[name], keys)

    return LazyTables(catalog.tables, table)
