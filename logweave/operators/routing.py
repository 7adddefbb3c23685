"""Routing raw logs to events, decoding them, and setting bad ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.abi_types import EventDef, Param
from ..functions.decode import value_at, word_text
from ..schema import FIXED_COLUMNS, KEY_SUFFIX
from ..sources.catalog import MAX_BROADCAST_EVENTS, Catalog
from ..sources.logs import topic0

_RAW = "__raw"


class UnknownEventError(RuntimeError):
    """Strict mode met a log whose event is not registered."""


class UndecodableLogError(RuntimeError):
    """Strict mode met a log whose topics or data do not fit its event."""


def well_formed(logs: DataFrame) -> DataFrame:
    """Drop logs without block number, event hash or transaction hash, and removed logs."""
    return logs.where(is_well_formed(logs))


def malformed(logs: DataFrame) -> DataFrame:
    """What `well_formed` drops."""
    return logs.where(~F.coalesce(is_well_formed(logs), F.lit(False)))


def is_well_formed(logs: DataFrame) -> Column:
    """NULL counts as false."""
    return (
        F.col("block_number").isNotNull()
        & topic0(logs).isNotNull()
        & F.col("transaction_hash").isNotNull()
        & ~F.coalesce(F.col("removed"), F.lit(False))
    )


def _catalog_side(logs: DataFrame, catalog: Catalog) -> DataFrame:
    frame = catalog.frame(logs.sparkSession).select("event_hash", "event_name", "table_name", "n_topics")
    return F.broadcast(frame) if len(catalog.events) <= MAX_BROADCAST_EVENTS else frame


def unknown_events(logs: DataFrame, catalog: Catalog) -> DataFrame:
    """topic0 values of no registered event, with the number of logs each."""
    known = _catalog_side(logs, catalog).select("event_hash")
    return (
        well_formed(logs)
        .withColumn("event_hash", topic0(logs))
        .join(known, "event_hash", "left_anti")
        .groupBy("event_hash")
        .agg(F.count("*").alias("log_count"))
    )


def require_known(logs: DataFrame, catalog: Catalog) -> None:
    """Strict mode: raise if any log belongs to no registered event."""
    first = unknown_events(logs, catalog).limit(1).collect()
    if first:
        raise UnknownEventError(f"event {first[0].event_hash} on chain {catalog.chain_id} is not registered")


def route(logs: DataFrame, catalog: Catalog, strict: bool = False) -> DataFrame:
    """Well-formed logs with event_hash, event_name, table_name and the expected topic count."""
    if strict:
        require_known(logs, catalog)
    return (
        well_formed(logs)
        .withColumn("event_hash", topic0(logs))
        .join(_catalog_side(logs, catalog), "event_hash")
    )


def of_event(logs: DataFrame, event: EventDef) -> DataFrame:
    """Logs with the event's hash and topic count; other topic counts are another event."""
    return well_formed(logs).where((topic0(logs) == event.hash) & (F.size("topics") == event.n_topics))


def _fixed() -> list[Column]:
    return [
        F.col("block_number"),
        F.lower("transaction_hash").alias("transaction_hash"),
        F.col("log_index"),
        F.lower("address").alias("contract_address"),
    ]


def _is_static(event: EventDef) -> bool:
    return all(not p.type.is_composite and not p.type.is_dynamic for p in event.body)


def _topics_valid(event: EventDef) -> Column:
    valid = F.lit(True)
    for i in range(1, event.n_topics):
        valid = valid & W.topic_word(F.get("topics", F.lit(i))).isNotNull()
    return valid


def _head_valid(event: EventDef) -> Column:
    """Topics are words and the data is long enough for its fixed part.

    Data of static events must also be hex. For dynamic ones the decoded values tell, so
    that a long body is not turned into bytes twice."""
    if not event.body:
        return _topics_valid(event)
    data = F.col("data")
    long_enough = F.length(data) >= 2 + 2 * event.body_head_bytes
    if _is_static(event):
        long_enough = long_enough & W.hex_to_bytes(data).isNotNull()
    return _topics_valid(event) & F.coalesce(long_enough, F.lit(False))


def _word_columns(event: EventDef) -> list[Column]:
    """The word of every indexed and every static body parameter, as `__t<pos>`."""
    words = [
        F.lower(F.substring(F.get("topics", F.lit(i)), 3, 64)).alias(f"__t{p.pos}")
        for i, p in enumerate(event.indexed, start=1)
    ]
    at = 0
    for p in event.body:
        if not (p.type.is_composite or p.type.is_dynamic):
            words.append(F.lower(F.substring("data", 3 + 2 * at, 64)).alias(f"__t{p.pos}"))
        at += p.type.head_bytes
    return words


def _word_value(param: Param) -> str:
    word = f"__t{param.pos}"
    if param.stored_as_topic_hash:
        return f"concat('0x', {word})"
    value = word_text(param.type, word)
    # Words are never NULL here; saying so spares a join on the column a decode in its null check.
    return f"coalesce({value}, '')" if param.type.kind in ("uint", "int") else value


def _has_key(param: Param) -> bool:
    return param.type.kind in ("uint", "int")


def _key(param: Param) -> Column:
    word = F.col(f"__t{param.pos}")
    key = W.int_key(word) if param.type.kind == "int" else W.uint_key(word)
    return key.alias(param.column + KEY_SUFFIX)


def _decoded(logs: DataFrame, event: EventDef, nested: bool, keys: bool, raw: bool) -> DataFrame:
    """Decode logs that pass `_head_valid`. Dynamic bodies may still fail: column `__valid`."""
    carry = [F.col(_RAW)] if raw else []
    key_columns = [_key(p) for p in event.stored if keys and _has_key(p)]
    if _is_static(event):
        words = logs.select(*_fixed(), *_word_columns(event), *carry)
        columns = [F.expr(_word_value(p)).alias(p.column) for p in event.stored]
        return words.select(*FIXED_COLUMNS, *columns, *key_columns, *carry)
    body = W.hex_to_bytes(F.col("data")).alias("__body")
    words = logs.select(*_fixed(), *_word_columns(event), body, *carry)
    # Unfold the decoded struct through a generator: later filters on its fields then act
    # on decoded values instead of repeating the decoding.
    fields: list[str] = []
    checks: list[str] = []
    at = 0
    for p in event.stored:
        if p.indexed or not (p.type.is_composite or p.type.is_dynamic):
            fields += [f"'{p.column}'", _word_value(p)]
        else:
            text = value_at(p.type, "__body", str(at), "0", as_text=True)
            if nested and p.type.is_composite:
                value = value_at(p.type, "__body", str(at), "0", as_text=False)
                fields += [f"'{p.column}'", value, f"'__ok{p.pos}'", f"({text}) IS NOT NULL"]
                checks.append(f"`__ok{p.pos}`")
            else:
                fields += [f"'{p.column}'", text]
                checks.append(f"`{p.column}` IS NOT NULL")
        if not p.indexed:
            at += p.type.head_bytes
    unfolded = words.select(
        *FIXED_COLUMNS, *key_columns, *carry, F.expr(f"inline(array(named_struct({', '.join(fields)})))")
    )
    params = [f"`{p.column}`" for p in event.stored]
    kept_keys = [f"`{p.column}{KEY_SUFFIX}`" for p in event.stored if keys and _has_key(p)]
    return unfolded.select(
        *FIXED_COLUMNS, *params, *kept_keys, *carry, F.expr(" AND ".join(checks)).alias("__valid")
    )


def decode(
    logs: DataFrame,
    event: EventDef,
    nested: bool = False,
    keys: bool = False,
    on_error: str = "quarantine",
) -> DataFrame:
    """One event's rows: the fixed columns, then indexed, then body parameters, all as text.

    nested: arrays and structs stay arrays and structs. keys: 256-bit order keys are kept
    in `<param>__w` columns. Logs that cannot be decoded are left out (see `quarantine`);
    on_error="fail" raises if there are any."""
    if on_error == "fail":
        bad = quarantine(logs, event).limit(1).collect()
        if bad:
            raise UndecodableLogError(f"log {bad[0].transaction_hash}/{bad[0].log_index} does not fit {event.signature}")
    rows = _decoded(of_event(logs, event).where(_head_valid(event)), event, nested, keys, raw=False)
    return rows.where("__valid").drop("__valid") if "__valid" in rows.columns else rows


def quarantine(logs: DataFrame, event: EventDef) -> DataFrame:
    """Raw logs of the event, topic count right, that cannot be decoded."""
    mine = of_event(logs, event)
    columns = [F.col(c) for c in logs.columns]
    short = mine.where(~_head_valid(event)).select(*columns, F.lit("topics or head").alias("reason"))
    if _is_static(event):
        return short
    tagged = mine.where(_head_valid(event)).withColumn(_RAW, F.struct(*columns))
    deep = _decoded(tagged, event, nested=False, keys=False, raw=True).where(~F.col("__valid"))
    return short.unionByName(deep.select(f"{_RAW}.*", F.lit("dynamic body").alias("reason")))


def wrong_arity(logs: DataFrame, event: EventDef) -> DataFrame:
    """Logs with the event's hash but another number of topics."""
    return well_formed(logs).where((topic0(logs) == event.hash) & (F.size("topics") != event.n_topics))


def decode_all(logs: DataFrame, catalog: Catalog, strict: bool = False, nested: bool = False, keys: bool = False) -> dict[str, DataFrame]:
    """One DataFrame per event table.

    Each reads the logs through a filter on the event hash, which staged logs answer from
    row-group statistics. For logs that are costly to produce (a micro-batch, JSON), stage
    or persist them first."""
    if strict:
        require_known(logs, catalog)
    return {
        name: decode(logs, event, nested=nested, keys=keys) for name, event in catalog.tables.items()
    }
