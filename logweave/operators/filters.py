"""Ingest-time filters on raw logs: contract, event, indexed parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.abi_types import EventDef
from ..sources.catalog import MAX_BROADCAST_EVENTS
from ..sources.logs import topic0

# Longer lists become a join instead of a literal list in the plan.
MAX_INLINE_VALUES = 1_000

FilterMap = Mapping[str, "str | Sequence[str]"]


def by_contract(logs: DataFrame, address: str | None) -> DataFrame:
    """Logs of one contract; no address means the whole chain."""
    return logs if address is None else logs.where(F.col("address") == address.lower())


def by_event(logs: DataFrame, event: EventDef) -> DataFrame:
    return logs.where(topic0(logs) == event.hash)


def by_events(logs: DataFrame, events: Sequence[EventDef] | None) -> DataFrame:
    """Logs of any of the events; None or an empty list means no constraint."""
    if not events:
        return logs
    hashes = sorted({e.hash for e in events})
    if len(hashes) <= MAX_INLINE_VALUES:
        return logs.where(topic0(logs).isin(hashes))
    wanted = _value_frame(logs.sparkSession, hashes)
    return logs.join(wanted, topic0(logs) == F.col("wanted"), "left_semi")


def _value_frame(spark: SparkSession, values: list[str]) -> DataFrame:
    frame = spark.createDataFrame([(v,) for v in values], "wanted string")
    return F.broadcast(frame) if len(values) <= MAX_BROADCAST_EVENTS else frame


def topic_value(text: str) -> str:
    """A filter value as a 32-byte topic: 0x stripped, zero-padded on the left, lower-case."""
    digits = text[2:] if text.startswith("0x") else text
    digits = digits.rjust(64, "0")
    if not re.fullmatch(r"[0-9a-fA-F]{64}", digits):
        raise ValueError(f"cannot read topic value {text!r}")
    return "0x" + digits.lower()


def topic_filters(event: EventDef, filters: FilterMap | None, on_invalid: str = "drop") -> dict[int, list[str]]:
    """Topic position -> accepted topics. Unknown and non-indexed keys are errors.

    Values that cannot be read are dropped, and a key left without values constrains
    nothing; with on_invalid="error" they raise instead."""
    positions = {p.name: i for i, p in enumerate(event.indexed, start=1)}
    out: dict[int, list[str]] = {}
    for key, given in (filters or {}).items():
        values = [given] if isinstance(given, str) else list(given)
        if not values:
            continue
        if key not in positions:
            if any(p.name == key for p in event.params):
                raise ValueError(
                    f"filter key {key!r} is a non-indexed parameter of {event.name}; only indexed parameters can be filtered"
                )
            raise ValueError(
                f"filter key {key!r} does not match any parameter of {event.name}; indexed parameters: {list(positions)}"
            )
        topics = []
        for value in values:
            try:
                topics.append(topic_value(value))
            except ValueError:
                if on_invalid == "error":
                    raise
        if topics:
            out[positions[key]] = topics
    return out


def by_params(logs: DataFrame, event: EventDef, filters: FilterMap | None, on_invalid: str = "drop") -> DataFrame:
    """One event's logs whose indexed parameters match: OR within a key, AND across keys."""
    logs = by_event(logs, event)
    conditions = []
    for position, topics in topic_filters(event, filters, on_invalid).items():
        column = F.get("topics", F.lit(position))
        if len(topics) <= MAX_INLINE_VALUES:
            conditions.append(column.isin(topics))
        else:
            wanted = _value_frame(logs.sparkSession, sorted(set(topics)))
            logs = logs.join(wanted, column == F.col("wanted"), "left_semi")
    return logs.where(reduce(and_, conditions)) if conditions else logs
