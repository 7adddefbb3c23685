"""Event catalogues: the definitions a job listens to, as plan-time objects and as a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.abi_types import EventDef, table_name
from ..functions.keccak import keccak256_many
from ..schema import EVENT_CATALOG

# A catalogue is configuration. Above this many events it is joined by shuffle, not broadcast.
MAX_BROADCAST_EVENTS = 50_000


@dataclass(frozen=True)
class Catalog:
    """Registered events of one chain."""

    chain_id: int
    events: tuple[EventDef, ...]

    @staticmethod
    def of(chain_id: int, events: Iterable[EventDef | str]) -> Catalog:
        """Parse signatures, drop repeats of one event, refuse table-name clashes."""
        by_hash: dict[str, EventDef] = {}
        for e in events:
            event = EventDef.parse(e) if isinstance(e, str) else e
            by_hash.setdefault(event.hash, event)
        tables: dict[str, EventDef] = {}
        for event in by_hash.values():
            other = tables.setdefault(event.table_name(chain_id), event)
            if other is not event:
                raise ValueError(
                    f"{event.canonical} and {other.canonical} share the table name "
                    f"{event.table_name(chain_id)}"
                )
        return Catalog(chain_id, tuple(by_hash.values()))

    def event(self, name_or_hash: str) -> EventDef:
        found = [e for e in self.events if name_or_hash in (e.name, e.hash, e.canonical)]
        if len(found) != 1:
            raise KeyError(f"{len(found)} events match {name_or_hash!r}")
        return found[0]

    def table(self, name_or_hash: str) -> str:
        return self.event(name_or_hash).table_name(self.chain_id)

    @property
    def tables(self) -> dict[str, EventDef]:
        return {e.table_name(self.chain_id): e for e in self.events}

    @property
    def hashes(self) -> list[str]:
        return [e.hash for e in self.events]

    def frame(self, spark: SparkSession) -> DataFrame:
        """EVENT_CATALOG rows."""
        return spark.createDataFrame([_row(self.chain_id, e, e.hash) for e in self.events], EVENT_CATALOG)


def _row(chain_id: int, event: EventDef, event_hash: str) -> tuple:
    params = [(p.name, p.type.canonical, p.indexed, p.pos) for p in event.params]
    return (
        chain_id,
        event_hash,
        event.signature,
        event.canonical,
        event.name,
        event.n_topics,
        params,
        table_name(chain_id, event.name, event_hash),
    )


def catalog_from_signatures(chain_id: int, signatures: Iterable[str]) -> Catalog:
    """Events given as `[event] Name(type [indexed] [name], ...)`."""
    return Catalog.of(chain_id, signatures)


def parse_abi_entries(entries: DataFrame) -> DataFrame:
    """ABI entries (column `entry`, one event as JSON text; `chain_id`) -> EVENT_CATALOG.

    Parsing and hashing run in Arrow batches over distinct entries."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            events = [EventDef.from_abi(json.loads(entry)) for entry in batch["entry"]]
            hashes = keccak256_many([e.canonical.encode() for e in events])
            rows = [_row(int(c), e, "0x" + h) for c, e, h in zip(batch["chain_id"], events, hashes)]
            out = pd.DataFrame(rows, columns=EVENT_CATALOG.names)
            out["params"] = [
                [dict(zip(("name", "type", "indexed", "pos"), p)) for p in params]
                for params in out["params"]
            ]
            yield out

    distinct = entries.select("chain_id", "entry").distinct()
    return distinct.mapInPandas(parse, EVENT_CATALOG).dropDuplicates(["chain_id", "event_hash"])


def signature_hashes(signatures: DataFrame, column: str) -> DataFrame:
    """Distinct canonical signatures and their topic0 hashes."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch[column])
            yield pd.DataFrame(
                {column: texts, "event_hash": ["0x" + h for h in keccak256_many([t.encode() for t in texts])]}
            )

    return signatures.select(column).distinct().mapInPandas(hashed, f"{column} string, event_hash string")


def abi_entries(spark: SparkSession, chain_id: int, path: str) -> DataFrame:
    """Event entries of ABI JSON files as JSON text, nested components kept."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.expr("from_json(value, 'array<string>')")).alias("entry"))
    kind = F.get_json_object("entry", "$.type")
    anonymous = F.coalesce(F.get_json_object("entry", "$.anonymous"), F.lit("false"))
    return items.where((kind == "event") & (anonymous != "true")).select(
        F.lit(chain_id).cast("long").alias("chain_id"), "entry"
    )


def catalog_from_abi(spark: SparkSession, chain_id: int, path: str) -> Catalog:
    """All events of ABI JSON files. The entries are configuration and come to the driver."""
    rows = abi_entries(spark, chain_id, path).select("entry").distinct().toLocalIterator()
    events = sorted((EventDef.from_abi(json.loads(r.entry)) for r in rows), key=lambda e: e.hash)
    return Catalog.of(chain_id, events)
