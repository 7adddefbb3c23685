"""Structured queries on one event table: typed predicates, projection, sort, page."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.abi_types import EventDef
from ..schema import EVENT_KEY, FIXED_COLUMNS, KEY_SUFFIX
from . import paging

DEFAULT_FIRST = 100
MAX_FIRST = 10_000

API_NAMES = {
    "block_number": "blockNumber",
    "transaction_hash": "transactionHash",
    "log_index": "logIndex",
    "contract_address": "contractAddress",
}
_FROM_API = {api: name for name, api in API_NAMES.items()}

SCALAR_OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class WhereClause:
    """column, one of eq in gt lt gte lte, and a string (a list of strings for `in`)."""

    column: str
    op: str
    value: str | Sequence[str]

    def __post_init__(self):
        if self.op != "in" and self.op not in SCALAR_OPS:
            raise ValueError(f"unknown operator {self.op!r}: use eq, in, gt, lt, gte, lte")
        if (self.op == "in") == isinstance(self.value, str):
            raise ValueError("operator/value mismatch: 'in' takes a list, the others a scalar")
        if self.op == "in" and not self.value:
            raise ValueError("'in' needs a non-empty list")


@dataclass(frozen=True)
class EventQuery:
    where: Sequence[WhereClause] = ()
    condition: Mapping[str, str] = field(default_factory=dict)
    order_by: str | None = None
    order_dir: str = "ASC"
    first: int | None = None
    skip: int | None = None
    #: Columns to return, in this order; all of them by default.
    columns: Sequence[str] | None = None


def from_api_name(name: str) -> str:
    """blockNumber -> block_number and so on; parameter names stay."""
    return _FROM_API.get(name, name)


def to_api_names(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed(API_NAMES)


def where_from_map(where: Mapping[str, Mapping[str, str | Sequence[str]]]) -> list[WhereClause]:
    """{column: {op: value}} -> clauses; several operators on one column are allowed."""
    return [WhereClause(from_api_name(c), op, v) for c, ops in where.items() for op, v in ops.items()]


def classify(column: str, event: EventDef) -> str:
    """long, uint, int, hex or text: decides how literals are read and columns compared."""
    if column in ("block_number", "log_index"):
        return "long"
    if column in ("transaction_hash", "contract_address"):
        return "hex"
    for p in event.params:
        if p.column == column:
            if p.stored_as_topic_hash or p.type.kind in ("address", "fixed_bytes", "bytes", "function"):
                return "hex"
            return p.type.kind if p.type.kind in ("uint", "int") else "text"
    raise ValueError(f"unknown column {column!r}")


def literal(value: str, kind: str) -> int | str:
    """Read a literal of a column class; ValueError if it does not fit."""
    if kind in ("long", "uint", "int"):
        if not re.fullmatch(r"[+-]?[0-9]+", value):
            raise ValueError(f"expected a number, got {value!r}")
        return int(value)
    if kind == "hex":
        digits = value[2:] if value[:2] in ("0x", "0X") else value
        if not re.fullmatch(r"[0-9a-fA-F]+", digits):
            raise ValueError(f"expected hex digits, got {value!r}")
        return "0x" + digits.lower()
    return value


def _long_predicate(column: Column, op: str, number: int) -> Column:
    # Literals beyond 64 bits are legal and compare as numbers: no value equals or passes them.
    if abs(number) < 2**63:
        return SCALAR_OPS[op](column, F.lit(number))
    return column.isNotNull() & F.lit(op != "eq" and (number > 0) == (op in ("lt", "lte")))


def _wide_predicate(column: str, op: str, number: int, kind: str, has_key: bool) -> Column:
    text = F.col(f"`{column}`")
    if op == "eq":
        return text == str(number)
    low, high = (-(1 << 255), (1 << 255) - 1) if kind == "int" else (0, (1 << 256) - 1)
    if not low <= number <= high:
        return F.lit((number > high) == (op in ("lt", "lte")))
    if has_key:
        return SCALAR_OPS[op](F.col(f"`{column}{KEY_SUFFIX}`"), W.key_literal(number, kind == "int"))
    return SCALAR_OPS[op](W.decimal_key(text), W.decimal_key_literal(number))


def predicate(clause: WhereClause, event: EventDef, columns: Sequence[str]) -> Column:
    """One clause as a Column. Literals enter the plan as literals, never as SQL text."""
    kind = classify(clause.column, event)
    column = F.col(f"`{clause.column}`")
    if clause.op == "in":
        values = [literal(v, kind) for v in clause.value]
        if kind == "long":
            return reduce(lambda a, b: a | b, [_long_predicate(column, "eq", v) for v in values]) if any(
                abs(v) >= 2**63 for v in values
            ) else column.isin(values)
        return column.isin([str(v) for v in values])
    value = literal(clause.value, kind)
    if kind == "long":
        return _long_predicate(column, clause.op, value)
    if kind in ("uint", "int"):
        return _wide_predicate(clause.column, clause.op, value, kind, clause.column + KEY_SUFFIX in columns)
    return SCALAR_OPS[clause.op](column, F.lit(value))


def order_key(column: str, event: EventDef, columns: Sequence[str]) -> Column:
    """What to sort by: numbers sort as numbers, whatever their width."""
    if classify(column, event) not in ("uint", "int"):
        return F.col(f"`{column}`")
    if column + KEY_SUFFIX in columns:
        return F.col(f"`{column}{KEY_SUFFIX}`")
    return W.decimal_key(F.col(f"`{column}`"))


def _page(query: EventQuery) -> tuple[int | None, int]:
    first, skip = query.first, query.skip or 0
    if (first or 0) < 0 or skip < 0:
        raise ValueError("first and skip must not be negative")
    return first, skip


def event_query(table: DataFrame, event: EventDef, query: EventQuery = EventQuery()) -> DataFrame:
    """Rows of an event table: fixed columns, then parameters in signature order.

    Without `first` all rows come. Rows with equal `order_by` come in the order of their keys. Without
    `order_by` the choice of an early page is left to Spark; one that begins deep goes by the keys."""
    columns = table.columns
    clauses = [WhereClause(from_api_name(w.column), w.op, w.value) for w in query.where]
    clauses += [WhereClause(from_api_name(c), "eq", v) for c, v in query.condition.items()]
    direction = query.order_dir.upper()
    if direction not in ("ASC", "DESC"):
        raise ValueError(f"order_dir must be ASC or DESC, got {query.order_dir!r}")
    first, skip = _page(query)
    rows = table
    if clauses:
        rows = rows.where(reduce(and_, [predicate(c, event, columns) for c in clauses]))
    names = list(FIXED_COLUMNS) + [p.column for p in event.params]
    if query.columns is not None:
        wanted = [from_api_name(c) for c in query.columns]
        if unknown := [c for c in wanted if c not in names]:
            raise ValueError(f"unknown columns {unknown}")
        names = wanted
    key = None if query.order_by is None else order_key(from_api_name(query.order_by), event, columns)
    order = paging.Order(key, direction == "DESC")
    if first is not None and (key is not None or skip + first > paging.ENOUGH):
        rows = paging.page(rows, order, first, skip)
    else:
        rows = rows if key is None else rows.orderBy(*order.columns())
        rows = rows.offset(skip) if skip else rows
        rows = rows if first is None else rows.limit(first)
    return rows.select(*[F.col(f"`{n}`") for n in names])


def event_api(tables: Mapping[str, DataFrame], events: Mapping[str, EventDef]) -> dict[str, Callable[..., DataFrame]]:
    """One query function per event table, under the table's name.

    Arguments: where={column: {op: value}}, condition={column: value}, orderBy, orderDir,
    first, skip, columns, in outward names; so are the result columns. A page has DEFAULT_FIRST rows
    unless `first` says otherwise, and more than MAX_FIRST are refused."""

    def build(name: str, event: EventDef) -> Callable[..., DataFrame]:
        def run(where=None, condition=None, orderBy=None, orderDir="ASC", first=None, skip=None, columns=None) -> DataFrame:
            if first is not None and first > MAX_FIRST:
                raise ValueError(f"first must not exceed {MAX_FIRST}; use skip for later pages")
            size = DEFAULT_FIRST if first is None else first
            query = EventQuery(where_from_map(where or {}), condition or {}, orderBy, orderDir, size, skip, columns)
            return to_api_names(event_query(tables[name], event, query))

        return run

    return {name: build(name, event) for name, event in events.items()}


def latest(table: DataFrame, n: int = 100) -> DataFrame:
    """The n last rows, by block, transaction hash and log index."""
    return table.orderBy(*[F.col(c).desc() for c in EVENT_KEY]).limit(n)
