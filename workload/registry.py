"""Collects the registered queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; without SQL the driver only checks that it runs."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# SQL fragments shared by the oracles.


def w(x: str) -> str:
    return f"'0x' || lpad(lower(to_hex({x})), 64, '0')"


def addr(x: str) -> str:
    return f"'0x' || lpad(lower(to_hex({x})), 40, '0')"


def text(x: str) -> str:
    return f"cast({x} as varchar)"


E_CTE = f"""e AS (
  SELECT event_id, event_type, user_id, cast(round(value * 100) AS bigint) AS c,
         1 + event_id // 10 AS bn, (7 * user_id + event_id) % 150 AS other,
         {w('event_id + 1')} AS tx, cast(event_id % 10 AS integer) AS li,
         {addr('1 + event_id % 3')} AS contract,
         {addr('user_id')} AS user_addr, {addr('(7 * user_id + event_id) % 150')} AS other_addr
  FROM events)"""

TRANSFER_SELECT = """SELECT bn AS block_number, tx AS transaction_hash, li AS log_index, contract AS contract_address,
  user_addr AS "from", other_addr AS "to", cast(c AS varchar) AS value FROM e WHERE event_type = 'purchase'"""

T_CTE = f"{E_CTE}, t AS ({TRANSFER_SELECT})"


def gov_time(block: str, key: str) -> str:
    return f"(CASE WHEN {key} % 7 <> 0 THEN 1600000000 + {block} ELSE 0 END)"


LINE_HASH = """'0x' || sha256(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
  cast(round(l_extendedprice * 100) AS bigint), cast(round(l_tax * 100) AS bigint), l_linestatus))"""


def wide_text(high: str, low: str) -> str:
    """Decimal text of high * 2^192 + low for non-negative HUGEINT expressions."""
    base, value, weights = 10**18, 1 << 192, []
    while value:
        value, digit = divmod(value, base)
        weights.append(digit)
    b = f"{base}::hugeint"
    total = f"({high}) * {weights[0]}::hugeint + ({low})"
    digits = []
    for weight in weights[1:]:
        digits.append(f"lpad(cast(({total}) % {b} AS varchar), 18, '0')")
        total = f"({high}) * {weight}::hugeint + ({total}) // {b}"
    parts = " || ".join([f"cast({total} AS varchar)"] + digits[::-1])
    return f"(CASE WHEN ({high}) = 0 AND ({low}) = 0 THEN '0' ELSE ltrim({parts}, '0') END)"


def signed_wide_text(high: str, low: str) -> str:
    """The same where both parts share a sign, or differ with |low| < 2^192."""
    negative = f"(({high}) < 0 OR (({high}) = 0 AND ({low}) < 0))"
    return f"(CASE WHEN {negative} THEN '-' || {wide_text(f'-({high})', f'-({low})')} ELSE {wide_text(high, low)} END)"
