"""Table columns -> ABI words, topics and log bodies (the inverse of decoding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .abi_types import AbiType, EventDef


def uint_word(value: Column) -> Column:
    """Non-negative integer column -> 64 hex digits."""
    return F.lpad(F.lower(F.hex(value.cast("bigint"))), 64, "0")


def int_word(value: Column) -> Column:
    """Signed integer column -> two's complement word."""
    digits = F.lower(F.hex(value.cast("bigint")))
    return F.when(value < 0, F.lpad(digits, 64, "f")).otherwise(F.lpad(digits, 64, "0"))


def bool_word(value: Column) -> Column:
    return F.lpad(F.when(value, "1").otherwise("0"), 64, "0")


def hex_word(text: Column) -> Column:
    """0x-hex text, right-aligned (addresses, full words)."""
    return F.lpad(F.regexp_replace(F.lower(text), "^0x", ""), 64, "0")


def left_word(text: Column) -> Column:
    """0x-hex text, left-aligned (bytesN)."""
    return F.rpad(F.regexp_replace(F.lower(text), "^0x", ""), 64, "0")


def address(value: Column) -> Column:
    """Integer column -> address text."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value.cast("bigint"))), 40, "0"))


def _length_word(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("bigint"))), 64, "0")


def _packed(data: Column) -> Column:
    digits = F.lower(F.hex(data))
    padded = F.rpad(digits, F.ceil(F.length(data) / F.lit(32)).cast("int") * F.lit(64), "0")
    return F.concat(_length_word(F.length(data)), padded)


def tail(kind: AbiType, value: Column) -> Column:
    """Body part of bytes, string, or an array of static elements given as words."""
    if kind.kind == "string":
        return _packed(F.encode(value, "UTF-8"))
    if kind.kind == "bytes":
        return _packed(value)
    if kind.kind == "array" and kind.length is None and not kind.element.is_dynamic:
        return F.concat(_length_word(F.size(value)), F.array_join(value, ""))
    raise ValueError(f"encoding {kind.canonical} from columns is not supported")


def log_topics(event: EventDef, indexed: list[Column]) -> Column:
    """topics[] from the words of the indexed parameters."""
    return F.array(F.lit(event.hash), *[F.concat(F.lit("0x"), w) for w in indexed])


def log_data(event: EventDef, body: list[Column]) -> Column:
    """data from body values: words for static parameters, values for dynamic ones."""
    heads: list[Column] = []
    tails: list[Column] = []
    offset: Column = F.lit(event.body_head_bytes)
    for param, value in zip(event.body, body, strict=True):
        if param.type.is_dynamic:
            part = tail(param.type, value)
            heads.append(_length_word(offset))
            tails.append(part)
            offset = offset + (F.length(part) / F.lit(2)).cast("int")
        else:
            heads.append(value)
    return F.concat(F.lit("0x"), *heads, *tails)
