"""A small ABI encoder on Python values, as an independent source of test logs."""

from __future__ import annotations

from logweave.functions.abi_types import AbiType, EventDef


def word(value: int) -> str:
    return f"{value % (1 << 256):064x}"


def encode(kind: AbiType, value) -> str:
    """Hex of a value: in place if static, its tail if dynamic."""
    if kind.kind in ("uint", "int"):
        return word(value)
    if kind.kind == "bool":
        return word(int(value))
    if kind.kind == "address":
        return value[2:].lower().rjust(64, "0")
    if kind.kind in ("fixed_bytes", "function"):
        return value[2:].lower().ljust(64, "0")
    if kind.kind in ("bytes", "string"):
        data = value.encode() if kind.kind == "string" else value
        return word(len(data)) + data.hex().ljust(-(-len(data) // 32) * 64, "0")
    if kind.kind == "array":
        count = "" if kind.length is not None else word(len(value))
        return count + encode_tuple([kind.element] * len(value), value)
    return encode_tuple([t for _, t in kind.components], value)


def encode_tuple(kinds: list[AbiType], values) -> str:
    heads, tails, offset = [], [], sum(k.head_bytes for k in kinds)
    for kind, value in zip(kinds, values, strict=True):
        part = encode(kind, value)
        if kind.is_dynamic:
            heads.append(word(offset))
            tails.append(part)
            offset += len(part) // 2
        else:
            heads.append(part)
    return "".join(heads + tails)


def show(kind: AbiType, value) -> str:
    """Expected text of a value."""
    if kind.kind == "bool":
        return "true" if value else "false"
    if kind.kind == "bytes":
        return "0x" + value.hex()
    if kind.kind == "array":
        return "[" + ",".join(show(kind.element, v) for v in value) + "]"
    if kind.kind == "tuple":
        return "(" + ",".join(show(t, v) for (_, t), v in zip(kind.components, value)) + ")"
    return str(value).lower() if kind.kind in ("address", "fixed_bytes", "function") else str(value)


def log(event: EventDef, values: list, block: int = 1, index: int = 0, address: str = "0x" + "ab" * 20, **changes) -> dict:
    """A raw log of an event from its parameter values in signature order."""
    topics = [event.hash]
    for p in event.indexed:
        value = values[p.pos]
        topics.append("0x" + (value if p.stored_as_topic_hash else encode(p.type, value)))
    body = encode_tuple([p.type for p in event.body], [values[p.pos] for p in event.body])
    record = {
        "address": address,
        "topics": topics,
        "data": "0x" + body,
        "block_number": block,
        "block_hash": "0x" + word(block),
        "block_timestamp": None,
        "transaction_hash": "0x" + word(block * 1000 + index),
        "transaction_index": 0,
        "log_index": index,
        "removed": False,
    }
    record.update(changes)
    return record


def frame(spark, logs: list[dict]):
    from logweave.schema import RAW_LOG

    return spark.createDataFrame([tuple(r[n] for n in RAW_LOG.names) for r in logs], RAW_LOG)
