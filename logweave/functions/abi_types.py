"""Event definitions: Solidity types, parameters, signatures and table names."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from ..schema import FIXED_COLUMNS, KEY_SUFFIX
from .keccak import event_hash

_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*$")
_BASE = re.compile(r"(uint|int|bytes|address|bool|string|function)(\d*)$")


@dataclass(frozen=True)
class AbiType:
    """kind is one of uint, int, address, bool, fixed_bytes, function, bytes, string, array, tuple."""

    kind: str
    size: int = 0  # bits for integers, bytes for fixed_bytes
    element: AbiType | None = None
    length: int | None = None  # None: the array length is part of the data
    components: tuple[tuple[str, AbiType], ...] = ()

    @cached_property
    def canonical(self) -> str:
        if self.kind in ("uint", "int"):
            return f"{self.kind}{self.size}"
        if self.kind == "fixed_bytes":
            return f"bytes{self.size}"
        if self.kind == "array":
            return f"{self.element.canonical}[{'' if self.length is None else self.length}]"
        if self.kind == "tuple":
            return "(" + ",".join(t.canonical for _, t in self.components) + ")"
        return self.kind

    @cached_property
    def is_dynamic(self) -> bool:
        if self.kind in ("bytes", "string"):
            return True
        if self.kind == "array":
            return self.length is None or self.element.is_dynamic
        return self.kind == "tuple" and any(t.is_dynamic for _, t in self.components)

    @property
    def is_composite(self) -> bool:
        return self.kind in ("array", "tuple")

    @cached_property
    def head_bytes(self) -> int:
        """Bytes the value takes in the head of its enclosing tuple."""
        if self.is_dynamic:
            return 32
        if self.kind == "array":
            return self.length * self.element.head_bytes
        if self.kind == "tuple":
            return sum(t.head_bytes for _, t in self.components)
        return 32


def split_top_level(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return parts + [last] if last or parts else []


def _closing(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError(f"unbalanced parentheses in {text!r}")


def _elementary(name: str) -> AbiType:
    match = _BASE.match(name)
    if not match:
        raise ValueError(f"unknown type {name!r}")
    base, digits = match.groups()
    if base in ("uint", "int"):
        bits = int(digits or 256)
        if bits % 8 or not 8 <= bits <= 256:
            raise ValueError(f"unknown type {name!r}")
        return AbiType(base, bits)
    if base == "bytes" and digits:
        if not 1 <= int(digits) <= 32:
            raise ValueError(f"unknown type {name!r}")
        return AbiType("fixed_bytes", int(digits))
    if digits:
        raise ValueError(f"unknown type {name!r}")
    return AbiType(base)


def _with_suffixes(base: AbiType, suffix: str) -> AbiType:
    for size in re.findall(r"\[(\d*)\]", suffix):
        if size == "0":
            raise ValueError("arrays of fixed length 0 are not allowed")
        base = AbiType("array", element=base, length=int(size) if size else None)
    if re.sub(r"\[\d*\]", "", suffix):
        raise ValueError(f"malformed array suffix {suffix!r}")
    return base


def parse_type(text: str) -> AbiType:
    """A type such as uint256, bytes4[], (address,uint128)[2]."""
    text = text.strip()
    if text.startswith("tuple("):
        text = text[len("tuple") :]
    if text.startswith("("):
        end = _closing(text, 0)
        members = []
        for member in split_top_level(text[1:end]):
            kind, _, name = _split_param(member)
            members.append((name, kind))
        return _with_suffixes(AbiType("tuple", components=tuple(members)), text[end + 1 :].strip())
    cut = text.find("[")
    cut = len(text) if cut < 0 else cut
    return _with_suffixes(_elementary(text[:cut].strip()), text[cut:].replace(" ", ""))


def _split_param(text: str) -> tuple[AbiType, bool, str]:
    """type [indexed] [name]"""
    text = text.strip()
    start = len("tuple") if text.startswith("tuple(") else 0
    end = _closing(text, start) + 1 if text[start : start + 1] == "(" else 0
    while end < len(text) and not text[end].isspace():
        end += 1
    words = text[end:].split()
    indexed = "indexed" in words
    names = [w for w in words if w != "indexed"]
    if len(names) > 1 or (names and not _IDENT.match(names[0])):
        raise ValueError(f"malformed parameter {text!r}")
    return parse_type(text[:end]), indexed, names[0] if names else ""


def _abi_json_type(entry: dict) -> AbiType:
    kind = entry["type"]
    if not kind.startswith("tuple"):
        return parse_type(kind)
    members = tuple((c.get("name") or "", _abi_json_type(c)) for c in entry.get("components") or ())
    return _with_suffixes(AbiType("tuple", components=members), kind[len("tuple") :])


@dataclass(frozen=True)
class Param:
    name: str
    type: AbiType
    indexed: bool
    pos: int
    column: str

    @property
    def stored_as_topic_hash(self) -> bool:
        return self.indexed and (self.type.is_dynamic or self.type.is_composite)


@dataclass(frozen=True)
class EventDef:
    """One event: name and parameters in signature order."""

    name: str
    params: tuple[Param, ...]

    @staticmethod
    def build(name: str, inputs: list[tuple[str, AbiType, bool]]) -> EventDef:
        if not _IDENT.match(name or ""):
            raise ValueError(f"malformed event name {name!r}")
        columns = _column_names([n for n, _, _ in inputs])
        params = tuple(
            Param(n, t, indexed, i, columns[i]) for i, (n, t, indexed) in enumerate(inputs)
        )
        if sum(p.indexed for p in params) > 3:
            raise ValueError(f"event {name} has more than three indexed parameters")
        return EventDef(name, params)

    @staticmethod
    def parse(signature: str) -> EventDef:
        """`[event] Name(type [indexed] [name], ...)`"""
        text = signature.strip().rstrip(";").strip()
        if text.startswith("event "):
            text = text[len("event ") :].strip()
        start = text.find("(")
        if start < 0:
            raise ValueError(f"malformed event signature {signature!r}")
        end = _closing(text, start)
        if text[end + 1 :].strip():
            raise ValueError(f"unsupported event signature {signature!r}")
        inputs = []
        for part in split_top_level(text[start + 1 : end]):
            kind, indexed, name = _split_param(part)
            inputs.append((name, kind, indexed))
        return EventDef.build(text[:start].strip(), inputs)

    @staticmethod
    def from_abi(entry: dict) -> EventDef:
        """One entry of an ABI JSON file whose type is `event`."""
        return EventDef.build(
            entry["name"],
            [(i.get("name") or "", _abi_json_type(i), bool(i.get("indexed"))) for i in entry["inputs"]],
        )

    @cached_property
    def hash(self) -> str:
        """topic0 of the event's logs."""
        return event_hash(self.canonical)

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(p.type.canonical for p in self.params)})"

    @property
    def signature(self) -> str:
        """With parameter names and `indexed` marks; parses back to the same definition."""
        parts = []
        for p in self.params:
            parts.append(" ".join(x for x in (p.type.canonical, "indexed" * p.indexed, p.name) if x))
        return f"event {self.name}({', '.join(parts)})"

    @property
    def indexed(self) -> tuple[Param, ...]:
        return tuple(p for p in self.params if p.indexed)

    @property
    def body(self) -> tuple[Param, ...]:
        return tuple(p for p in self.params if not p.indexed)

    @property
    def stored(self) -> tuple[Param, ...]:
        """Parameters in column order of the event table."""
        return self.indexed + self.body

    @property
    def n_topics(self) -> int:
        return 1 + len(self.indexed)

    @property
    def body_head_bytes(self) -> int:
        return sum(p.type.head_bytes for p in self.body)

    def table_name(self, chain_id: int) -> str:
        return table_name(chain_id, self.name, self.hash)


def table_name(chain_id: int, name: str, hash_: str) -> str:
    return f"event_{chain_id}_{name.lower()}_{hash_[2:7]}"


def _column_names(names: list[str]) -> list[str]:
    """Column per parameter: unnamed, reserved and case-clashing names get a suffix."""
    out: list[str] = []
    for pos, name in enumerate(names):
        column = name or f"arg{pos}"
        if column.lower() in FIXED_COLUMNS or column.lower().endswith(KEY_SUFFIX):
            column += "_param"
        if column.lower() in (c.lower() for c in out):
            column = f"{column}_{pos}"
        out.append(column)
    return out
