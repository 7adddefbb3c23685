"""ABI decoding as SQL expressions.

The type tree is walked once, when the plan is built. A log body is binary, so that the
word at any offset is reached directly however long the body is. A value that does not
fit its body (bad offset, bad length, bad UTF-8) becomes NULL, never an error.
"""

from __future__ import annotations

from . import words as W
from .abi_types import AbiType
from .words import each, let


def word_text(kind: AbiType, word: str) -> str:
    """Text of a one-word type."""
    if kind.kind == "uint":
        return W.uint_text(word)
    if kind.kind == "int":
        return W.int_text(word)
    if kind.kind == "address":
        return W.address_text(word)
    if kind.kind == "bool":
        return W.bool_text(word)
    if kind.kind == "function":
        return W.left_bytes_text(word, 24)
    if kind.kind == "fixed_bytes":
        return W.left_bytes_text(word, kind.size)
    raise ValueError(f"{kind.canonical} is not a one-word type")


def _size_at(body: str, pos: str) -> str:
    """An offset or length word as int; NULL if it exceeds the body."""
    low = f"cast(conv(hex(substring({body}, {pos} + 29, 4)), 16, 10) as bigint)"
    return (
        f"CASE WHEN substring({body}, {pos} + 1, 28) = X'{'00' * 28}' AND {low} <= length({body}) "
        f"THEN cast({low} as int) END"
    )


def _packed(body: str, start: str) -> str:
    """Length-prefixed bytes."""
    return let(
        _size_at(body, start),
        lambda n: f"CASE WHEN {start} + 32 + {n} <= length({body}) THEN substring({body}, {start} + 33, {n}) END",
    )


def member_names(kind: AbiType) -> list[str]:
    return [name or f"f{i}" for i, (name, _) in enumerate(kind.components)]


def _tuple(kind: AbiType, values: list[str], as_text: bool) -> str:
    if as_text:
        return f"concat('(', {", ',', ".join(values)}, ')')"
    pairs = [f"'{name}', {value}" for name, value in zip(member_names(kind), values)]
    return f"named_struct({', '.join(pairs)})"


def _array(kind: AbiType, values: str, as_text: bool) -> str:
    if not as_text:
        return values
    if not kind.element.is_dynamic:
        return f"concat('[', array_join({values}, ','), ']')"
    # array_join skips NULLs, so an element that does not decode must be looked for.
    return let(
        values, lambda v: f"CASE WHEN forall({v}, x -> x IS NOT NULL) THEN concat('[', array_join({v}, ','), ']') END"
    )


def _static(kind: AbiType, digits: str, at: int, as_text: bool) -> str:
    """Value of a static type within the hex digits of its head, from word `at` on."""
    if kind.kind == "tuple":
        values = []
        for _, member in kind.components:
            values.append(_static(member, digits, at, as_text))
            at += member.head_bytes // 32
        return _tuple(kind, values, as_text)
    if kind.kind == "array":
        width = 2 * kind.element.head_bytes
        values = each(
            f"sequence(0, {kind.length - 1})",
            lambda i: let(
                f"substring({digits}, {64 * at + 1} + {i} * {width}, {width})",
                lambda h: _static(kind.element, h, 0, as_text),
            ),
        )
        return _array(kind, values, as_text)
    return let(f"substring({digits}, {64 * at + 1}, 64)", lambda w: word_text(kind, w))


def _head_digits(kind: AbiType, body: str, pos: str) -> str:
    return f"lower(hex(substring({body}, {pos} + 1, {kind.head_bytes})))"


def _elements(kind: AbiType, body: str, base: str, size: str, as_text: bool) -> str:
    element, step = kind.element, kind.element.head_bytes
    # sequence(0, -1) would count down, so take one element too many and cut it off.
    positions = f"slice(sequence(0, {size}), 1, {size})"

    def item(i: str) -> str:
        pos = f"({base} + {i} * {step})"
        if element.is_dynamic:
            return value_at(element, body, pos, base, as_text)
        return let(_head_digits(element, body, pos), lambda h: _static(element, h, 0, as_text))

    values = _array(kind, each(positions, item), as_text)
    return f"CASE WHEN {base} + {size} * {step} <= length({body}) THEN {values} END"


def _members(kind: AbiType, body: str, start: str, as_text: bool) -> str:
    values, at = [], 0
    for _, member in kind.components:
        values.append(value_at(member, body, f"({start} + {at})", start, as_text))
        at += member.head_bytes
    return _tuple(kind, values, as_text)


def value_at(kind: AbiType, body: str, pos: str, base: str, as_text: bool) -> str:
    """Value whose head stands at `pos` of a tuple that begins at `base`.

    Arrays and tuples come out as text, [a,b] and (a,b), or as arrays and structs with
    text leaves."""
    if not kind.is_dynamic:
        return let(
            _head_digits(kind, body, pos),
            lambda h: f"CASE WHEN length({h}) = {2 * kind.head_bytes} THEN {_static(kind, h, 0, as_text)} END",
        )

    def at(start: str) -> str:
        if kind.kind == "bytes":
            return f"concat('0x', lower(hex({_packed(body, start)})))"
        if kind.kind == "string":
            return f"try_validate_utf8(cast({_packed(body, start)} as string))"
        if kind.kind == "tuple":
            return _members(kind, body, start, as_text)
        if kind.length is not None:
            return _elements(kind, body, start, str(kind.length), as_text)
        return let(
            _size_at(body, start),
            lambda n: let(f"{start} + 32", lambda b: _elements(kind, body, b, n, as_text)),
        )

    return let(f"({_size_at(body, pos)}) + {base}", at)
