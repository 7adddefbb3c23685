"""32-byte ABI words as 64 lower-case hex digits: to and from text, and order keys.

Integers are turned into decimal text with built-in functions only. Three cases keep the
common ones cheap: up to 60 bits is one `conv`, up to 120 bits is one decimal product, and
only larger values pay for the five-limb conversion.

Functions on words take and give SQL text: one wide event is thousands of expression nodes,
and parsing them in one call is far quicker than building them one by one from Python.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMB_BITS = 60
_BASE = 10**18
_HEX = "0123456789abcdef"
_names = count()


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and use it several times in `body`."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(array: str, body: Callable[[str], str]) -> str:
    """Apply `body` to every element."""
    name = f"v{next(_names)}"
    return f"transform({array}, {name} -> {body(name)})"


def _base_digits(value: int) -> list[int]:
    digits = []
    while value:
        value, digit = divmod(value, _BASE)
        digits.append(digit)
    return digits


_LIMB_WEIGHTS = [_base_digits(1 << (_LIMB_BITS * i)) for i in range(5)]


def _limb(word: str, i: int) -> str:
    """The i-th 60-bit piece from the right, as bigint."""
    start, width = (50 - 15 * i, 15) if i < 4 else (1, 4)
    return f"cast(conv(substring({word}, {start}, {width}), 16, 10) as bigint)"


def _dec(expression: str) -> str:
    return f"cast({expression} as decimal(19,0))"


def _wide_text(word: str, plus: int) -> str:
    limbs = "array(" + ", ".join(_dec(_limb(word, i)) for i in range(5)) + ")"

    def total(ls: str, digit: int, carry: str) -> str:
        terms = [carry] + [
            f"{ls}[{i}] * {weights[digit]}BD" for i, weights in enumerate(_LIMB_WEIGHTS) if digit < len(weights)
        ]
        return f"lpad(cast({' + '.join(terms)} as string), 38, '0')"

    def step(ls: str, digit: int, text: str, tail: str) -> str:
        # 38 digits hold one base-10^18 digit on the right and the carry on the left.
        if digit == len(_LIMB_WEIGHTS) - 1:
            return f"concat({text}, {tail})"
        carry = _dec(f"cast(substring({text}, 1, 20) as bigint)")
        rest = f"concat(substring({text}, 21, 18), {tail})"
        return let(total(ls, digit + 1, carry), lambda t: step(ls, digit + 1, t, rest))

    text = let(limbs, lambda ls: let(total(ls, 0, _dec(str(plus))), lambda t: step(ls, 0, t, "''")))
    return f"ltrim('0', {text})"


def _unsigned(word: str, plus: int) -> str:
    small = f"conv(substring({word}, 50, 15), 16, 10)"
    if plus:
        small = f"cast(cast({small} as bigint) + {plus} as string)"
    middle = f"{_dec(_limb(word, 1))} * {1 << _LIMB_BITS}BD + {_dec(_limb(word, 0))} + {plus}BD"
    return (
        f"CASE WHEN substring({word}, 1, 49) = '{'0' * 49}' THEN {small} "
        f"WHEN substring({word}, 1, 34) = '{'0' * 34}' THEN cast({middle} as string) "
        f"ELSE {_wide_text(word, plus)} END"
    )


def uint_text(word: str) -> str:
    """Unsigned word -> decimal digits."""
    return _unsigned(word, 0)


def int_text(word: str) -> str:
    """Two's complement word -> signed decimal digits."""
    inverted = f"translate({word}, '{_HEX}', '{_HEX[::-1]}')"
    negative = let(inverted, lambda w: _unsigned(w, 1))
    return f"CASE WHEN substring({word}, 1, 1) < '8' THEN {_unsigned(word, 0)} ELSE concat('-', {negative}) END"


def address_text(word: str) -> str:
    return f"concat('0x', substring({word}, 25, 40))"


def bool_text(word: str) -> str:
    return f"CASE WHEN {word} = '{'0' * 64}' THEN 'false' WHEN {word} IS NOT NULL THEN 'true' END"


def left_bytes_text(word: str, size: int) -> str:
    return f"concat('0x', substring({word}, 1, {2 * size}))"


def uint_key(word: Column) -> Column:
    """Strings that sort as the unsigned values do: the word itself."""
    return word


def int_key(word: Column) -> Column:
    """Flip the sign bit, so that negative words sort first."""
    flipped = F.translate(F.substring(word, 1, 1), _HEX, _HEX[8:] + _HEX[:8])
    return F.concat(flipped, F.substring(word, 2, 63))


def key_literal(value: int, signed: bool) -> str:
    """The key of a Python int, to compare with `uint_key` / `int_key`."""
    return f"{value + (1 << 255) if signed else value:064x}"


def decimal_key(text: Column) -> Column:
    """Order key of canonical decimal text, for tables that carry no word key."""
    digits = F.ltrim(text, F.lit("-"))
    return F.when(
        text.startswith("-"),
        F.concat(
            F.lit("0"),
            F.lpad((F.lit(99) - F.length(digits)).cast("string"), 2, "0"),
            F.translate(digits, "0123456789", "9876543210"),
        ),
    ).otherwise(F.concat(F.lit("1"), F.lpad(F.length(text).cast("string"), 2, "0"), text))


def decimal_key_literal(value: int) -> str:
    digits = str(abs(value))
    if value >= 0:
        return f"1{len(digits):02d}{digits}"
    return f"0{99 - len(digits):02d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def quantity(text: Column) -> Column:
    """0x-hex quantity -> bigint; NULL where it is missing or not a quantity."""
    digits = F.lower(F.regexp_extract(text, r"^0[xX]0*([0-9a-fA-F]{1,16})$", 1))
    return F.when(digits != "", F.conv(digits, 16, 10)).try_cast("bigint")


def hex_to_bytes(text: Column) -> Column:
    """0x-hex text -> binary; NULL where it is not hex or has an odd number of digits."""
    digits = F.substring(text, 3, 2**31 - 1)
    return F.when(F.length(text) % 2 == 0, F.unhex(digits))


def bytes_to_hex(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def topic_word(topic: Column) -> Column:
    """The 64 digits of a topic; NULL where the topic is not 32 bytes of hex."""
    digits = F.substring(topic, 3, 64)
    return F.when((F.length(topic) == 66) & F.unhex(digits).isNotNull(), digits)


def address_topic(address: Column) -> Column:
    """An address as it stands in a topic."""
    digits = F.regexp_replace(F.lower(address), "^0x", "")
    return F.concat(F.lit("0x"), F.lpad(digits, 64, "0"))


def topic_value(text: Column) -> Column:
    """Left-pad hex text to a 32-byte topic; NULL where it is not hex or is too long."""
    digits = F.lower(F.regexp_replace(text, "^0x", ""))
    return F.when(digits.rlike("^[0-9a-f]{0,64}$"), F.concat(F.lit("0x"), F.lpad(digits, 64, "0")))
