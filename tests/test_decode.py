import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.abi_types import EventDef, parse_type
from logweave.operators import routing as R
from logweave.operators.registry import event_schema
from logweave.sources.catalog import Catalog
from tests.abi_codec import encode_tuple, frame, log, show, word

ADDRESS = "0xabcdef1234567890abcdef1234567890abcdef12"
# Solidity types with an input and the text that must be stored.
MATRIX = [
    ("address indexed addr", ADDRESS, ADDRESS),
    ("address addr", ADDRESS, ADDRESS),
    ("bool flag", True, "true"),
    ("bool flag", False, "false"),
    ("uint256 value", 12345, "12345"),
    ("uint128 value", 255, "255"),
    ("uint64 value", 0xDEADBEEF, "3735928559"),
    ("uint32 value", 1000000, "1000000"),
    ("uint16 value", 65535, "65535"),
    ("uint8 value", 255, "255"),
    ("int256 value", -1, "-1"),
    ("int256 value", 123, "123"),
    ("int128 value", -123, "-123"),
    ("int64 value", -2, "-2"),
    ("int32 value", -42, "-42"),
    ("int16 value", -100, "-100"),
    ("int8 value", -1, "-1"),
    ("bytes32 data", "0xdeadbeef" + "0" * 55 + "1", "0xdeadbeef" + "0" * 55 + "1"),
    ("bytes16 data", "0xdeadbeefcafebabe1234567800000000", "0xdeadbeefcafebabe1234567800000000"),
    ("bytes8 data", "0xdeadbeefcafebabe", "0xdeadbeefcafebabe"),
    ("bytes4 data", "0xdeadbeef", "0xdeadbeef"),
    ("bytes1 data", "0xab", "0xab"),
    ("bytes data", bytes.fromhex("deadbeef"), "0xdeadbeef"),
    ("string message", "hello", "hello"),
    ("uint256 indexed value", 0xBEEF, "48879"),
    ("address indexed addr", "0x" + "00" * 18 + "beef", "0x" + "00" * 18 + "beef"),
    ("function indexed callback", "0x" + "cd" * 24, "0x" + "cd" * 24),
    ("string indexed message", "ab" * 32, "0x" + "ab" * 32),
    ("uint256[] indexed values", "12" * 32, "0x" + "12" * 32),
]


def test_type_matrix(spark):
    for param, value, expected in MATRIX:
        event = EventDef.parse(f"event Test({param})")
        rows = R.decode(frame(spark, [log(event, [value])]), event)
        assert rows.columns == [f.name for f in event_schema(event)]
        assert rows.collect()[0][4] == expected, param


def random_value(kind, rnd, depth=0):
    if kind.kind == "uint":
        return rnd.getrandbits(rnd.randint(1, kind.size))
    if kind.kind == "int":
        return rnd.getrandbits(kind.size) - (1 << (kind.size - 1))
    if kind.kind == "bool":
        return rnd.random() < 0.5
    if kind.kind == "address":
        return "0x" + rnd.randbytes(20).hex()
    if kind.kind == "fixed_bytes":
        return "0x" + rnd.randbytes(kind.size).hex()
    if kind.kind == "bytes":
        return rnd.randbytes(rnd.choice([0, 1, 31, 32, 33, 100]))
    if kind.kind == "string":
        return "".join(rnd.choice("aé漢z ,") for _ in range(rnd.choice([0, 1, 20, 70])))
    if kind.kind == "array":
        n = rnd.randint(0, 3) if kind.length is None else kind.length
        return [random_value(kind.element, rnd, depth + 1) for _ in range(n)]
    return tuple(random_value(t, rnd, depth + 1) for _, t in kind.components)


@pytest.mark.parametrize(
    "types",
    [
        "uint256[],string,int128,bytes",
        "(address,uint128)[],bool,uint8[3],(bytes4,uint256)",
        "string[],(string,uint256[])[],bytes32",
        "(address,uint8,bytes4[])[],address,bytes",
        "uint16[2][],(int256,(string,bool))[2]",
    ],
)
def test_nested_types_round_trip(spark, types):
    from logweave.functions.abi_types import split_top_level

    kinds = [parse_type(t) for t in split_top_level(types)]
    event = EventDef.parse(f"Test({', '.join(f'{t} p{i}' for i, t in enumerate(split_top_level(types)))})")
    rnd = random.Random(types)
    cases = [[random_value(k, rnd) for k in kinds] for _ in range(25)]
    logs = frame(spark, [log(event, case, block=i) for i, case in enumerate(cases)])
    for r in R.decode(logs, event).collect():
        expected = [show(k, v) for k, v in zip(kinds, cases[r.block_number])]
        assert list(r)[4:] == expected
    nested = R.decode(logs, event, nested=True)
    assert nested.count() == len(cases)
    # Any cut or changed word is either decoded or quarantined, never lost and never an error.
    damaged = []
    for i, case in enumerate(cases):
        data = log(event, case)["data"]
        at = 2 + 64 * rnd.randrange(max(1, len(data) // 64))
        broken = data[:at] + word(rnd.choice([2**255, 10**6, 31])) + data[at + 64 :] if i % 2 else data[: at + 10]
        damaged.append(log(event, case, block=i, data=broken))
    bad = frame(spark, damaged)
    assert R.decode(bad, event).count() + R.quarantine(bad, event).count() == len(damaged)


def test_bad_utf8_offset_and_hex_go_to_quarantine(spark):
    event = EventDef.parse("Note(uint256 indexed id, string text)")
    good = log(event, [1, "fine"])
    bad_utf8 = log(event, [2, "x"], index=1, data="0x" + word(32) + word(1) + "ff" + "0" * 62)
    bad_offset = log(event, [3, "x"], index=2, data="0x" + "f" * 64 + word(0))
    too_long = log(event, [4, "x"], index=3, data="0x" + word(32) + word(33) + "00" * 32)
    not_hex = log(event, [5, "x"], index=4, data="0x" + "zz" * 64)
    short = log(event, [6, "x"], index=5, data="0x")
    bad_topic = log(event, [7, "x"], index=6, topics=[event.hash, "0x12"])
    logs = frame(spark, [good, bad_utf8, bad_offset, too_long, not_hex, short, bad_topic])
    assert [r.text for r in R.decode(logs, event).collect()] == ["fine"]
    assert R.quarantine(logs, event).count() == 6
    with pytest.raises(R.UndecodableLogError):
        R.decode(logs, event, on_error="fail")


def test_non_hex_static_body(spark):
    event = EventDef.parse("Mint(address indexed to, uint256 amount)")
    logs = frame(spark, [log(event, [ADDRESS, 5]), log(event, [ADDRESS, 5], index=1, data="0x" + "zz" * 32)])
    assert [r.amount for r in R.decode(logs, event).collect()] == ["5"]
    assert R.quarantine(logs, event).count() == 1


TRANSFER = EventDef.parse("Transfer(address indexed from, address indexed to, uint256 value)")
NFT = EventDef.parse("Transfer(address indexed from, address indexed to, uint256 indexed tokenId)")
APPROVAL = EventDef.parse("Approval(address indexed owner, address indexed spender, uint256 value)")


def test_topic_count_tells_events_apart(spark):
    logs = frame(spark, [log(TRANSFER, [ADDRESS, ADDRESS, 9]), log(NFT, [ADDRESS, ADDRESS, 9], index=1)])
    assert R.decode(logs, TRANSFER).count() == 1
    assert R.wrong_arity(logs, TRANSFER).count() == 1


def test_strict_and_lenient(spark):
    catalog = Catalog.of(1, [TRANSFER])
    mixed = frame(spark, [log(TRANSFER if i % 2 == 0 else APPROVAL, [ADDRESS, ADDRESS, i], index=i) for i in range(7)])
    assert R.decode_all(mixed, catalog)[catalog.table("Transfer")].count() == 4
    assert R.unknown_events(mixed, catalog).collect()[0].log_count == 3
    with pytest.raises(R.UnknownEventError):
        R.decode_all(mixed, catalog, strict=True)


def test_malformed_and_removed_logs_are_dropped(spark):
    full = [ADDRESS, ADDRESS, 1]
    logs = frame(
        spark,
        [
            log(TRANSFER, full),
            log(TRANSFER, full, block_number=None),
            log(TRANSFER, full, topics=[]),
            log(TRANSFER, full, transaction_hash=None),
            log(TRANSFER, full, removed=True),
        ],
    )
    assert R.well_formed(logs).count() == 1
    assert R.malformed(logs).count() == 4


def test_mixed_case_logs_come_out_lower_case(spark):
    from logweave.sources.logs import normalise_logs, to_json_records

    one = log(TRANSFER, [ADDRESS, ADDRESS, 1], address="0xABCDEF" + "0" * 34)
    records = to_json_records(frame(spark, [one]))
    back = normalise_logs(records.withColumn("data", F.upper("data")).withColumn("data", F.regexp_replace("data", "^0X", "0x")))
    row = R.decode(back, TRANSFER).collect()[0]
    assert row.contract_address == "0xabcdef" + "0" * 34 and row.value == "1"


def test_encoder_agrees_with_known_body():
    kinds = [parse_type("uint256"), parse_type("string")]
    assert encode_tuple(kinds, [1, "a"]) == word(1) + word(64) + word(1) + "61" + "0" * 62
