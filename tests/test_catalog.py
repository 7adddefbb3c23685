import json

import pytest

from logweave.functions.abi_types import EventDef, parse_type
from logweave.functions.keccak import keccak256_many
from logweave.sources import catalog as C

# Signatures and the first digits of their event hash.
HASHES = {
    "Transfer(address indexed from, address indexed to, uint256 value)": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "Mint(address indexed minter, address indexed to, uint256 amount)": "ab853",
    "Burn(address indexed from, uint256 amount)": "cc16f",
    "Initialize(bytes32 indexed id, address indexed currency0, address indexed currency1, uint24 fee, int24 tickSpacing, address hooks, uint160 sqrtPriceX96, int24 tick)": "dd466",
    "ProposalCreated(uint256 indexed proposalId, address indexed creator, uint8 indexed accessLevel, bytes32 ipfsHash)": "cc914",
    "VotingActivated(uint256 indexed proposalId, bytes32 indexed snapshotBlockHash, uint24 votingDuration)": "45f1d",
    "ProposalQueued(uint256 indexed proposalId, uint128 votesFor, uint128 votesAgainst)": "e39e7",
    "ProposalFailed(uint256 indexed proposalId, uint128 votesFor, uint128 votesAgainst)": "2bed8",
    "ProposalExecuted(uint256 indexed proposalId)": "712ae",
    "ProposalCanceled(uint256 indexed proposalId)": "789cf",
    "PayloadSent(uint256 indexed proposalId, uint40 payloadId, address indexed payloadsController, uint256 indexed chainId, uint256 payloadNumberOnProposal, uint256 numberOfPayloadsOnProposal)": "9c687",
    "VoteForwarded(uint256 indexed proposalId, address indexed voter, bool indexed support, (address,uint128)[] votingAssetsWithSlot)": "f78ab",
}


def test_event_hashes():
    for signature, digits in HASHES.items():
        event = EventDef.parse(signature)
        assert event.hash[2:].startswith(digits)
        assert event.table_name(1) == f"event_1_{event.name.lower()}_{digits[:5]}"
        assert EventDef.parse(event.signature) == event


def test_keccak_of_empty_and_long_messages():
    # Fixed value: the well-known hash of the empty message.
    empty = "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    many = keccak256_many([b"", b"x" * 135, b"x" * 136, b"x" * 500, b""])
    assert many[0] == many[4] == empty
    assert many[1:4] == [keccak256_many([b"x" * n])[0] for n in (135, 136, 500)]


def test_indexed_parameters_come_first_in_tables():
    event = EventDef.parse("P(uint256 indexed a, uint40 b, address indexed c, uint256 d)")
    assert [p.column for p in event.stored] == ["a", "c", "b", "d"]


def test_column_names_never_clash():
    event = EventDef.parse("E(uint256, uint256 Block_Number, address a, address A, uint256 v__w)")
    columns = [p.column for p in event.stored]
    assert columns == ["arg0", "Block_Number_param", "a", "A_3", "v__w_param"]


@pytest.mark.parametrize("text", ["uint7", "int0", "bytes33", "uint256[", "foo", "address8", "uint256[0]"])
def test_bad_types(text):
    with pytest.raises(ValueError):
        parse_type(text)


@pytest.mark.parametrize("text", ["Transfer", "E(uint256", "E(uint256 a b)", "E(uint256 a) anonymous", "1E(uint256 a)"])
def test_bad_signatures(text):
    with pytest.raises(ValueError):
        EventDef.parse(text)


def test_aliases_and_tuples():
    event = EventDef.parse("event E(uint a, tuple(int x, bytes4[] y)[2] z)")
    assert event.canonical == "E(uint256,(int256,bytes4[])[2])"


def test_catalog_from_abi_file(spark, tmp_path):
    abi = [
        {"type": "function", "name": "f", "inputs": []},
        {
            "type": "event",
            "name": "Cut",
            "anonymous": False,
            "inputs": [
                {
                    "name": "cuts",
                    "type": "tuple[]",
                    "indexed": False,
                    "components": [
                        {"name": "facet", "type": "address"},
                        {"name": "action", "type": "uint8"},
                        {"name": "selectors", "type": "bytes4[]"},
                    ],
                },
                {"name": "init", "type": "address", "indexed": False},
            ],
        },
        {"type": "event", "name": "Paused", "inputs": [{"name": "account", "type": "address", "indexed": True}]},
        {"type": "event", "name": "Ghost", "anonymous": True, "inputs": []},
    ]
    path = tmp_path / "abi.json"
    path.write_text(json.dumps(abi, indent=2))
    catalog = C.catalog_from_abi(spark, 5, str(path))
    assert {e.canonical for e in catalog.events} == {"Cut((address,uint8,bytes4[])[],address)", "Paused(address)"}
    rows = C.parse_abi_entries(C.abi_entries(spark, 5, str(path))).collect()
    assert {(r.event_hash, r.table_name) for r in rows} == {(e.hash, e.table_name(5)) for e in catalog.events}
    assert catalog.frame(spark).count() == 2


def test_repeats_are_merged():
    catalog = C.Catalog.of(1, ["A(uint256 x)", "event A(uint256 x)"])
    assert len(catalog.events) == 1
