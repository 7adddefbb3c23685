"""Packed rows of many events against the tables that `decode` gives, and how often logs are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweave.operators import packed as P
from logweave.operators.routing import decode
from logweave.plans.dataset import index_batch, stage_batch
from logweave.schema import EVENT_CATALOG
from logweave.sources import logs as L
from logweave.sources.catalog import Catalog
from tests.abi_codec import frame, log
from tests.test_filters import account
from workload import adapters as Z

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [False, True])
def test_packed_rows_are_the_tables(spark, keys):
    catalog = Catalog.of(1, [*Z.TOKEN_CATALOG.events, *Z.GOVERNANCE_CATALOG.events, Z.POSTED, Z.DELTA, Z.READING])
    logs = Z.token_logs(spark, SF).unionByName(Z.proposal_logs(spark, SF)).unionByName(Z.vote_logs(spark, SF).limit(500)).unionByName(Z.document_logs(spark, SF))
    logs = logs.persist()
    as_frame = spark.createDataFrame(catalog.frame(spark).collect(), EVENT_CATALOG)
    for source in (catalog, as_frame):
        rows = P.decode_packed(logs, source, keys).persist()
        for name, event in catalog.tables.items():
            same(P.unpack(rows.where(F.col("table_name") == name), event, keys), decode(logs, event, keys=keys))
    logs.unpersist()


def test_logs_that_do_not_fit_are_left_out(spark):
    event = "Noted(address indexed who, string note, uint8[] marks)"
    catalog = Catalog.of(1, [event, "Bare(uint256 indexed id)", "Pair((uint8,bool) indexed p, int16 n)"])
    noted, bare, pair = catalog.events
    good = [log(noted, [account(1), "hé", [1, 2]], block=1), log(bare, [7], block=2), log(pair, ["ab" * 32, -5], block=3)]
    bad = [dict(g) for g in good]
    bad[0] |= {"data": good[0]["data"][:100], "block_number": 11}
    bad[1] |= {"topics": [good[1]["topics"][0], "0x12"], "block_number": 12}
    bad[2] |= {"data": "0xzz" + good[2]["data"][4:], "block_number": 13}
    extra = dict(good[1]) | {"topics": [*good[1]["topics"], good[1]["topics"][1]], "block_number": 14}
    odd_body = dict(good[1]) | {"data": "0x123", "block_number": 4}
    logs = frame(spark, [*good, *bad, extra, odd_body])
    rows = P.decode_packed(logs, catalog)
    assert sorted(r.block_number for r in rows.collect()) == [1, 2, 3, 4]
    for name, e in catalog.tables.items():
        same(P.unpack(rows.where(F.col("table_name") == name), e), decode(logs, e))
    assert P.decode_packed(logs.limit(0), catalog).count() == 0


def test_one_scan_for_many_events(spark, tmp_path):
    """36 events, and the logs are read once; the plan has one branch a type, not one an event."""
    events = [f"E{i}(address indexed a, uint{8 * (i % 32 + 1)} b, string c)" for i in range(36)]
    L.stage_logs(Z.token_logs(spark, SF), str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    few, many = (P.decode_packed(logs, Catalog.of(1, [*Z.TOKEN_CATALOG.events, *more])) for more in ([], events))
    assert plan(many).count("FileScan") == 1
    assert len(plan(many)) < 2 * len(plan(few)) + 20_000
    assert many.count() == few.count() > 0


def test_types_of_a_catalogue_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_TYPES", 1)
    with pytest.raises(ValueError, match="types"):
        P.decode_packed(Z.token_logs(spark, SF), Z.TOKEN_CATALOG.frame(spark))


def test_a_staged_batch_is_the_batch(spark, tmp_path):
    logs = Z.token_logs(spark, SF)
    for i, options in enumerate(({}, {"processed_to": 10**6}, {"keys": True})):
        one, two = index_batch(logs, Z.TOKEN_CATALOG, start_block=1, **options), stage_batch(logs, Z.TOKEN_CATALOG, str(tmp_path / str(i)), start_block=1, **options)
        same(one.registry, two.registry)
        same(one.list_events(), two.list_events())
        same(one.list_contracts(), two.list_contracts())
        same(one.blocks, two.blocks)
        for name in one.tables:
            same(one.tables[name], two.tables[name])
        for name in two.tables:
            assert plan(two.tables[name]).count("FileScan") == 1


def test_a_staged_batch_takes_less_room_than_its_logs(spark, tmp_path):
    """Raw logs are not kept beside their rows; logs without a row still count for blocks and progress."""
    mint, burn = (Z.TOKEN_CATALOG.event(n) for n in ("Mint", "Burn"))
    odd = [log(mint, [account(1), 5], block=2_000_000 + i) for i in range(8)] + [log(burn, [account(2), 6], block=2_000_010)]
    odd[1] |= {"block_number": None}
    odd[2] |= {"removed": True}
    odd[3] |= {"data": "0x12"}
    odd[4] |= {"topics": odd[4]["topics"] * 2}
    odd[5] |= {"topics": ["0x" + "77" * 32]}
    odd[6] |= {"topics": []}
    odd[7] |= {"transaction_hash": None}
    catalog = Catalog.of(1, [mint, burn, Z.VOTE, Z.PAYLOAD])
    logs = frame(spark, odd).unionByName(Z.vote_logs(spark, SF)).coalesce(1)
    one, two = index_batch(logs, catalog, start_block=1), stage_batch(logs, catalog, str(tmp_path / "batch"), start_block=1)
    for a, b in ((one.registry, two.registry), (one.list_events(), two.list_events()), (one.list_contracts(), two.list_contracts()), (one.blocks, two.blocks), *((one.tables[n], two.tables[n]) for n in one.tables)):
        same(a, b)
    L.stage_logs(logs, str(tmp_path / "logs"), partitions=1)
    size = lambda at: sum(p.stat().st_size for p in (tmp_path / at).rglob("*.parquet"))
    assert size("batch") < size("logs")


def test_a_large_catalogue_frame_is_not_broadcast(spark, monkeypatch):
    """Its events are counted; the size that Spark guesses from files says nothing."""
    from logweave.sources.catalog import parse_abi_entries
    from workload.queries import part_abi_entries

    catalog = parse_abi_entries(part_abi_entries(spark, SF))
    logs = Z.part_logs(spark, SF, catalog)
    assert "BroadcastExchange" not in plan(logs)
    bare = catalog.limit(0)
    few, none = P.decode_packed(logs, catalog), P.decode_packed(logs, bare)
    assert "BroadcastExchange" in plan(few) and none.count() == 0
    monkeypatch.setattr(P, "MAX_BROADCAST_EVENTS", 5)
    many = P.decode_packed(logs, catalog)
    assert "BroadcastExchange" not in plan(many)
    same(few, many)
