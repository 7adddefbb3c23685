import random

import pytest

from logweave.operators import dedupe as K
from logweave.operators import frontier
from logweave.operators import registry as Re
from logweave.plans.dataset import index_batch
from logweave.sources.catalog import Catalog
from tests.abi_codec import frame, log
from tests.test_filters import APPROVAL, TRANSFER, account

CATALOG = Catalog.of(1, [TRANSFER, APPROVAL])
HASHES = CATALOG.hashes


def state(registry):
    return {r.event_hash: (r.first_block, r.last_block) for r in registry.collect()}


@pytest.fixture(scope="module")
def registered(spark):
    return Re.register(Re.empty_registry(spark), CATALOG.frame(spark))


def test_registration_is_idempotent(spark, registered):
    again = Re.register(registered, CATALOG.frame(spark))
    assert again.count() == 2
    assert set(state(again).values()) == {(0, 0)}


def test_lookup_with_and_without_prefix(registered):
    for text in (TRANSFER.hash, TRANSFER.hash[2:]):
        assert [r[0] for r in Re.event_signature(registered, text).collect()] == [TRANSFER.signature]
    assert Re.lookup(registered, TRANSFER.hash, 2).count() == 0


def test_progress_moves_forward_only(registered):
    r = Re.set_first_block(registered, 1, HASHES, 10)
    r = Re.synchronize(r, 1, HASHES, 50)
    r = Re.synchronize(r, 1, [TRANSFER.hash], 80)
    r = Re.synchronize(r, 1, [APPROVAL.hash], 20)
    assert state(r) == {TRANSFER.hash: (10, 80), APPROVAL.hash: (10, 50)}
    assert Re.resume_block(r, 1, HASHES, 10).first()[0] == 51
    assert Re.resume_block(registered, 1, HASHES, 10).first()[0] == 10
    assert set(state(Re.synchronize(r, 1, HASHES)).values()) == {(10, 80)}
    assert state(Re.synchronize(r, 1, [])) == state(r)


def test_disjoint_events_are_refused(registered):
    Re.require_aligned(registered, 1, HASHES)
    with pytest.raises(Re.DisjointEventsError):
        Re.require_aligned(Re.set_first_block(registered, 1, [TRANSFER.hash], 5), 1, HASHES)


def test_listing_status_contracts_and_labels(spark):
    logs = frame(spark, [log(TRANSFER, [account(1), account(2), i], block=1000 + i, index=i) for i in range(3)])
    data = index_batch(logs, CATALOG, start_block=1000, processed_to=2000)
    listing = {r.event_name: r for r in Re.progress_label(data.list_events()).collect()}
    assert listing["Transfer"].event_count == 3 and listing["Approval"].event_count == 0
    assert listing["Transfer"].label == "1,000 → 2,000, 3 events"
    assert listing["Approval"].label == "1,000 → 2,000"
    assert data.event_status(TRANSFER).first().event_count == 3
    assert [r.contract_address for r in data.list_contracts().collect()] == ["0x" + "ab" * 20]
    assert [r[0] for r in Re.event_tables(data.describe()).collect()] == sorted(CATALOG.tables)
    fresh = index_batch(logs, CATALOG, start_block=0, processed_to=0)
    assert fresh.event_status(TRANSFER).first().event_count == 0
    assert {r.label for r in Re.progress_label(fresh.list_events()).collect()} == {"No block data yet"}
    shown = {r.table_name: r.columns for r in Re.schema_json(data.describe()).collect()}
    assert shown["blocks_1"] == '{"block_number":"bigint","block_hash":"string","block_timestamp":"bigint"}'
    assert "eventCount" in Re.to_api_listing(data.list_events()).columns
    unknown = index_batch(logs, Catalog.of(1, [APPROVAL]), processed_to=5)
    assert unknown.event_status(TRANSFER).count() == 0


def test_a_batch_is_listed_in_one_scan(spark, tmp_path):
    logs = frame(spark, [log(e, [account(1), account(2), i], block=i, index=i) for i, e in enumerate([TRANSFER, APPROVAL, TRANSFER], start=1)])
    logs.write.parquet(f"{tmp_path}/logs")
    data = index_batch(spark.read.parquet(f"{tmp_path}/logs"), CATALOG, start_block=1)
    for listed in (data.list_events(), data.list_contracts(), data.table_counts(), data.event_status(TRANSFER)):
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, plan
    assert {r.event_name: (r.last_block, r.event_count) for r in data.list_events().collect()} == {"Transfer": (3, 2), "Approval": (2, 1)}


def test_lag(spark, registered):
    r = Re.synchronize(registered, 1, HASHES, 50)
    jobs = spark.createDataFrame([(1, "0xa", h) for h in HASHES], "chain_id long, contract_address string, event_hash string")
    heads = spark.createDataFrame([(1, 60)], "chain_id long, head_block long")
    row = Re.indexing_lag(r, heads, jobs).first()
    assert (row.chain_head_block, row.indexed_block, row.lag) == (60, 50, 10)


def test_blocks_take_the_first_log(spark):
    logs = frame(
        spark,
        [
            log(TRANSFER, [account(1), account(2), 1], block=5, index=1, block_timestamp=9),
            log(TRANSFER, [account(1), account(2), 1], block=5, index=0, block_timestamp=None),
            log(TRANSFER, [account(1), account(2), 1], block=6, index=0, block_timestamp=7),
        ],
    )
    assert {r.block_number: r.block_timestamp for r in K.blocks_from_logs(logs).collect()} == {5: 0, 6: 7}


def test_inserts(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b")], "k long, v string")
    out = K.append_new(old, new, ["k"], ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]
    for batch in (new, new.where("v = 'x'")):
        with pytest.raises(K.DuplicateKeyError):
            K.append_new(old, batch, ["k"], on_conflict="error")
    assert K.append_new(old, new.where("v = 'b'"), ["k"], on_conflict="error").count() == 2


def brute_frontier(chunks, start):
    reached = start - 1
    for lo, hi in sorted(chunks):
        if lo > reached + 1:
            break
        reached = max(reached, hi)
    return reached


def test_frontier_against_brute_force(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    for job in range(30):
        start = rnd.randint(0, 50)
        chunks = [(start + 10 * i, start + 10 * i + 9) for i in range(40) if rnd.random() < rnd.choice([0.8, 0.97, 1.0])]
        chunks += rnd.sample(chunks, 3)
        rnd.shuffle(chunks)
        rows += [(f"j{job}", lo, hi) for lo, hi in chunks]
        expected[f"j{job}"] = (start, brute_frontier(chunks, start))
    expected["idle"] = (7, 6)
    chunks = spark.createDataFrame(rows, "job_id string, chunk_start long, chunk_end long")
    starts = spark.createDataFrame([(j, s) for j, (s, _) in expected.items()], "job_id string, start_block long")
    for span in (25, 1_000_000):
        got = {r.job_id: r.frontier for r in frontier.contiguous_frontier(chunks, starts, span).collect()}
        assert got == {j: f for j, (_, f) in expected.items()}


def test_max_block_per_event(spark):
    logs = frame(spark, [log(e, [account(1), account(2), 1], block=b, index=b) for e, b in ((TRANSFER, 3), (TRANSFER, 8), (APPROVAL, 5))])
    from logweave.operators.routing import route

    assert {r.event_hash: r.last_event_block for r in Re.max_block(route(logs, CATALOG)).collect()} == {TRANSFER.hash: 8, APPROVAL.hash: 5}
