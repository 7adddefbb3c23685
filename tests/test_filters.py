import pytest

from logweave.functions.abi_types import EventDef
from logweave.operators import filters as Fi
from logweave.operators import routing as R
from logweave.plans.jobs import Job, job_logs, run_jobs, validate_job
from logweave.sources import logs as L
from logweave.sources.catalog import Catalog
from tests.abi_codec import frame, log

TRANSFER = EventDef.parse("Transfer(address indexed from, address indexed to, uint256 value)")
APPROVAL = EventDef.parse("Approval(address indexed owner, address indexed spender, uint256 value)")


def account(n: int) -> str:
    return f"0x{n:040x}"


@pytest.fixture(scope="module")
def transfers(spark):
    pairs = [(a, b) for a in (1, 2, 3) for b in (10, 11) for _ in range(a)]
    return frame(spark, [log(TRANSFER, [account(a), account(b), i], block=i + 1, index=i) for i, (a, b) in enumerate(pairs)])


def count(logs, filters):
    return Fi.by_params(logs, TRANSFER, filters).count()


def test_or_within_a_key_and_across_keys(transfers):
    assert count(transfers, None) == 12
    assert count(transfers, {"from": [account(1)]}) == 2
    assert count(transfers, {"from": [account(1), account(3)]}) == 8
    assert count(transfers, {"from": [account(1), account(3)], "to": [account(11)]}) == 4
    assert count(transfers, {"from": account(2)}) == 4
    assert count(transfers, {"from": []}) == 12


def test_unreadable_values(transfers):
    assert count(transfers, {"from": ["junk", account(1)]}) == 2
    assert count(transfers, {"from": ["junk"]}) == 12
    with pytest.raises(ValueError):
        Fi.by_params(transfers, TRANSFER, {"from": ["junk"]}, on_invalid="error")


def test_many_values_become_a_join(transfers, monkeypatch):
    monkeypatch.setattr(Fi, "MAX_INLINE_VALUES", 1)
    assert count(transfers, {"from": [account(1), account(3)], "to": [account(11)]}) == 4
    assert Fi.by_events(transfers, [TRANSFER, APPROVAL]).count() == 12


def test_filter_errors():
    with pytest.raises(ValueError, match="non-indexed"):
        Fi.topic_filters(TRANSFER, {"value": ["0x1"]})
    with pytest.raises(ValueError, match="does not match"):
        Fi.topic_filters(TRANSFER, {"sender": ["0x1"]})
    with pytest.raises(ValueError, match="job of its own"):
        validate_job(Job("j", Catalog.of(1, [TRANSFER, APPROVAL]), filters={"Transfer": {"from": ["0x1"]}}))
    with pytest.raises(ValueError):
        validate_job(Job("j", Catalog.of(1, [])))


def test_topic_values():
    address = "A0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48"
    padded = "0x" + "0" * 24 + address.lower()
    assert Fi.topic_value("0x" + address) == Fi.topic_value(address) == Fi.topic_value("0x" + "0" * 24 + address) == padded
    assert Fi.topic_value("0x1") == "0x" + "0" * 63 + "1"
    for bad in ("xyz", "0x" + "1" * 65):
        with pytest.raises(ValueError):
            Fi.topic_value(bad)


def test_contract_and_ranges(spark, transfers):
    assert Fi.by_contract(transfers, "0x" + "AB" * 20).count() == 12
    assert Fi.by_contract(transfers, account(5)).count() == 0
    assert Fi.by_contract(transfers, None).count() == 12
    assert L.block_range(transfers, 3, 5).count() == 3
    assert L.until_head(transfers, 4).count() == 4
    assert L.until_head(transfers, spark.createDataFrame([(4,)], "head long")).count() == 4


def test_chunk_plan_covers_every_block_once(spark, transfers):
    plan = L.chunk_plan(spark, 1, 23, 5)
    assert [tuple(r) for r in plan.orderBy("chunk_start").collect()] == [(1, 5), (6, 10), (11, 15), (16, 20), (21, 23)]
    counts = {r.chunk_start: r.log_count for r in L.chunk_counts(transfers, plan, 1, 5).collect()}
    assert counts == {1: 5, 6: 5, 11: 2, 16: 0, 21: 0}
    assert L.chunk_plan(spark, 5, 4, 10).count() == 0


def test_staged_logs_prune_and_push_down(spark, transfers, tmp_path):
    path = str(tmp_path / "staged")
    L.stage_logs(transfers, path, bucket_blocks=4)
    staged = L.read_logs(spark, path, "parquet")
    rows = R.decode(L.block_range(staged, 5, 7, bucket_blocks=4), TRANSFER)
    assert rows.count() == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan
    assert f"EqualTo(topic0,{TRANSFER.hash})" in plan


def test_jobs_run_apart_and_join_their_tables(spark, transfers):
    only = Job("a", Catalog.of(1, [TRANSFER]), filters={"Transfer": {"from": [account(1)]}}, start_block=2)
    both = Job("b", Catalog.of(1, [TRANSFER, APPROVAL]))
    tables = run_jobs({"a": transfers, "b": transfers}, [only, both])
    got = tables[only.catalog.table("Transfer")].groupBy("job_id").count().collect()
    assert {r.job_id: r["count"] for r in got} == {"a": 1, "b": 12}
    assert job_logs(transfers, only, head=1).count() == 0
    with pytest.raises(ValueError):
        run_jobs({"a": transfers}, [only, only])
