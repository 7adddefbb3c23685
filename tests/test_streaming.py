import pytest
from pyspark.sql import functions as F

from logweave.operators.routing import UnknownEventError
from logweave.plans.jobs import Job
from logweave.sources import logs as L
from logweave.sources.catalog import Catalog
from logweave.sources.store import EventStore
from logweave.streaming.index import backfill, index_stream, next_block, observed
from tests.abi_codec import frame, log
from tests.test_filters import APPROVAL, TRANSFER, account

CATALOG = Catalog.of(1, [TRANSFER, APPROVAL])
TABLE = CATALOG.table("Transfer")


def transfer(n: int, **changes) -> dict:
    return log(TRANSFER, [account(1), account(2), n], block=n, index=n % 7, block_timestamp=n, **changes)


def dump(spark, records, path):
    L.to_json_records(frame(spark, records)).coalesce(1).write.mode("append").json(path)


def values(store):
    return sorted(int(r.value) for r in store.data(CATALOG).tables[TABLE].collect())


def test_stop_resume_and_replay(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    job = Job("j", CATALOG, start_block=1)

    def run():
        backfill(L.stream_logs(spark, source, max_files=1), job, store, checkpoint)

    dump(spark, [transfer(n) for n in range(1, 6)], source)
    run()
    assert values(store) == [1, 2, 3, 4, 5] and next_block(store, job) == 6
    run()
    assert store.last_commits() == {"j": 0}
    dump(spark, [transfer(n) for n in range(4, 9)], source)
    dump(spark, [transfer(n) for n in range(1, 3)], source)
    run()
    assert values(store) == list(range(1, 9)) and next_block(store, job) == 9
    data = store.data(CATALOG)
    assert data.blocks.count() == 8
    listing = {r.event_name: (r.first_block, r.last_block, r.event_count) for r in data.list_events().collect()}
    assert listing == {"Transfer": (1, 8, 8), "Approval": (1, 8, 0)}
    with pytest.raises(Exception, match="does not belong"):
        backfill(L.stream_logs(spark, source), job, store, str(tmp_path / "other-checkpoint"))
    assert values(store) == list(range(1, 9))


def test_a_batch_without_its_marker_is_invisible_and_replaced(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    job = Job("j", CATALOG)
    store.commit_batch(frame(spark, [transfer(1)]), job, 0)
    batch = frame(spark, [transfer(2), transfer(7)])
    monkeypatch.setattr(EventStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.commit_batch(batch, job, 1)
    assert values(store) == [1] and store.data(CATALOG).blocks.count() == 1
    monkeypatch.undo()
    store.commit_batch(batch, job, 1)
    assert values(store) == [1, 2, 7]
    store.commit_batch(batch, job, 1)
    assert values(store) == [1, 2, 7]


def test_jobs_share_a_table(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    a = Job("a", Catalog.of(1, [TRANSFER]), contract=account(5), start_block=1)
    b = Job("b", Catalog.of(1, [TRANSFER]), contract=account(6), start_block=3)
    store.commit_batch(frame(spark, [transfer(1, address=account(5))]), a, 0)
    store.commit_batch(frame(spark, [transfer(4, address=account(6)), transfer(1, address=account(5))]), b, 0, processed_to=20)
    assert values(store) == [1, 4]
    row = store.registry().first()
    assert (row.first_block, row.last_block) == (1, 20)
    assert next_block(store, a) == 2 and next_block(store, b) == 21


def test_a_store_is_opened_as_it_was_written(spark, tmp_path):
    path = str(tmp_path / "store")
    EventStore(spark, path, bucket_blocks=5).commit_batch(frame(spark, [transfer(1)]), Job("j", CATALOG), 0)
    for other in (EventStore(spark, path, bucket_blocks=6), EventStore(spark, path, bucket_blocks=5, keys=False)):
        with pytest.raises(ValueError, match="was written with"):
            other.data(CATALOG).tables[TABLE]


def test_empty_batches_still_move_progress(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    job = Job("j", CATALOG, start_block=5)
    assert next_block(store, job) == 5
    store.commit_batch(frame(spark, []), job, 0, processed_to=50)
    assert next_block(store, job) == 51 and values(store) == []


def test_strict_job_stores_nothing_of_a_bad_batch(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    job = Job("j", Catalog.of(1, [TRANSFER]), strict=True, from_abi=True)
    mixed = frame(spark, [transfer(1), log(APPROVAL, [account(1), account(2), 1], block=2)])
    with pytest.raises(UnknownEventError):
        store.commit_batch(mixed, job, 0)
    assert store.last_commits() == {}


def test_filters_and_head_apply_to_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    dump(spark, [transfer(n, address=account(n % 2)) for n in range(1, 11)], source)
    store = EventStore(spark, str(tmp_path / "store"), keys=False)
    job = Job("j", Catalog.of(1, [TRANSFER]), contract=account(1), start_block=3)
    backfill(L.stream_logs(spark, source), job, store, str(tmp_path / "ck"), head=8)
    assert values(store) == [3, 5, 7]


def test_following_picks_up_new_files(spark, tmp_path):
    source = str(tmp_path / "in")
    dump(spark, [transfer(1)], source)
    store = EventStore(spark, str(tmp_path / "store"))
    query = index_stream(L.stream_logs(spark, source), Job("j", CATALOG), store, str(tmp_path / "ck"), follow="1 second")
    try:
        query.processAllAvailable()
        assert observed(query) == (1, 1)
        dump(spark, [transfer(2)], source)
        query.processAllAvailable()
    finally:
        query.stop()
    assert values(store) == [1, 2]


def test_compaction_keeps_every_row(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    for batch in range(3):
        store.commit_batch(frame(spark, [transfer(batch * 2 + i) for i in (1, 2)]), Job("j", CATALOG), batch)
    store.compact(CATALOG, TABLE, str(tmp_path / "compact"))
    compacted = spark.read.parquet(str(tmp_path / "compact"))
    assert compacted.count() == 6 and compacted.select(F.sum(F.col("value").cast("int"))).first()[0] == 21
