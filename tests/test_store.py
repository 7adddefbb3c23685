"""Commit records, compaction in place, covered ranges, and what commits and reads leave unread."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logweave.plans.jobs import Job
from logweave.schema import EVENT_KEY
from logweave.sources import logs as L
from logweave.sources.manifest import COMPACTION, Entry, fewer, frontier, merged, overlaps, trimmed
from logweave.sources.store import EventStore
from logweave.streaming.index import backfill, index_stream, next_block
from tests.abi_codec import frame
from tests.test_filters import account
from tests.test_streaming import CATALOG, TABLE, dump, transfer, values


def numbers(*blocks, **changes):
    return [transfer(n, **changes) for n in blocks]


def folders(store, name=TABLE):
    return os.listdir(f"{store.root}/tables/{name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def blocks_of(ranges):
    return {b for lo, hi in ranges for b in range(lo, hi + 1)}


def test_ranges_against_sets():
    rng = random.Random(7)
    for _ in range(300):
        ranges = [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
        own = merged(ranges)
        assert blocks_of(own) == blocks_of(ranges)
        assert all(a[1] + 1 < b[0] for a, b in zip(own, own[1:]))
        for most in (1, 3):
            some = fewer(ranges, most)
            assert len(some) <= most and blocks_of(some) >= blocks_of(ranges)
        start = rng.randint(0, 20)
        end = start - 1
        while end + 1 in blocks_of(ranges):
            end += 1
        assert frontier(ranges, start) == end


def test_overlaps_against_sets():
    rng = random.Random(8)
    for _ in range(300):
        entries = []
        for i in range(rng.randint(0, 8)):
            lo = rng.randint(0, 40)
            entries.append(Entry("t", f"p{i}", rng.choice([("a",), ("b",), ("a", "b")]), lo, lo + rng.randint(0, 9), i))
        labels: dict = {}
        for e in entries:
            labels.setdefault(e.owners if len(e.owners) == 1 else e.path, set()).update(range(e.lo, e.hi + 1))
        shared = {b for b in range(60) if sum(b in own for own in labels.values()) > 1}
        assert blocks_of(overlaps(entries)) == shared


def test_held_folders_are_trimmed_not_rewritten():
    held = (Entry("held", "p", ("j",), 5, 9, 0), Entry("held", "q", ("j",), 12, 20, 1))
    assert [(e.lo, e.hi) for e in trimmed(held, 4)] == [(5, 9), (12, 20)]
    assert [(e.path, e.lo, e.hi) for e in trimmed(held, 15)] == [("q", 16, 20)]
    assert trimmed(held, 20) == ()


def test_disjoint_jobs_are_read_without_a_shuffle(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    store.commit_batch(frame(spark, numbers(*range(1, 11))), Job("a", CATALOG), 0)
    store.commit_batch(frame(spark, numbers(*range(11, 21))), Job("b", CATALOG), 0)
    data = store.data(CATALOG)
    assert "Exchange" not in plan(data.tables[TABLE]) and "Exchange" not in plan(data.blocks)
    assert values(store) == list(range(1, 21))
    store.commit_batch(frame(spark, numbers(9, 10, 11)), Job("c", CATALOG), 0)
    data = store.data(CATALOG)
    assert "Exchange" in plan(data.tables[TABLE])
    assert values(store) == list(range(1, 21)) and data.blocks.count() == 20
    store.compact(CATALOG)
    assert "Exchange" not in plan(store.data(CATALOG).tables[TABLE])
    assert values(store) == list(range(1, 21))


def test_of_blocks_that_jobs_share_the_one_with_a_time_stays(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    for job, stamp in (("a", None), ("b", 77), ("c", 0)):
        store.commit_batch(frame(spark, [transfer(3) | {"block_timestamp": stamp}]), Job(job, CATALOG), 0)
    times = lambda: [r.block_timestamp for r in store.data(CATALOG).blocks.collect()]
    assert times() == [77]
    store.compact(CATALOG)
    store.commit_batch(frame(spark, [transfer(3) | {"block_timestamp": 5}]), Job("d", CATALOG), 0)
    assert times() == [77]
    store.compact(CATALOG)
    assert times() == [77]


def test_a_batch_looks_only_at_the_buckets_it_touches(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    job = Job("j", CATALOG)
    for batch in range(5):
        store.commit_batch(frame(spark, numbers(*range(batch * 100 + 1, batch * 100 + 90, 10))), job, batch)
    entries = store.manifest.snapshot().own("j", TABLE)
    near = store.known_rows(store._layout(TABLE, CATALOG)[0], entries, [0, 41])
    assert sorted(r.block_number for r in near.collect()) == [1, 411]
    assert len(near.inputFiles()) == 2
    assert "block_number" in plan(near.select("__digest")) and "from" not in plan(near.select("__digest")).split("ReadSchema")[1]
    assert store.known_rows(store._layout(TABLE, CATALOG)[0], entries, [1000]) is None
    # One old block and a new one: nothing twice.
    store.commit_batch(frame(spark, numbers(1, 411, 999)), job, 5)
    assert values(store) == sorted([b for batch in range(5) for b in range(batch * 100 + 1, batch * 100 + 90, 10)] + [999])


def test_equal_digests_of_other_keys_lose_nothing(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    job = Job("j", CATALOG)
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    store.commit_batch(frame(spark, numbers(1, 2)), job, 0)
    store.commit_batch(frame(spark, numbers(2, 3)), job, 1)
    assert values(store) == [1, 2, 3]


def test_compaction_in_place(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    a, b = Job("a", CATALOG), Job("b/1-2", CATALOG)
    for batch in range(4):
        store.commit_batch(frame(spark, numbers(*range(batch * 3 + 1, batch * 3 + 5))), a, batch)
    store.commit_batch(frame(spark, numbers(5, 6, 40)), b, 0)
    want = sorted({*range(1, 14), 40})
    reading = store.data(CATALOG).tables[TABLE]
    assert len(folders(store)) == 5
    store.compact(CATALOG)
    assert len(store.manifest.snapshot().entries(TABLE)) == 1
    assert values(store) == want and store.data(CATALOG).blocks.count() == 14
    # A batch that ran before compaction runs again after it.
    store.commit_batch(frame(spark, numbers(*range(10, 14), 20)), a, 3)
    assert values(store) == sorted([*want, 20])
    store.commit_batch(frame(spark, numbers(50, 51)), a, 4)
    assert store.vacuum(keep=5) == 0
    assert sorted(int(r.value) for r in reading.collect()) == want
    store.compact(CATALOG)
    assert len(store.manifest.snapshot().entries(TABLE)) == 2
    store.compact(CATALOG, full=True)
    assert len(store.manifest.snapshot().entries(TABLE)) == 1
    for batch in (5, 6):
        store.commit_batch(frame(spark, numbers(60 + batch)), a, batch)
    assert store.vacuum(keep=1) > 0
    # Those of job a's last two batches, the compacted one, and what job b's only record still names.
    assert len(folders(store)) == 4
    assert sorted(os.listdir(f"{store.root}/commits/{COMPACTION}")) == ["2"]
    assert values(store) == sorted([*want, 20, 50, 51, 65, 66])
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_many_batches_leave_few_folders(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=1000)
    job = Job("j", CATALOG)
    for batch in range(24):
        store.commit_batch(frame(spark, numbers(batch + 1)), job, batch)
        if batch % 8 == 7:
            store.compact(CATALOG)
            store.vacuum(keep=1)
    assert values(store) == list(range(1, 25))
    assert len(folders(store)) <= 12 and len(os.listdir(f"{store.root}/commits/j")) <= 2


def test_a_record_without_its_mark_is_none(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=5)
    job = Job("j", CATALOG)
    store.commit_batch(frame(spark, numbers(1)), job, 0)
    store.commit_batch(frame(spark, numbers(2)), job, 1)
    os.remove(f"{store.root}/commits/j/1/_SUCCESS")
    assert values(store) == [1] and store.last_commits() == {"j": 0}
    store.commit_batch(frame(spark, numbers(2, 3)), job, 1)
    assert values(store) == [1, 2, 3]
    store.vacuum(keep=1)
    assert values(store) == [1, 2, 3] and len(folders(store)) == 2


def test_chunk_files_move_progress_through_empty_ranges(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    job = Job("j", CATALOG, contract=account(5), start_block=11)
    logs = frame(spark, numbers(5, 14, 33, 34, address=account(5)) + numbers(15, 61, address=account(6)))
    plan_ = L.chunk_plan(spark, 11, 70, 10)

    def run(*starts, **options):
        if starts:
            L.write_chunks(logs, plan_.where(F.col("chunk_start").isin(*starts)), source, 11, 10)
        backfill(L.stream_chunks(spark, source, max_files=1), job, store, checkpoint, **options)

    run(31, 51)
    assert next_block(store, job) == 11 and values(store) == [33, 34]
    run(11, 21)
    assert next_block(store, job) == 41 and values(store) == [14, 33, 34]
    run(41, 61)
    assert next_block(store, job) == 71
    assert [(r.chunk_start, r.chunk_end) for r in store.coverage("j").collect()] == [(11, 70)]


def test_covered_ranges_do_not_pass_the_head(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    job = Job("j", CATALOG, start_block=1)
    store.commit_batch(frame(spark, numbers(3, 18, 25)), job, 0, head=15, covered=[(1, 30)])
    assert next_block(store, job) == 16 and values(store) == [3]
    store.commit_batch(frame(spark, []), job, 1, head=20, covered=[])
    assert next_block(store, job) == 21 and values(store) == [3, 18]
    store.commit_batch(frame(spark, []), job, 2, head=99, covered=[])
    assert next_block(store, job) == 31 and values(store) == [3, 18, 25]
    # Nothing new: no record.
    store.commit_batch(frame(spark, []), job, 3, head=100, covered=[])
    assert store.last_commits() == {"j": 2}


def test_a_replay_after_a_release(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    job = Job("j", CATALOG, start_block=1)
    first, second = frame(spark, numbers(1, 50, 80)), frame(spark, numbers(2, 60, 90))
    store.commit_batch(first, job, 0, head=10)
    for head in (55, 85, 55):
        store.commit_batch(second, job, 1, head=head)
        assert values(store) == [n for n in (1, 2, 50, 60, 80, 90) if n <= head]
    store.commit_batch(frame(spark, []), job, 2, head=100)
    store.commit_batch(frame(spark, []), job, 2, head=100)
    assert values(store) == [1, 2, 50, 60, 80, 90] and next_block(store, job) == 91
    with pytest.raises(RuntimeError, match="does not belong"):
        store.commit_batch(first, job, 1, head=100)


def test_a_head_that_moves_while_no_file_comes(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    dump(spark, numbers(*range(1, 11)), source)
    store = EventStore(spark, str(tmp_path / "store"))
    head = [4]
    job = Job("j", CATALOG)
    query = index_stream(L.stream_logs(spark, source), job, store, checkpoint, follow="1 second", head=lambda: head[0])

    def reached(block):
        end = time.monotonic() + 60
        while next_block(store, job) <= block and time.monotonic() < end:
            time.sleep(0.2)
        return values(store)

    try:
        assert reached(4) == [1, 2, 3, 4]
        head[0] = 8
        assert reached(8) == list(range(1, 9))
    finally:
        query.stop()
    # The same checkpoint without following, with the head moved once more.
    backfill(L.stream_logs(spark, source), job, store, checkpoint, head=10)
    assert values(store) == list(range(1, 11))


def test_keys_of_a_table_are_what_commits_compare(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"), bucket_blocks=10)
    store.commit_batch(frame(spark, numbers(1, 1, 2)), Job("j", CATALOG), 0)
    rows = store.data(CATALOG).tables[TABLE]
    assert rows.count() == rows.select(*EVENT_KEY).distinct().count()
