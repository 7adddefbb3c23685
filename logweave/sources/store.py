"""Event tables as folders of Parquet, and commit records that say which folders count.

A batch writes each table's new rows to a folder of its own, sorted by block, and then one record
(see `manifest`): a batch becomes visible as a whole or not at all. A batch that runs again after a lost
driver writes new folders and a new record, in which those of the first attempt are left out.

Keys stay unique without reading the history. A job compares its new rows only with folders whose blocks
lie in the buckets that the batch touches, by a 64-bit digest of the key first, a column of its own in
the folders; key columns are read only if a digest is met again. Jobs do not look at each other when they
write. Readers make keys unique only in block ranges that folders of different jobs share, and read all
other ranges without a shuffle.

`compact` brings folders together in place; `vacuum` removes what no kept record names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from operator import or_
from urllib.parse import quote, unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import blocks_from_logs, first_per_key, new_rows
from ..operators.registry import empty_registry, event_schema
from ..operators.routing import decode, require_known, well_formed
from ..plans.dataset import IndexedData
from ..plans.jobs import Job, validate_job
from ..plans.lazy import LazyTables
from ..schema import BLOCKS, EVENT_KEY, RAW_LOG, REGISTRY
from .catalog import MAX_BROADCAST_EVENTS, Catalog
from .logs import DEFAULT_BUCKET_BLOCKS, block_bucket, topic0
from .manifest import COMPACTION, Entry, Folders, Manifest, Record, Snapshot, fewer, folder_frame, frontier, merged, overlaps, touches, trimmed

#: Column of the folders: a digest of the row's key.
DIGEST = "__digest"
#: Tables that a batch writes at once.
WRITERS = 4
_DIGEST_FIELD = T.StructField(DIGEST, T.LongType())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one the cluster names; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def in_ranges(ranges: Iterable[tuple[int, int]]) -> Column:
    """Whether a row's block lies in one of the ranges; reaches the files as a filter."""
    return reduce(or_, [F.col("block_number").between(lo, hi) for lo, hi in ranges], F.lit(False))


@dataclass(frozen=True)
class EventStore:
    spark: SparkSession
    root: str
    bucket_blocks: int = DEFAULT_BUCKET_BLOCKS
    keys: bool = True

    @cached_property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, self.root.rstrip("/"), self.bucket_blocks, self.keys)

    def _path(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}"

    def _new_folder(self, name: str, chain: str, seq: int) -> str:
        return f"tables/{name}/{quote(chain, safe='')}-{seq}-{uuid.uuid4().hex}"

    # -- commits ---------------------------------------------------------------------

    def last_commits(self) -> dict[str, int]:
        """Last committed batch of each job (jobs are configuration, so this is small)."""
        return {job: r.batch_id for job, r in self.manifest.snapshot().jobs.items()}

    def registry(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Progress per event; where several jobs share an event, the widest range."""
        events: dict[tuple[int, str], tuple[str, str, int, int]] = {}
        for record in (snapshot or self.manifest.snapshot()).jobs.values():
            for key, (signature, name, first, last) in record.events.items():
                known = events.get(key, (signature, name, first, last))
                events[key] = (*known[:2], min(known[2], first), max(known[3], last))
        return self._registry_frame(events)

    def _registry_frame(self, events: dict) -> DataFrame:
        return self.spark.createDataFrame([(*k, *v) for k, v in events.items()], REGISTRY) if events else empty_registry(self.spark)

    def _job_events(self, record: Record, job: Job) -> dict[tuple[int, str], tuple[str, str, int, int]]:
        """The job's events with their progress; those of its first commit begin at its start block."""
        start = job.start_block if record.seq < 0 else 0
        new = {(job.catalog.chain_id, e.hash): (e.signature, e.name, start, 0) for e in job.catalog.events}
        return record.events | {k: v for k, v in new.items() if k not in record.events}

    def job_registry(self, job: Job) -> DataFrame:
        """The job's own registry rows, new events registered at its start block."""
        return self._registry_frame(self._job_events(self.manifest.read(job.job_id), job))

    def coverage(self, job_id: str) -> DataFrame:
        """chunk_start, chunk_end of the block ranges that a job has read in full, merged."""
        ranges = self.manifest.read(job_id).ranges
        return self.spark.createDataFrame([(job_id, lo, hi) for lo, hi in ranges], "job_id string, chunk_start long, chunk_end long")

    # -- reading ---------------------------------------------------------------------

    def _rows(self, schema: T.StructType, entries: Sequence[Entry]) -> DataFrame:
        return folder_frame(self.spark, schema, [self._path(e.path) for e in entries])

    def _unique(self, schema: T.StructType, entries: Sequence[Entry], keys: Sequence[str], prefer: str | None = None) -> DataFrame:
        """The rows of the folders, each key once. Only ranges that several jobs share are shuffled; of
        their rows for a key, the one with most in `prefer` stays."""
        shared = overlaps(entries)
        if not shared:
            return self._rows(schema, entries)
        inside = [e for e in entries if touches(e, shared)]
        outside = [e for e in entries if e not in inside]
        twice = self._rows(schema, inside)
        if prefer is None:
            once = twice.where(in_ranges(shared)).dropDuplicates(list(keys))
        else:
            marked = [self._rows(schema, [e for e in inside if e.owners == o]).withColumn("__owner", F.lit(",".join(o))) for o in sorted({e.owners for e in inside})]
            ranked = reduce(DataFrame.unionByName, marked).where(in_ranges(shared)).withColumn("__rank", F.struct(-F.col(prefer), F.col("__owner")))
            once = first_per_key(ranked, keys, ["__rank"]).drop("__rank", "__owner")
        rest = twice.where(~in_ranges(shared))
        return (self._rows(schema, outside).unionByName(rest) if outside else rest).unionByName(once)

    def _layout(self, name: str, catalog: Catalog | None = None, chain_id: int | None = None) -> tuple[T.StructType, Sequence[str], str | None]:
        """Columns, key, and what decides between rows of one key."""
        if chain_id is not None:
            return BLOCKS, ["block_number"], "block_timestamp"
        return event_schema(catalog.tables[name], self.keys), EVENT_KEY, None

    def table(self, catalog: Catalog, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Committed rows of one event table."""
        schema, keys, prefer = self._layout(name, catalog)
        return self._unique(schema, (snapshot or self.manifest.snapshot()).entries(name), keys, prefer)

    def blocks(self, chain_id: int, snapshot: Snapshot | None = None) -> DataFrame:
        schema, keys, prefer = self._layout(f"blocks_{chain_id}", chain_id=chain_id)
        return self._unique(schema, (snapshot or self.manifest.snapshot()).entries(f"blocks_{chain_id}"), keys, prefer)

    def data(self, catalog: Catalog) -> IndexedData:
        """The committed state as queries see it, read anew on every call. All its tables are of one
        snapshot, also if batches are committed or folders compacted while it is in use."""
        seen = self.manifest.snapshot()
        tables = LazyTables(catalog.tables, lambda name: self.table(catalog, name, seen))
        return IndexedData(self.spark, catalog.chain_id, catalog.tables, tables, self.blocks(catalog.chain_id, seen), self.registry(seen))

    # -- writing ---------------------------------------------------------------------

    def known_rows(self, schema: T.StructType, entries: Sequence[Entry], buckets: Sequence[int]) -> DataFrame | None:
        """Stored rows in the buckets that a batch touches, from the folders that have such blocks."""
        size = self.bucket_blocks
        touched = fewer([(b * size, (b + 1) * size - 1) for b in buckets])
        near = [e for e in entries if touches(e, touched)]
        fields = T.StructType([*schema.fields, _DIGEST_FIELD])
        return self._rows(fields, near).where(in_ranges(touched)) if near else None

    def _fresh(self, rows: DataFrame, schema: T.StructType, keys: Sequence[str], stored: Sequence[Entry], buckets: Sequence[int]) -> DataFrame:
        """The rows of a batch whose keys are not stored yet, once each."""
        once = new_rows(None, rows, keys).withColumn(DIGEST, F.xxhash64(*keys))
        before = self.known_rows(schema, stored, buckets)
        if before is None:
            return once
        if before.select(DIGEST).join(once.select(DIGEST), DIGEST, "left_semi").isEmpty():
            return once
        return once.join(before.select(*keys, DIGEST), [*keys, DIGEST], "left_anti")

    def _append(self, name: str, schema: T.StructType, rows: DataFrame, keys: Sequence[str], stored: Sequence[Entry], buckets: Sequence[int], path: str) -> None:
        fresh = self._fresh(rows, schema, keys, stored, buckets).select(*schema.names, DIGEST)
        # Blocks of one bucket come together; the adaptive plan splits a bucket that is too large for
        # one task and merges small ones.
        spread = fresh.withColumn("__bucket", block_bucket(F.col("block_number"), self.bucket_blocks)).hint("rebalance", "__bucket")
        spread.sortWithinPartitions("block_number").drop("__bucket").write.parquet(self._path(path))

    def _summary(self, logs: DataFrame, catalog: Catalog, head: int | None) -> dict[str | None, tuple[int, int, list[int]]]:
        """For each event table of a batch's logs, None for all logs, "held" for those above the head:
        lowest and highest block, and the buckets between."""
        known = catalog.frame(self.spark).select("event_hash", "table_name")
        known = F.broadcast(known) if len(catalog.events) <= MAX_BROADCAST_EVENTS else known
        placed = well_formed(logs).withColumn("event_hash", topic0(logs)).join(known, "event_hash", "left")
        later = F.lit(False) if head is None else F.col("block_number") > head
        bucket = block_bucket(F.col("block_number"), self.bucket_blocks)
        counted = placed.groupBy(later.alias("later"), "table_name", bucket.alias("bucket")).agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
        rows = counted.groupBy("later", "table_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("bucket").alias("buckets")).collect()
        out: dict[str | None, tuple[int, int, list[int]]] = {}
        for r in rows:
            for name in {"held"} if r.later else {None, r.table_name}:
                lo, hi, buckets = out.get(name, (r.lo, r.hi, []))
                out[name] = (min(lo, r.lo), max(hi, r.hi), sorted({*buckets, *r.buckets}))
        return out

    def _released(self, held: Sequence[Entry], head: int) -> DataFrame | None:
        """Logs that were held back and lie at or below the head by now."""
        parts = [self._rows(RAW_LOG, [e]).where(F.col("block_number").between(e.lo, min(e.hi, head))) for e in held if e.lo <= head]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def commit_batch(
        self,
        logs: DataFrame,
        job: Job,
        batch_id: int,
        processed_to: int | None = None,
        head: int | None = None,
        covered: Sequence[tuple[int, int]] | None = None,
    ) -> None:
        """Store a batch of a job's logs: blocks, event tables, then the commit record.

        covered: block ranges that the batch has in full, also those without logs. Progress is then
        what is covered from the job's start on without a gap, as far as the head lets. processed_to:
        the same as one number, if the caller knows it. Without either, progress is the highest block
        seen. head: logs above it are held back for a later batch, and those held back before join
        this one. A batch that has run before replaces what it left."""
        validate_job(job)
        snapshot = self.manifest.snapshot()
        last = snapshot.jobs.get(job.job_id, Record())
        if batch_id < last.batch_id:
            raise RuntimeError(
                f"job {job.job_id} has committed batch {last.batch_id}, but its stream is at {batch_id}: "
                "the checkpoint does not belong to this store"
            )
        before = last.held_before if batch_id == last.batch_id else last.held
        logs = logs.select(*RAW_LOG.names)
        if head is not None and (ready := self._released(before, head)) is not None:
            logs = logs.unionByName(ready)
        if job.strict:
            require_known(logs if head is None else logs.where(F.col("block_number") <= head), job.catalog)
        found = self._summary(logs, job.catalog, head)
        seq = self.manifest.next_seq(job.job_id)
        held = before if head is None else trimmed(before, head)
        writes: list[Callable[[], None]] = []
        if later := found.pop("held", None):
            folder = self._new_folder("held", job.job_id, seq)
            writes.append(lambda: logs.where(F.col("block_number") > head).write.parquet(self._path(folder)))
            # Folders that were held before are not written anew: of those, only a higher part counts.
            held = (*held, Entry("held", folder, (job.job_id,), later[0], later[1], seq, batch_id))
        files = [e for e in snapshot.own(job.job_id) if e.batch_id < batch_id]
        whole = found.pop(None, None)
        if whole is None and not writes and held == before and processed_to is None and not covered and last.seq >= 0:
            return
        if whole is not None:
            mine = logs if head is None else logs.where(F.col("block_number") <= head)
            chain = job.catalog.chain_id
            tables: list[tuple[str, DataFrame, tuple]] = [(f"blocks_{chain}", blocks_from_logs(well_formed(mine)), (BLOCKS, ["block_number"]))]
            for name, event in job.catalog.tables.items():
                if name in found:
                    tables.append((name, decode(mine, event, keys=self.keys), (event_schema(event, self.keys), EVENT_KEY)))
            for name, rows, (schema, keys) in tables:
                lo, hi, buckets = found.get(name, whole)
                stored = [*(e for e in files if e.name == name), *snapshot.compacted(name)]
                path = self._new_folder(name, job.job_id, seq)
                files.append(Entry(name, path, (job.job_id,), lo, hi, seq, batch_id))
                writes.append(lambda a=(name, schema, rows, keys, stored, buckets, path): self._append(*a))
        with ThreadPoolExecutor(WRITERS) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(w)) for w in writes]:
                done.result()
        ranges = merged([*last.ranges, *(covered or ())])
        if processed_to is None and covered is not None:
            # Logs above the head wait, so what is covered does not count beyond it yet.
            processed_to = min([frontier(ranges, job.start_block), *([head] if head is not None else []), *(e.lo - 1 for e in held)])
        elif processed_to is None and whole is not None:
            processed_to = whole[1]
        self._commit(job, batch_id, processed_to, Record(seq, batch_id, tuple(files), held, before, ranges, self._job_events(last, job)))

    def _commit(self, job: Job, batch_id: int, reached: int | None, record: Record) -> None:
        events = dict(record.events)
        if reached is not None:
            for h in job.catalog.hashes:
                signature, name, first, last = events[job.catalog.chain_id, h]
                events[job.catalog.chain_id, h] = (signature, name, first, max(last, reached))
        self.manifest.write(job.job_id, replace(record, events=events))

    # -- upkeep ----------------------------------------------------------------------

    def compact(self, catalog: Catalog, name: str | None = None, path: str | None = None, full: bool = False) -> None:
        """Bring the folders of a table (all tables and blocks without a name) together as few large
        files in block order. Readers and jobs may go on; one compaction runs at a time.

        Folders that came since the last compaction become one; `full` takes all anew. With a path
        the rows are written there, and the store stays as it is."""
        if path is not None:
            self._in_block_order(self.table(catalog, name), EVENT_KEY).write.mode("overwrite").parquet(path)
            return
        snapshot = self.manifest.snapshot()
        blocks = f"blocks_{catalog.chain_id}"
        seq = self.manifest.next_seq(COMPACTION)
        files, through = list(snapshot.compaction.files), dict(snapshot.compaction.through)
        changed = False
        for table in [name] if name else [blocks, *catalog.tables]:
            schema, keys, prefer = self._layout(table, catalog, catalog.chain_id if table == blocks else None)
            own = [e for job in snapshot.jobs for e in snapshot.own(job, table)]
            # Blocks that several jobs hold are weighed against each other, so these are taken as a whole.
            old = snapshot.compacted(table) if full or prefer else ()
            if not own and len(old) < 2:
                continue
            rows = self._unique(schema, [*old, *own], keys, prefer)
            folder = self._new_folder(table, COMPACTION, seq)
            self._in_block_order(rows.withColumn(DIGEST, F.xxhash64(*keys)), keys).write.parquet(self._path(folder))
            owners = tuple(sorted({o for e in (*old, *own) for o in e.owners}))
            files = [e for e in files if e not in old]
            files.append(Entry(table, folder, owners, min(e.lo for e in (*old, *own)), max(e.hi for e in (*old, *own)), seq))
            through |= {(table, job): max(e.seq for e in snapshot.own(job, table)) for job in snapshot.jobs if snapshot.own(job, table)}
            changed = True
        if changed:
            self.manifest.write(COMPACTION, Record(seq, files=tuple(files), through=through))

    @staticmethod
    def _in_block_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def vacuum(self, keep: int = 2) -> int:
        """Remove records but the last `keep` of each chain, and folders that only those, or lost
        commits, have named. Readers that began before the kept records must have ended. Returns the
        number of folders removed."""
        if keep < 1:
            raise ValueError("keep at least one record")
        named, last = self.manifest.forget(keep)
        folders, removed = Folders(self.spark), 0
        for table in folders.names(self._path("tables")):
            for folder in folders.names(self._path(f"tables/{table}")):
                chain, seq, _ = folder.rsplit("-", 2)
                # A later number than the last record's may be of a commit that is under way.
                if f"tables/{table}/{folder}" not in named and int(seq) <= last.get(unquote(chain), -1):
                    folders.remove(self._path(f"tables/{table}/{folder}"))
                    removed += 1
        return removed


def export(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table or a result as Parquet or CSV."""
    if fmt == "csv":
        rows.write.mode("errorifexists").option("header", True).csv(path)
    elif fmt == "parquet":
        rows.write.mode("errorifexists").parquet(path)
    else:
        raise ValueError(f"cannot export as {fmt!r}")
