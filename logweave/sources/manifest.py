"""Commit records of a store: which folders make up its tables.

A commit adds one folder with one small Parquet file, and nothing is overwritten: the record says
which folders of rows a job has, so readers never list tables, and a reader keeps the rows that it has
begun with. A record counts once Spark has left its _SUCCESS mark, so a lost commit is no record.

Each job has a chain of records of its own and is its only writer. Compaction has a chain, too: it says
which folders hold what it has brought together, and up to which commit of each job these replace the
job's own folders. Readers take the last record of each job first and that of compaction after it, so
a folder that a job no longer names is always found to be replaced."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMPACTION = "compact"
#: Block ranges that a plan filters by; more are merged over the smallest gaps.
MAX_RANGES = 100

_ENTRY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("owners", T.ArrayType(T.StringType())),
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("chain_id", T.LongType()),
        T.StructField("event_hash", T.StringType()),
        T.StructField("event_signature", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("bucket_blocks", T.LongType()),
        T.StructField("has_keys", T.BooleanType()),
    ]
)


class Folders:
    """Names, marks and removal of folders, by the file system that Spark writes them with."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def complete(self, path: str) -> bool:
        fs, where = self._at(f"{path}/_SUCCESS")
        return fs.exists(where)

    def remove(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


@dataclass(frozen=True)
class Entry:
    """A folder of rows of one table, or of logs that are held back: blocks lo..hi of it count.

    owners: the jobs whose rows it has. seq: the commit that added it."""

    name: str
    path: str
    owners: tuple[str, ...]
    lo: int
    hi: int
    seq: int
    batch_id: int = -1


@dataclass(frozen=True)
class Record:
    """The state of one chain after a commit."""

    seq: int = -1
    batch_id: int = -1
    files: tuple[Entry, ...] = ()
    #: Logs held back after this batch, and before it, for the case that it runs again.
    held: tuple[Entry, ...] = ()
    held_before: tuple[Entry, ...] = ()
    #: Merged block ranges that were read in full.
    ranges: tuple[tuple[int, int], ...] = ()
    #: (chain_id, event_hash) -> signature, name, first and last block.
    events: dict[tuple[int, str], tuple[str, str, int, int]] = field(default_factory=dict)
    #: Of compaction: (table, job) -> the last commit whose folders are replaced.
    through: dict[tuple[str, str], int] = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {e.path for e in (*self.files, *self.held, *self.held_before)}


def merged(ranges: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """Closed ranges of blocks, those that overlap or touch as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((lo, hi) for lo, hi in out)


def fewer(ranges: Sequence[tuple[int, int]], most: int = MAX_RANGES) -> tuple[tuple[int, int], ...]:
    """At most `most` ranges that hold all of the given ones, merged over the smallest gaps."""
    ranges = merged(ranges)
    if len(ranges) <= most:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
    cuts = sorted(gaps[len(ranges) - most :])
    return tuple((ranges[a][0], ranges[b - 1][1]) for a, b in zip((0, *cuts), (*cuts, len(ranges))))


def frontier(ranges: Iterable[tuple[int, int]], start: int) -> int:
    """The last block of what is covered from `start` on without a gap; start - 1 if nothing is."""
    end = start - 1
    for lo, hi in merged(ranges):
        if lo > end + 1:
            break
        end = max(end, hi)
    return end


def overlaps(entries: Sequence[Entry]) -> tuple[tuple[int, int], ...]:
    """Block ranges in which folders may hold one key twice: those of different jobs. Folders of one job
    alone, compacted or not, have each key once."""
    by_label: dict[object, list[tuple[int, int]]] = {}
    for e in entries:
        by_label.setdefault(e.owners if len(e.owners) == 1 else e.path, []).append((e.lo, e.hi))
    steps = sorted((at, step) for ranges in by_label.values() for lo, hi in merged(ranges) for at, step in ((lo, 1), (hi + 1, -1)))
    out, depth, since = [], 0, 0
    for at, step in steps:
        if depth == 1 and step > 0:
            since = at
        if depth == 2 and step < 0 and at > since:
            out.append((since, at - 1))
        depth += step
    return fewer(out)


def touches(entry: Entry, ranges: Iterable[tuple[int, int]]) -> bool:
    return any(lo <= entry.hi and entry.lo <= hi for lo, hi in ranges)


class Manifest:
    """The chains of records below a store's folder."""

    def __init__(self, spark: SparkSession, root: str, bucket_blocks: int, has_keys: bool):
        self.spark, self.root = spark, f"{root}/commits"
        self.layout = (bucket_blocks, has_keys)
        self.folders = Folders(spark)

    def chains(self) -> list[str]:
        return [unquote(n) for n in self.folders.names(self.root)]

    def _chain(self, chain: str) -> str:
        return f"{self.root}/{quote(chain, safe='')}"

    def _seqs(self, chain: str) -> list[int]:
        return sorted(int(n) for n in self.folders.names(self._chain(chain)) if n.isdigit())

    def last_seq(self, chain: str) -> int | None:
        """The newest complete record."""
        return next((s for s in reversed(self._seqs(chain)) if self.folders.complete(f"{self._chain(chain)}/{s}")), None)

    def next_seq(self, chain: str) -> int:
        """A number that no attempt has used, complete or not."""
        return max(self._seqs(chain), default=-1) + 1

    def read(self, chain: str, seq: int | None = None) -> Record:
        """A record of a chain, the last one by default; an empty one if there is none."""
        seq = self.last_seq(chain) if seq is None else seq
        if seq is None:
            return Record()
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self._chain(chain)}/{seq}").collect()
        head = next(r for r in rows if r.kind == "commit")
        if (head.bucket_blocks, head.has_keys) != self.layout:
            raise ValueError(f"the store was written with bucket_blocks={head.bucket_blocks}, keys={head.has_keys}; open it so")
        entries = lambda kind: tuple(Entry(r.name, r.path, tuple(r.owners), r.lo, r.hi, r.seq, r.batch_id) for r in rows if r.kind == kind)
        return Record(
            seq,
            head.batch_id,
            entries("file"),
            entries("held"),
            entries("held_before"),
            tuple(sorted((r.lo, r.hi) for r in rows if r.kind == "range")),
            {(r.chain_id, r.event_hash): (r.event_signature, r.event_name, r.lo, r.hi) for r in rows if r.kind == "event"},
            {(r.name, r.owners[0]): r.seq for r in rows if r.kind == "through"},
        )

    def write(self, chain: str, record: Record) -> None:
        row = lambda kind, **values: tuple(({"kind": kind, "bucket_blocks": self.layout[0], "has_keys": self.layout[1]} | values).get(n) for n in _ENTRY.names)
        rows = [row("commit", seq=record.seq, batch_id=record.batch_id)]
        for kind, entries in (("file", record.files), ("held", record.held), ("held_before", record.held_before)):
            rows += [row(kind, **{**vars(e), "owners": list(e.owners)}) for e in entries]
        rows += [row("range", lo=lo, hi=hi) for lo, hi in record.ranges]
        rows += [row("event", chain_id=c, event_hash=h, event_signature=s, event_name=n, lo=lo, hi=hi) for (c, h), (s, n, lo, hi) in record.events.items()]
        rows += [row("through", name=t, owners=[j], seq=s) for (t, j), s in record.through.items()]
        self.spark.createDataFrame(rows, _ENTRY).coalesce(1).write.parquet(f"{self._chain(chain)}/{record.seq}")

    def snapshot(self) -> Snapshot:
        jobs = {c: self.read(c) for c in self.chains() if c != COMPACTION}
        return Snapshot({c: r for c, r in jobs.items() if r.seq >= 0}, self.read(COMPACTION))

    def forget(self, keep: int) -> tuple[set[str], dict[str, int]]:
        """Remove all but the last `keep` records of each chain. Returns the folders that those name,
        and the last record of each chain."""
        named, last = set(), {}
        for chain in self.chains():
            newest = self.last_seq(chain)
            if newest is None:
                continue
            last[chain] = newest
            done = [s for s in self._seqs(chain) if s <= newest and self.folders.complete(f"{self._chain(chain)}/{s}")]
            for seq in done[-keep:]:
                named |= self.read(chain, seq).paths()
            for seq in self._seqs(chain):
                if seq < done[-keep:][0]:
                    self.folders.remove(f"{self._chain(chain)}/{seq}")
        return named, last


@dataclass(frozen=True)
class Snapshot:
    """The last records of all jobs, and of compaction: what a reader sees."""

    jobs: dict[str, Record]
    compaction: Record

    def own(self, job_id: str, name: str | None = None) -> tuple[Entry, ...]:
        """A job's own folders that compaction has not replaced."""
        files = self.jobs[job_id].files if job_id in self.jobs else ()
        through = self.compaction.through
        return tuple(e for e in files if name in (None, e.name) and e.seq > through.get((e.name, job_id), -1))

    def compacted(self, name: str) -> tuple[Entry, ...]:
        return tuple(e for e in self.compaction.files if e.name == name)

    def entries(self, name: str) -> tuple[Entry, ...]:
        """All folders of a table."""
        return (*self.compacted(name), *(e for job in sorted(self.jobs) for e in self.own(job, name)))


def trimmed(held: Iterable[Entry], above: int) -> tuple[Entry, ...]:
    """What is still held of folders of logs once blocks up to `above` are released."""
    return tuple(replace(e, lo=max(e.lo, above + 1)) for e in held if e.hi > above)


def folder_frame(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
