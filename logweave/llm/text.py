"""Helpers the operators share: whole texts as UTF-8 bytes, in batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Folders

#: Words of the contracts on ASCII letters and digits: every other ASCII byte becomes a space, A-Z
#: become a-z, and bytes of other characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only a session without one, as in tests,
    gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Shared:
    """A value that the driver broadcasts. A worker opens it once, and classes of this library travel
    with it."""

    def __init__(self, spark: SparkSession, value: object):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if getattr(self.held, "opened", None) is None:
            self.held.opened = cloudpickle.loads(self.held.value)
        return self.held.opened


class Scratch:
    """A frame written to the shared folder and read again, until it is removed."""

    def __init__(self, frame: DataFrame, name: str):
        self.spark = frame.sparkSession
        self.path = scratch(self.spark, name)
        frame.write.parquet(self.path)
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path)

    def remove(self) -> None:
        """For a table whose successor is written. No frame that is still in use may read it."""
        Folders(self.spark).remove(self.path)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: later steps start from files."""
    return Scratch(frame, name).frame


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as bytes, without a copy; nulls are empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.fill_null(b"") if column.null_count else column


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take up about `limit` bytes; no text is split."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip((0, *cuts), (*cuts, len(sizes))):
            if b > a:
                yield batch.slice(a, b - a)
        release()


def map_texts(docs: DataFrame, step: Callable[[list, list[bytes]], dict], schema: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """One call of step(ids, texts) for each slice of whole texts; it returns columns of `schema`.
    Other columns of `docs` are not read."""
    fields = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, limit):
            out = step(part.column(0), binary(part.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Spans of more bytes are hashed one by one.
_SHORT = 128
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its pieces of eight bytes, mixed one after the other, so
    that no structure of the text cancels out. Equal bytes give equal hashes wherever they stand."""
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(np.uint64) + np.uint64(seed * 0xA0761D6478BD642F % (1 << 64)))
        rows = np.flatnonzero((sizes > 0) & (sizes <= _SHORT))
        at = 0
        while len(rows):
            piece = eight[starts[rows] + at] & _MASKS[np.minimum(sizes[rows] - at, 8)]
            out[rows] = mix(out[rows] * np.uint64(0x9FB21C651E98DF25) + mix(piece + np.uint64(0xE7037ED1A0B428DB)))
            at += 8
            rows = rows[sizes[rows] > at]
        for i in np.flatnonzero(sizes > _SHORT).tolist():
            digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
    return out


def word_spans(data: np.ndarray, space: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than `space`."""
    inside = np.concatenate(([False], data != space, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a space, and the place where each begins."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate(([0], np.cumsum(sizes)))


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
