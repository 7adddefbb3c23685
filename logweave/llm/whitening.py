"""Whitening of embeddings: projection on the leading components of their covariance, each to variance 1.

A vector's entries become integers x = floor(scale * c). The fit list has each distinct x once, packed
in as few bytes as the row needs. From it come, by sums in tasks that are added up by dimension:
the number of vectors n and the sums S, exact; then the covariance of x - S / n, centred before it is
multiplied; then, with the components known, the covariance of the whitened fit list itself. The driver
holds matrices of dimensions squared and finds the components in `eigen`; they are broadcast with S.

A frequent vector is one row of the fit list before it leaves its task. Sums of a task are one row for
each dimension, so no dimension has more rows than there are tasks.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped. The
dimension is the length that most distinct vectors have, the longer one of a tie; rows of other
lengths are dropped too. Entries beyond a 64-bit integer count as its bound. Components whose
eigenvalue is zero up to rounding are left out, so equal vectors alone give no rows, and so does an
empty table. A deviation beyond a 64-bit integer is null. Rows with equal ids or none are rows of their
own. Other columns are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eigen import leading
from .text import Shared, staged

SCALE, COMPONENTS = 256, 4
_LONG = 1 << 63
#: Rows that are multiplied at once.
_ROWS = 4096
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the places of usable rows, and their integers as a matrix."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    sizes = np.diff(offsets)
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        for part in np.array_split(rows, -(-len(rows) // _ROWS)):
            with np.errstate(over="ignore"):
                values = np.floor(scale * flat[offsets[part][:, None] + np.arange(size)])
            beyond = np.abs(values) >= float(_LONG)
            x = np.where(beyond, 0.0, values).astype(np.int64)
            x[beyond] = np.where(values[beyond] > 0, _LONG - 1, -_LONG)
            yield part, x


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in 2, 4 or 8 bytes an entry, as few as it needs."""
    bits = np.maximum(x.max(axis=1), ~x.min(axis=1))
    out: list[bytes] = [b""] * len(x)
    for width, at_least, below in ((2, -1, 1 << 15), (4, (1 << 15) - 1, 1 << 31), (8, (1 << 31) - 1, 1 << 63)):
        rows = np.flatnonzero((bits > at_least) & (bits < below if below < _LONG else True))
        data, step = x[rows].astype(f"<i{width}").tobytes(), width * x.shape[1]
        for k, row in enumerate(rows.tolist()):
            out[row] = data[k * step : (k + 1) * step]
    return out


def unpacked(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Matrices of packed rows, one for each width."""
    rows = column.to_pylist()
    for width in (2, 4, 8):
        own = [r for r in rows if len(r) == width * size]
        for i in range(0, len(own), _ROWS):
            yield np.frombuffer(b"".join(own[i : i + _ROWS]), f"<i{width}").reshape(-1, size).astype(np.int64)


def fit_list(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """size, x: the distinct integer vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(packed(x), pa.binary())], names=["size", "x"])

    return vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "size int, x binary").distinct()


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            for x in unpacked(batch.column(0), size):
                n += len(x)
                whole = x if np.abs(x.astype(float)).max() < 2.0**50 else x.astype(object)
                total = [a + int(b) for a, b in zip(total, whole.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["i", "s"])

    rows = {r.i: int(r.s) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return rows.get(-1, 0), [rows.get(i, 0) for i in range(size)]


def _products(fit: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], wide: int) -> np.ndarray:
    """The sum of y y^T over the fit list, where `of` gives the rows y of a matrix of vectors. A task
    sends a row for each row of its sum; the rows of one number are added up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            for x in unpacked(batch.column(0), size):
                y = of(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[i] = rows.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], names=["i", "row"])

    kind = "i int, row binary"
    out = np.zeros((wide, wide))
    for r in fit.mapInArrow(run, kind).repartition("i").mapInArrow(add, kind).collect():
        out[r.i] = np.frombuffer(r.row)
    return (out + out.T) / 2


class Whitener:
    """n and S of the fit list, its components by falling eigenvalue, and what they explain."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, k: int):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        self.values, self.components = leading(covariance, k)
        trace = float(np.trace(covariance))
        real = self.values > trace * len(sums) * np.finfo(float).eps
        self.values, self.components = self.values[real], self.components[:, real]
        self.explained = self.values / trace if trace else self.values
        self.onto = self.components / np.sqrt(self.values)
        self.identity_error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.onto

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 over the dimensions, exact."""
        most = max(map(abs, self.sums), default=0) + self.n * float(np.abs(x.astype(float)).max(initial=0))
        exact = most * most * max(1, len(self.sums)) < 2.0**62
        y = self.n * x - np.array(self.sums) if exact else self.n * x.astype(object) - np.array(self.sums, object)
        return [d if d < _LONG else None for d in map(int, (y * y).sum(axis=1))]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitener | None:
    """What whitens a table of vectors; None if it has none that can be used."""
    held = staged(fit_list(vectors, vector, scale), "vectors")
    sizes = held.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return None
    size = sizes.size
    held = held.where(F.col("size") == size).select("x")
    n, sums = _sums(held, size)
    mean = np.array([s / n for s in sums])
    made = Whitener(n, sums, _products(held, size, lambda x: x - mean, size) / n, components)
    k = len(made.values)
    if k:
        # The mean of the whitened list is that of x - S / n, zero, so this is centred too.
        made.identity_error = float(np.abs(_products(held, size, made.whitened, k) / n - np.eye(k)).max())
    return made


def whiten(vectors: DataFrame, made: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable
    vector and component."""
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, {_OUT}"
    if made is None or not len(made.values):
        return spark.createDataFrame([], schema)
    shared, k, size = Shared(spark, made), len(made.values), len(made.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1), scale):
                if x.shape[1] != size:
                    continue
                w = shared.value
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                columns = [
                    ids,
                    pa.array(numbers),
                    pa.array(np.full(len(numbers), w.n, np.int64)),
                    pa.array([d for d in w.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(w.whitened(x).ravel()),
                    pa.array(np.tile(w.explained, len(x))),
                    pa.array(np.full(len(numbers), w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit(vectors))
