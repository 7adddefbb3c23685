"""Line dedup over the whole corpus, which returns bitmaps of the lines to keep instead of text.

Each text is split at line feeds. The key of a line is the line without blanks at both ends, with
A-Z in lower case. One row per document and key, a 128-bit hash, is range-partitioned by (hash,
document) and sorted, largest document first, so one pass over a partition meets the document that
keeps the key before all others, and a hot key spreads over as many partitions as its rows fill.
A run of a key that touches the edge of a partition may go on in the next: its rows are marked as
open, and a summary of at most two rows per partition settles them by a join.

Null texts are one empty line. Lines with short keys are kept. Rows with equal ids count as one
document, which loses the lines that any of them loses. Rows without an id neither count nor lose
lines. Columns other than the id and the text are left as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import binary, code_points, map_texts, slices, staged

MIN_POINTS, MIN_DOCS = 20, 3
_LINES = "doc_id long, hi long, lo long, at binary"
_MARKED = "kind int, hi long, lo long, doc_id long, at binary, docs int"
#: Kinds of rows of the pass: lines to drop, lines of an open run, summary of an open run.
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _keys(ids, texts: list[bytes], least: int) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "hi": [], "lo": [], "at": []}
    for doc, text in zip(ids.to_pylist(), texts):
        places: dict[bytes, list[int]] = {}
        for i, line in enumerate(text.split(b"\n")):
            key = line_key(line)
            if len(key) >= least and (len(key) >= 4 * least or code_points(key) >= least):
                places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
        for digest, lines in places.items():
            hi, lo = struct.unpack(">qq", digest)
            for column, value in zip(out, (doc, hi, lo, np.array(lines, "<u4").tobytes())):
                out[column].append(value)
    return out


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Marks the lines of one sorted partition. The state is one run: its key, whether it is the
    partition's first, the documents so far, and the rows of the first documents while they are few."""
    key, first, docs, top, before, held = None, True, 0, None, None, []
    out: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal held
        if key is not None and (first or (last and docs < min_docs)):
            out.extend((_OPEN, *key, d, a, None) for d, a in held)
        if key is not None and (first or last):
            out.append((_SUMMARY, *key, top, None, docs))
        held = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    started = False
    for batch in batches:
        his, los, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        places = batch.column(3)
        same = np.concatenate(([False], (his[1:] == his[:-1]) & (los[1:] == los[:-1])))
        # Of runs inside the batch, only those of at least two rows need a look at each row.
        ends = np.concatenate((~same[1:], [False]))
        busy = np.flatnonzero(same | ~ends)
        busy = np.unique(np.concatenate((busy, [0]))) if len(his) else busy
        for i in busy.tolist():
            now = (int(his[i]), int(los[i]))
            if now != key:
                if started:
                    close(False)
                    first = False
                key, docs, top, held = now, 0, int(ids[i]), []
                # A run that is not the first row of the partition cannot go on from before.
                first = not started
                started = True
            doc, at = int(ids[i]), places[i].as_py()
            docs += docs == 0 or doc != before
            before = doc
            if first:
                out.append((_OPEN, *key, doc, at, None))
            elif docs < min_docs:
                held.append((doc, at))
            else:
                out.extend((_DROP, *key, d, a, None) for d, a in held if d != top)
                held = []
                if doc != top:
                    out.append((_DROP, *key, doc, at, None))
        if len(out) >= 20_000:
            yield flush()
    close(True)
    yield flush()


def dropped_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, places (binary, little-endian 32-bit line numbers): the lines that a document loses,
    in one row for each of its keys."""
    lines = map_texts(docs.where(F.col(doc_id).isNotNull()), lambda ids, texts: _keys(ids, texts, min_points), _LINES, doc_id, text)
    ranged = lines.repartitionByRange("hi", "lo", F.desc("doc_id")).sortWithinPartitions("hi", "lo", F.desc("doc_id"))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _MARKED).schema)
    marked = staged(ranged.select("hi", "lo", "doc_id", "at").mapInArrow(lambda it: _stream(it, min_docs, schema), _MARKED), "lines")
    # At most two rows per partition of the pass.
    runs = marked.where(F.col("kind") == _SUMMARY).groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs)
    opened = marked.where(F.col("kind") == _OPEN).join(F.broadcast(runs), ["hi", "lo"]).where(F.col("doc_id") != F.col("top"))
    return marked.where(F.col("kind") == _DROP).select("doc_id", F.col("at").alias("places")).unionByName(opened.select("doc_id", F.col("at").alias("places")))


def pack(n_lines: int, dropped: list[int]) -> bytes:
    """The compressed bitmap of the lines to keep."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bitmap: which lines stay, for each document that loses any. No text is returned. The
    bitmap ends at the last dropped line; later lines stay."""
    drops = dropped_lines(docs, min_points, min_docs, doc_id, text).groupBy("doc_id").agg(F.collect_list("places").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for parts in batch.column(1).to_pylist():
                lines = np.frombuffer(b"".join(parts), "<u4")
                maps.append(struct.pack("<I", int(lines.max()) + 1) + pack(int(lines.max()) + 1, lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["doc_id", "bitmap"])

    return drops.mapInArrow(run, "doc_id long, bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, the number of its lines, and of those dropped."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    size = struct.unpack("<I", bitmap[:4])[0]
    keep = unpack(bitmap[4:], size)
    kept = [line for i, line in enumerate(lines) if i >= size or keep[i]]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _with_bitmaps(docs: DataFrame, doc_id: str, text: str, **limits: int) -> DataFrame:
    bitmaps = keep_bitmaps(docs, doc_id=doc_id, text=text, **limits).withColumnsRenamed({"doc_id": "__line_doc", "bitmap": "__line_bitmap"})
    return docs.join(bitmaps, F.col(doc_id) == F.col("__line_doc"), "left").drop("__line_doc")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    joined = _with_bitmaps(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = [kept_text(t, m) for t, m in zip(binary(part.column(1)).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.select("doc_id", "text", "__line_bitmap").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **limits: int) -> DataFrame:
    """The documents with what is left of their texts; a column of code points follows the text, and
    a null text that loses nothing stays null."""
    joined = _with_bitmaps(docs, doc_id, text, **limits)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            columns = {n: part.column(i) for i, n in enumerate(names)}
            maps = part.column(len(names)).to_pylist()
            if any(m is not None for m in maps):
                old = columns[text]
                texts = [kept_text(t or b"", m)[0] if m is not None else t for t, m in zip(old.cast(pa.large_binary() if pa.types.is_large_string(old.type) else pa.binary()).to_pylist(), maps)]
                columns[text] = pa.array(texts, pa.binary()).cast(old.type)
                if n_chars in columns:
                    kind = columns[n_chars].type
                    columns[n_chars] = pa.array([code_points(t) if m is not None else n for t, m, n in zip(texts, maps, columns[n_chars].to_pylist())], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.select(*names, "__line_bitmap").mapInArrow(run, docs.schema)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, place, line, coalesce(doc_id <> top, false) AS dropped FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
