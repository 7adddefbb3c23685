"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts and windows are written as lower-case words between single spaces. The windows of one length
class share a table that says, for each hashed block of eight bytes, how far the search may skip when that
block ends where a window of the least length would end. Places that allow no skip are looked up by
the hash of the last bytes of that least length, and the bytes are then compared directly.

The benchmark is read in blocks of bounded size (BLOCK_BYTES). A benchmark of one block is searched for
as documents are read. Of a larger one, each block has a pass of its own: its broadcast is released before
the next is made, so neither driver nor workers hold more than one, and what it finds is written by the
digest of the text. All findings of a text are then added up, and rows take those of their text.
Null texts have no words. An item without words has no window, one of fewer than ten is a window of
its own. Repeated rows give repeated results, repeated item ids count once. Columns other than ids
and texts are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD_BYTES, binary, map_texts, slices, staged

WINDOW = 10
#: Bytes of benchmark text that are searched for at once, and so the size of a broadcast.
BLOCK_BYTES = 16 << 20
#: Windows below this many bytes form a class of their own, as they allow only short skips.
SHORT = 24
#: Bytes of a block, bits of the shift table's index, bytes of text that one lane walks through.
_BLOCK, _BITS, _LANE = 8, 21, 1024

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_starts array<int>, hit_ends array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Each window of an item, as the bytes that stand for it in a normalised text."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _last_bytes(raw: bytes) -> np.ndarray:
    """For each place 0..len: the eight bytes before it as one number, the last byte highest."""
    return np.ndarray((len(raw) + 1,), "<u8", b"\n" * 8 + raw, strides=(1,))


def _block_keys(before: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the blocks of `size` bytes that end at `at`."""
    with np.errstate(over="ignore"):
        return (before[at] >> np.uint64(64 - 8 * size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)


def _tail_keys(before: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the last eight bytes, or sixteen if so many are certain, that end at `at`."""
    with np.errstate(over="ignore"):
        key = (before[at] >> np.uint64(64 - 8 * min(8, least))) * np.uint64(0xD6E8FEB86659FD93)
        return key ^ (before[at - 8] * np.uint64(0xA0761D6478BD642F) >> np.uint64(7)) if least >= 16 else key


@dataclass
class Search:
    """Tables for windows of one length class."""

    patterns: list[bytes]
    least: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    buckets: list[list[int]]

    @classmethod
    def of(cls, patterns: list[bytes]) -> Search:
        least = min(map(len, patterns))
        block = min(_BLOCK, least)
        before = _last_bytes(b"".join(p[:least] for p in patterns))
        rows = np.arange(len(patterns)) * least
        shift = np.full(1 << _BITS, least - block + 1, np.int32)
        for end in range(block, least + 1):
            np.minimum.at(shift, _block_keys(before, rows + end, block), least - end)
        by: dict[int, list[int]] = defaultdict(list)
        for i, key in enumerate(_tail_keys(before, rows + least, least).tolist()):
            by[key].append(i)
        keys = np.array(sorted(by), np.uint64)
        return cls(patterns, least, block, shift, keys, [by[int(k)] for k in keys])

    def find(self, raw: bytes) -> list[tuple[int, int]]:
        """Places and patterns of all occurrences."""
        last = len(raw) - self.least  # the last place where one can begin
        if last < 0:
            return []
        before = _last_bytes(raw)
        at = np.arange(0, last + 1, _LANE)
        stop = np.minimum(at + _LANE, last + 1)
        stopped: list[np.ndarray] = []
        while len(at):
            step = self.shift[_block_keys(before, at + self.least, self.block)]
            zero = step == 0
            if zero.any():
                stopped.append(at[zero])
            at = at + np.maximum(step, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        if not stopped:
            return []
        places = np.concatenate(stopped)
        tails = _tail_keys(before, places + self.least, self.least)
        slot = np.minimum(np.searchsorted(self.keys, tails), len(self.keys) - 1)
        same = self.keys[slot] == tails
        found = []
        for place, bucket in zip(places[same].tolist(), slot[same].tolist()):
            for i in self.buckets[bucket]:
                if raw.startswith(self.patterns[i], place):
                    found.append((place, i))
        return found


def tables(items: list[tuple[str, bytes]], size: int = WINDOW) -> list[tuple[Search, list[list[str]], list[int]]]:
    """For each length class: the search, and of each pattern its items and its number of words."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows(words_of(text), size):
            owners[window].add(item)
    classes: dict[int, list[bytes]] = defaultdict(list)
    for window in sorted(owners):
        classes[0 if len(window) < 6 else 1 if len(window) < SHORT else 2].append(window)
    return [(Search.of(ps), [sorted(owners[p]) for p in ps], [p.count(b" ") - 1 for p in ps]) for _, ps in sorted(classes.items())]


def search(texts: list[bytes], blocks: list) -> list[tuple[int, np.ndarray, set[str]]]:
    """Of each text: its number of words, which of them are hit, and the items that occur in it."""
    split = [words_of(t) for t in texts]
    normal = [b" " + b" ".join(w) + b" " if w else b" " for w in split]
    raw = b"\n".join(normal) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    spaces = np.flatnonzero(data == 32)
    doc_spaces = np.concatenate(([0], np.cumsum([len(w) + 1 for w in split])))
    edge = np.zeros(len(spaces) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for block in blocks:
        for find, owners, counts in block:
            hits = find.find(raw)
            if hits:
                at = np.searchsorted(spaces, [p for p, _ in hits])
                sizes = np.array([counts[i] for _, i in hits])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + sizes, -1)
                for doc, i in set(zip((np.searchsorted(doc_spaces, at, side="right") - 1).tolist(), (i for _, i in hits))):
                    items[doc].update(owners[i])
    hit = np.cumsum(edge) > 0
    return [(len(w), hit[doc_spaces[d] : doc_spaces[d] + len(w)], items.get(d, set())) for d, w in enumerate(split)]


def _row(n: int, hit: np.ndarray, items: set[str]) -> tuple:
    """What SCHEMA says of a text of n words, but for its id."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    names = sorted(items)
    return n, int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit.any()), names, edge[0::2].tolist(), edge[1::2].tolist()


def _rows(found: list) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]}
    for n, hit, items in found:
        for column, value in zip(out, _row(n, hit, items)):
            out[column].append(value)
    return out


class _Blocks:
    """The benchmark's items in blocks of about BLOCK_BYTES, one of which is broadcast at a time."""

    def __init__(self, benchmark: DataFrame, item_id: str, item_text: str):
        self.items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
        total = self.items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
        self.n = max(1, -(-total // BLOCK_BYTES))

    def shared(self, b: int):
        own = self.items.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == b)
        return self.items.sparkSession.sparkContext.broadcast(sorted({(r.i, r.t.encode()) for r in own.collect()}))


_FOUND = "digest string, block int, items array<string>, hit_starts array<int>, hit_ends array<int>"


def _searcher(shared, size: int):
    """Search for one broadcast block, whose tables a task builds once."""
    built: list = []

    def find(texts: list[bytes]) -> list:
        if not built:
            built.append(tables(shared.value, size))
        return search(texts, built)

    return find


def _found_by_block(docs: DataFrame, blocks: _Blocks, size: int, text: str) -> DataFrame:
    """digest, block, items, hit ranges: of each text that a block's windows occur in, one row a block."""
    parts = []
    texts_alone = docs.select(F.lit(0).alias("__none"), F.col(text).alias("text"))
    for b in range(blocks.n):
        shared = blocks.shared(b)
        find = _searcher(shared, size)

        def step(_, texts, find=find, b=b):
            hits = [(t, hit, sorted(names)) for t, (_, hit, names) in zip(texts, find(texts)) if hit.any()]
            edges = [np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))) for _, hit, _ in hits]
            return {"digest": [hashlib.sha256(t).hexdigest() for t, _, _ in hits], "block": [b] * len(hits), "items": [n for _, _, n in hits], "hit_starts": [e[0::2].tolist() for e in edges], "hit_ends": [e[1::2].tolist() for e in edges]}

        parts.append(staged(map_texts(texts_alone, step, _FOUND, "__none").dropDuplicates(["digest"]), "found"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _in_passes(docs: DataFrame, blocks: _Blocks, size: int, doc_id: str, text: str) -> DataFrame:
    found = _found_by_block(docs, blocks, size, text).groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_starts")).alias("hit_starts"), F.flatten(F.collect_list("hit_ends")).alias("hit_ends"))
    counts = map_texts(docs, lambda ids, texts: {"doc_id": ids, "n_words": [len(words_of(t)) for t in texts], "digest": [hashlib.sha256(t).hexdigest() for t in texts]}, "doc_id long, n_words long, digest string", doc_id, text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]}
            for n, items, begins, ends in zip(*(c.to_pylist() for c in batch.columns[1:])):
                hit = np.zeros(n, bool)
                for x, y in zip(begins or (), ends or ()):
                    hit[x:y] = True
                for column, value in zip(out, _row(n, hit, set(items or ()))):
                    out[column].append(value)
            arrays = [batch.column(0), *(pa.array(out[f.name], f.type) for f in _arrow_schema()[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return counts.join(found, "digest", "left").select("doc_id", "n_words", "items", "hit_starts", "hit_ends").mapInArrow(add, SCHEMA)


def _arrow_schema() -> list[pa.Field]:
    strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), strings, ints, ints)
    return [pa.field(c.split()[0], kind) for c, kind in zip(SCHEMA.split(", "), kinds)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, hit words with their ranges, and the items that occur in it."""
    blocks = _Blocks(benchmark, item_id, item_text)
    if blocks.n > 1:
        return _in_passes(docs, blocks, size, doc_id, text)
    find = _searcher(blocks.shared(0), size)
    return map_texts(docs, lambda ids, texts: {"doc_id": ids, **_rows(find(texts))}, SCHEMA, doc_id, text)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no window occurs in, all columns as they are, judged where they are read."""
    blocks = _Blocks(benchmark, item_id, item_text)
    if blocks.n > 1:
        found = _found_by_block(docs, blocks, size, text).select(F.col("digest").alias("__digest")).distinct()
        digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
        return docs.withColumn("__digest", digest).join(found, "__digest", "left_anti").drop("__digest")
    shared = blocks.shared(0)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _searcher(shared, size)
        for part in slices(batches, at):
            yield part.filter(pa.array([not hit.any() for _, hit, _ in find(binary(part.column(at)).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, t)
), words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
