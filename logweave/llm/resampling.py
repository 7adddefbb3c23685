"""Importance resampling towards a target: documents are drawn whose hashed words and word pairs are
likelier in the target's texts than in the corpus.

Features of a text are its words and its pairs of consecutive words, joined by a space, each as a
bucket: the CRC-32 of its bytes modulo the number of buckets. A CRC can be carried on: from the CRC of
"word " and that of the next word comes the CRC of the pair, by tables for the second word's length.

- Head. Words are counted over all documents; the most frequent HEAD_WORDS are broadcast with the CRC
  of the word and that of the word and a space. Of the first PAIR_WORDS of these, the buckets of all
  pairs are broadcast as a square. A pair that is more frequent than the last of these words can only
  be made of them, so the square holds every such pair.
- Tail. Other words get their CRC from their bytes, other pairs theirs from the CRCs of both words.

Both ways give the same exact bucket, so the choice of the head changes no result. Passes over the
texts: word counts, bucket totals of documents and of the target, weights. Each keeps a batch's words
in memory, of a long text a piece of about PIECE bytes with the last word of the piece before.

Scores are integers, so there are few: a table of how many rows each has, with the sums above, is
broadcast, and rows are ranked inside their score. Rows are never sorted as a whole.

Defined results: null and empty texts have no words, no features and weight 0, and still a score. A
null id is the text "null" in the draw. Rows with equal ids are rows of their own and stand together in
the order of ties. An empty corpus gives no rows, an empty target gives T = 0. Other columns are not
read."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import begins, counted, each_copy, numbers_within
from .sharding import CRC_TABLE_SQL, crc_sql
from .text import WORD_BYTES, Shared, binary, slices, staged

BUCKETS = 10_000
#: Words whose CRCs are broadcast, and how many of them are in the square of pairs: at most some 8 MB.
HEAD_WORDS, PAIR_WORDS = 65_536, 1024
#: Longest word in bytes that a head has. Second words up to this length are joined by tables, longer ones by their bytes.
TABLE_BYTES = 64
PIECE = 1 << 20
#: Bytes of text whose words are counted before they are sent on.
COUNTED = 1 << 24
SEED, MIN_WORDS, SHARE = 7, 20, (25, 100)
#: Scores whose totals are summed as one band first.
BAND_BITS = 8


def _shift_tables(n: int) -> np.ndarray:
    """[length, byte, value]: what a CRC with that value in that byte becomes behind `length` zero bytes."""
    values = np.arange(256, dtype=np.uint32)
    step = values.copy()
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ ((step & np.uint32(1)) * np.uint32(0xEDB88320))
    tables = np.empty((n + 1, 4, 256), np.uint32)
    tables[0] = values << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for i in range(1, n + 1):
        tables[i] = (tables[i - 1] >> np.uint32(8)) ^ step[tables[i - 1] & np.uint32(255)]
    return tables


_SHIFTS = _shift_tables(TABLE_BYTES)


def joined_crcs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of left texts followed by right ones of at most TABLE_BYTES bytes, from the CRCs of both."""
    own, byte = _SHIFTS.reshape(-1), np.uint32(255)
    at = sizes * 1024
    out = right.copy()
    for k in range(4):
        out ^= own[at + 256 * k + ((left >> np.uint32(8 * k)) & byte)]
    return out


class Head:
    """CRCs of the frequent words, the most frequent first, and the buckets of pairs of the first ones."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS, pair_words: int = PAIR_WORDS):
        words = [w for w in words if len(w) <= TABLE_BYTES]
        self.buckets = buckets
        self.number = {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.opened = np.array([zlib.crc32(w + b" ") for w in words], np.uint32)
        first = words[:pair_words]
        self.side = len(first)
        sizes = np.array([len(w) for w in first], np.int64)
        self.pairs = np.empty((self.side, self.side), np.min_scalar_type(buckets))
        for i in range(self.side):
            self.pairs[i] = joined_crcs(np.full(self.side, self.opened[i]), self.crc[: self.side], sizes) % np.uint32(buckets)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the words, and of each word with the next."""
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        known = np.fromiter((self.number.get(w, -1) for w in code), np.int64, len(code))
        sizes = np.fromiter(map(len, code), np.int64, len(code))
        crc, opened = np.empty(len(code), np.uint32), np.empty(len(code), np.uint32)
        head = known >= 0
        crc[head], opened[head] = self.crc[known[head]], self.opened[known[head]]
        names = list(code)
        for i in np.flatnonzero(~head).tolist():
            crc[i] = zlib.crc32(names[i])
            opened[i] = zlib.crc32(b" ", int(crc[i]))
        a, b = at[:-1], at[1:]
        out = np.empty(len(a), np.int64)
        ka, kb = known[a], known[b]
        frequent = (ka >= 0) & (kb >= 0) & (ka < self.side) & (kb < self.side)
        out[frequent] = self.pairs[ka[frequent], kb[frequent]]
        rest = np.flatnonzero(~frequent)
        long = sizes[b[rest]] > TABLE_BYTES
        short = rest[~long]
        out[short] = joined_crcs(opened[a[short]], crc[b[short]], sizes[b[short]]) % np.uint32(self.buckets)
        for i in rest[long].tolist():
            out[i] = zlib.crc32(names[b[i]], int(opened[a[i]])) % self.buckets
        return (crc % np.uint32(self.buckets)).astype(np.int64)[at], out


def pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists from about `limit` bytes each, in order."""
    if len(text) <= limit:
        yield text.translate(WORD_BYTES).split()
        return
    spaced = text.translate(WORD_BYTES)
    start = 0
    while start < len(spaced):
        end = spaced.find(b" ", start + limit)
        end = len(spaced) if end < 0 else end
        yield spaced[start:end].split()
        start = end


def runs(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[list[int], list[list[bytes]], bytes | None]]:
    """Numbers of texts with their words, about `limit` bytes at a time. For a later piece of a long
    text, also the word before it."""
    held: tuple[list[int], list[list[bytes]]] = ([], [])
    size = 0
    for i, text in enumerate(texts):
        if len(text) > limit:
            before = None
            for words in pieces(text, limit):
                if words:
                    yield [i], [words], before
                    before = words[-1]
            continue
        held[0].append(i)
        held[1].append(next(pieces(text, limit)))
        size += len(text)
        if size >= limit:
            yield *held, None
            held, size = ([], []), 0
    if held[0]:
        yield *held, None


def _run_features(head: Head, lists: list[list[bytes]], before: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of pairs, with the place in `lists` that each is of."""
    words = list(chain.from_iterable(lists)) if before is None else [before, *lists[0]]
    place = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if not words:
        none = np.empty(0, np.int64)
        return none, none, none, none
    single, pair = head.features(words)
    if before is not None:
        return single[1:], place, pair, place
    inside = place[1:] == place[:-1]
    return single, place, pair[inside], place[1:][inside]


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(text).cast("string").alias("text"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word binary, n: how often each word that a head may have occurs in all texts. Counts are added
    up for COUNTED bytes of text before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        size = 0

        def sent() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) <= TABLE_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for part in slices(batches, 0):
            for body in binary(part.column(0)).to_pylist():
                for words in pieces(body):
                    counts.update(words)
                    size += sum(map(len, words))
                    if size >= COUNTED:
                        yield sent()
                        counts, size = Counter(), 0
        yield sent()

    return _texts(docs, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(docs: DataFrame, text: str = "text", words: int = HEAD_WORDS, buckets: int = BUCKETS) -> Head:
    """At most `words` of the most frequent words of all documents, on the driver. Counts fall into
    classes, 16 for each doubling; the head is of as many whole classes as it has room for, so no
    more words than that leave the tasks."""
    counts = staged(word_counts(docs, text).withColumn("class", F.floor(16 * F.log2("n")).cast("int")), "words")
    least, held = None, 0
    for r in sorted(counts.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        held += r.n
        if held > words:
            break
        least = r["class"]
    top = counts.where(F.col("class") >= least).select("word", "n").collect() if least is not None else []
    return Head([bytes(r.word) for r in sorted(top, key=lambda r: (-r.n, bytes(r.word)))], buckets)


def bucket_totals(docs: DataFrame, head: Shared, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket. A task sends one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, 0):
            for _, lists, before in runs(binary(part.column(0)).to_pylist()):
                single, _, pair, _ = _run_features(head.value, lists, before)
                total += np.bincount(single, minlength=buckets) + np.bincount(pair, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    rows = _texts(docs, text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, head: Shared, gain: Shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            size = part.num_rows
            words, features, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for numbers, lists, before in runs(binary(part.column(1)).to_pylist()):
                single, at, pair, pair_at = _run_features(head.value, lists, before)
                numbers = np.array(numbers)
                words += np.bincount(numbers[at], minlength=size)
                features += np.bincount(numbers[at], minlength=size) + np.bincount(numbers[pair_at], minlength=size)
                np.add.at(total, numbers[at], gain.value[single])
                np.add.at(total, numbers[pair_at], gain.value[pair])
            mean = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(features), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _texts(docs, text, F.col(doc_id).alias("doc_id")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def _scored(rows: DataFrame, seed: int) -> Column:
    """The weight and a Gumbel draw from the id's hash, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def draw(rows: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of a table of weights: of the rows with at least
    min_words words, the share of the highest scores is drawn, ties to smaller ids."""
    rows = rows.withColumn("score", _scored(rows, seed)).withColumn("able", F.col("n_words") >= min_words).drop("n_words")
    # One row for each score: a few ten thousand, as weights and draws are thousandths of logarithms.
    by_score = rows.where("able").groupBy("score").agg(F.count("*").alias("copies")).withColumn("band", F.shiftright("score", BAND_BITS))
    bands = begins(by_score.groupBy("band").agg(F.sum("copies").alias("copies")), [], "band", descending=True).withColumnRenamed("begin", "above")
    n = by_score.agg(F.sum("copies")).first()[0] or 0
    drawn = n * share[0] // share[1]
    placed = begins(by_score, ["band"], "score", descending=True).join(F.broadcast(bands), "band")
    placed = placed.select("score", (F.col("above") + F.col("begin")).alias("begin")).where(F.col("begin") < drawn)
    held = rows.join(F.broadcast(placed), "score", "left")
    columns = ["doc_id", "n_features", "weight", "score"]
    out = held.where(~F.col("able") | F.col("begin").isNull()).select(*columns, F.lit(None).cast("long").alias("rank"))
    tied = counted(held.where(F.col("able") & F.col("begin").isNotNull()).select(*columns, "begin"))
    numbered = numbers_within(tied, ["score"], ["doc_id", "n_features", "part"])
    ranked = numbered.select(*columns, (each_copy(numbered)).alias("rank")).withColumn("rank", F.col("rank") + 1)
    return out.unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    spark = docs.sparkSession
    head = Shared(spark, head_of(docs, text, buckets=buckets))
    gain = Shared(spark, gains(bucket_totals(docs, head, buckets, text), bucket_totals(target, head, buckets, target_text)))
    return draw(staged(weights(docs, head, gain, doc_id, text), "weights"), share, min_words, seed)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BOTH_SQL = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
ORACLE = rf"""
WITH {CRC_TABLE_SQL}, texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS words FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, {_WORDS_SQL} FROM benchmark
), features AS (
  SELECT side, r, unnest({_BOTH_SQL}) AS feature FROM texts
), bucketed AS (
  SELECT feature, {crc_sql("encode(feature)")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM features), crc_table
), counts AS (
  SELECT side, r, bucket, count(*) AS n FROM features JOIN bucketed USING (feature) GROUP BY ALL
), totals AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counts GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(sum(s) OVER (), 0) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM totals
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM counts JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(words) >= {MIN_WORDS} AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT * FROM texts WHERE side = 0) LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (able) OVER () * {SHARE[0]} // {SHARE[1]} AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM ranked
"""
