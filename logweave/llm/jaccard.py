"""Self-join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Documents with the same set of n-grams form one class, and its smallest id stands for it.
2. A signature holds one byte of each of 128 MinHash values. Bands of four bytes are looked up in
   buckets; a bucket with more than CELL documents is dealt into cells, pairs of blocks, so that no
   task holds a bucket as a whole. A pair is compared in the first band it shares.
3. Pairs are compared 32 bytes at a time. After each step the posterior of the similarity, under a
   uniform prior, tells how likely the threshold is; below TOLERANCE the pair is dropped.
4. What is left of a cell goes on as a spanning forest, not as pairs. Components of these links keep
   together all documents that can be similar.
5. In each component, again dealt into cells, pairs go through the same pruning, and what is left is
   verified exactly on the sets of n-grams; links are counted, and a forest of them gives the final
   components. The rule is one for groups of all sizes.

A pair at the threshold escapes all 32 bands with probability (1 - 0.8**4)**32 < 1e-7, if no other
link brings it into one component, and pruning loses it with a probability near TOLERANCE.

Words are runs of letters, digits and other characters beyond ASCII, in lower case. A text of fewer
than five words has one n-gram, of all its words. Texts without words, and null texts, have none and
are linked to nothing; rows without an id neither. Rows that repeat an id and its text are copies;
of different sets of n-grams with one id, that of the least digest is compared, and a row of another
set is in the class of its set, or else in one of its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import leads
from .text import WORD_BYTES, binary, joined, map_texts, mix, slices, span_hashes, staged, word_spans

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP = 128, 4, 32
#: A pair is dropped when the probability that it reaches the threshold is below this.
TOLERANCE = 1e-6
#: Documents of a block; a cell holds two blocks.
CELL = 256
#: Pairs of a group from which on their common n-grams are counted together.
PRODUCT = 256

_SIGNED = "doc_id long, n_shingles long, hi long, lo long, sig binary"


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and how many each has."""
    data, bounds = joined([t.translate(WORD_BYTES) for t in texts])
    starts, ends = word_spans(data)
    n = len(texts)
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    words = span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        rolling, factor = words.copy(), 1
        for k in range(1, size):
            factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
            # Beyond the end of a short text nothing is added.
            reach = len(words) - k
            if reach <= 0:
                break
            rolling[:reach] += np.where(owner[k:] == owner[:reach], words[k:], np.uint64(0)) * np.uint64(factor)
        place = np.arange(len(words)) - first[owner] if len(words) else np.zeros(0, np.int64)
        whole = (place + size <= counts[owner]) | (place == 0)
        grams, owner = mix(rolling[whole]), owner[whole]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(owner[new], minlength=n)


@lru_cache
def _factors() -> list[tuple[int, int]]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return [(int(a) | 1, int(b)) for a, b in zip(seeds[::2], seeds[1::2])]


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[text, 128] bytes; rows of texts without n-grams are zero."""
    out = np.zeros((len(counts), HASHES), np.uint8)
    have = np.flatnonzero(counts)
    if not len(have):
        return out
    starts = (np.cumsum(counts) - counts)[have]
    work = np.empty_like(grams)
    with np.errstate(over="ignore"):
        for j, (a, b) in enumerate(_factors()):
            np.multiply(grams, np.uint64(a), out=work)
            np.add(work, np.uint64(b), out=work)
            # The value is the upper half; the signature takes a byte from its lower end.
            out[have, j] = np.minimum.reduceat(work >> np.uint64(32), starts) & np.uint64(0xFF)
    return out


def digests(grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two numbers for each set of n-grams."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(seed)), dtype=np.uint64))) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        return [(s[ends] - s[ends - counts] + counts.astype(np.uint64)).view(np.int64) for s in sums]


def _signed(ids, texts: list[bytes], size: int) -> dict:
    grams, counts = shingles(texts, size)
    sigs = signatures(grams, counts)
    hi, lo = digests(grams, counts)
    return {"doc_id": ids, "n_shingles": counts, "hi": hi, "lo": lo, "sig": [s.tobytes() for s in sigs]}


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After how many compared bytes, how many must be equal for the pair to go on."""
    j = (np.arange(20_000) + 0.5) / 20_000
    equal = j + (1 - j) / 256  # bytes of different values agree by chance
    least = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            density = m * np.log(equal) + (n - m) * np.log1p(-np.minimum(equal, 1 - 1e-12))
            density = np.exp(density - density.max())
            if density[j >= threshold].sum() >= tolerance * density.sum():
                least[n] = m
                break
    return least


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signature rows are left after all steps."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in sorted(least_matches(threshold).items()):
        matches = matches + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
        on = matches >= least
        alive, matches = alive[on], matches[on]
    return alive


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that are equal in the first `n_keys` columns, at least `rows`
    long if so many are left. Input is sorted by these columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(size - 1, bool)
            for c in range(n_keys):
                values = table.column(c).to_numpy()
                same &= values[1:] == values[:-1]
            cuts = np.flatnonzero(~same)
            if len(cuts):
                at = int(cuts[-1]) + 1
                yield table.slice(0, at)
                table = table.slice(at)
            held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_numbers(table: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in range(n_keys):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _pairs(group: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one group, by their distance: all pairs of a cell of one block, pairs across the blocks
    of any other."""
    left, d = np.arange(len(group) - 1), 1
    while len(left):
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]
        across = (i[left] == j[left]) | (block[left] != block[left + d])
        if across.any():
            yield left[across], left[across] + d
        d += 1


def forest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id that links lead to, its own without a link."""
    label = ids.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            break
    return label


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Cells of buckets (key, i, j, block, rep, sig) to links (a, b)."""
    for table in _groups(batches, 3, 20_000):
        key, i, j, block, rep = (table.column(c).to_numpy() for c in range(5))
        sig = _unpacked(table.column(5))
        bands = sig.view("<u4")
        band = key >> 32
        group = _group_numbers(table, 3)
        left, right = [], []
        for a, b in _pairs(group, i, j, block):
            shared = bands[a] == bands[b]
            first = np.argmax(shared, axis=1) == band[a]
            a, b = a[first], b[first]
            on = survivors(sig[a], sig[b], threshold)
            left.append(a[on])
            right.append(b[on])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if len(a):
            root = forest(len(rep), a, b, rep)
            moved = np.flatnonzero(root != rep)
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(root[moved])], names=["a", "b"])


def _common(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The number of common n-grams of all pairs of `rows`, from products of their incidence columns."""
    values = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    distinct, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    used = np.cumsum(counts > 1) - 1
    shared = counts[column] > 1
    column, owner = used[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (begin, begin + 2048))
        part = np.zeros((len(rows), 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - begin] = 1
        total += part @ part.T
    return total


def _common_of_pairs(sets: list[np.ndarray], group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact number of common n-grams of each pair: set by set, or by one product for a group that
    has many pairs left."""
    out = np.zeros(len(a))
    pairs = np.bincount(group[a], minlength=int(group[-1]) + 1 if len(group) else 0)
    many = pairs[group[a]] > PRODUCT
    for k in np.flatnonzero(~many).tolist():
        out[k] = len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True))
    for g in np.flatnonzero(pairs > PRODUCT).tolist():
        rows = np.flatnonzero(group == g)
        own = np.flatnonzero(many & (group[a] == g))
        out[own] = _common(sets, rows)[a[own] - rows[0], b[own] - rows[0]]
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Cells of components (root, i, j, block, rep, copies, sig, grams) to (rep, links, root)."""
    for table in _groups(batches, 3, 2_000):
        _, i, j, block, rep, copies = (table.column(c).to_numpy() for c in range(6))
        sig = _unpacked(table.column(6))
        sets = [np.frombuffer(g, np.uint64) for g in table.column(7).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        group = _group_numbers(table, 3)
        left, right = [], []
        for a, b in _pairs(group, i, j, block):
            on = survivors(sig[a], sig[b], threshold)
            left.append(a[on])
            right.append(b[on])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        common = _common_of_pairs(sets, group, a, b)
        on = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
        left, right = [a[on]], [b[on]]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        root = forest(len(rep), a, b, rep)
        on = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(links[on].astype(np.int64)), pa.array(root[on])], names=["rep", "links", "root"])


def _cells(rows: DataFrame, key: str, member: str = "rep") -> DataFrame:
    """Deals the rows of a group of n into cells: blocks by a hash, each row to its block's pairs."""
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = rows.withColumn("k", blocks).withColumn("block", F.pmod(F.xxhash64(member), F.col("k")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def classes(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Signed documents, and classes of equal n-gram sets: hi, lo, rep, copies, sig."""
    signed = staged(map_texts(docs, lambda ids, texts: _signed(ids, texts, size), _SIGNED, doc_id, text), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Of an id with several sets the one with the least digest stands for it.
    digest = F.struct("hi", "lo")
    several = some.groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("doc_id", "least")
    some = some.join(several, "doc_id", "left").where(F.col("least").isNull() | (F.col("least") == digest)).drop("least")
    same = some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    return signed, staged(same, "classes")


def candidates(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that keep together all pairs of classes which pruning has left."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                keys = _unpacked(part.column(1)).view("<u4").astype(np.int64) | np.arange(HASHES // ROWS, dtype=np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), HASHES // ROWS))], names=["key", "rep"])

    banded = reps.select("rep", "sig").mapInArrow(bands, "key long, rep long")
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cells = _cells(banded.join(shared, "key"), "key").select("key", "i", "j", "block", "rep")
    rows = cells.join(reps.select("rep", "sig"), "rep").select("key", "i", "j", "block", "rep", "sig")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: _compare(it, threshold), "a long, b long")


def verified(docs: DataFrame, reps: DataFrame, together: DataFrame, size: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    """rep, links, root: exact links of each class in a cell, and where they lead."""
    sizes = together.groupBy("root").agg((F.count("*") + 1).alias("n"))
    members = together.join(sizes, "root").select("node", "root", "n").unionByName(sizes.select(F.col("root").alias("node"), "root", "n"))
    wanted = members.join(reps, F.col("node") == F.col("rep")).select("root", "n", "rep", "copies", "sig", "hi", "lo")
    texts = docs.select(F.col(doc_id).alias("rep"), F.col(text).cast("string").alias("text"))
    found = texts.join(wanted, "rep").select("rep", "text", "root", "n", "copies", "sig", "hi", "lo")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, counts = shingles(binary(part.column(1)).to_pylist(), size)
            packed = [g.tobytes() for g in np.split(grams, np.cumsum(counts)[:-1])]
            made = pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(0), part.column(4), part.column(5), pa.array(packed, pa.binary())], names=["root", "n", "rep", "copies", "sig", "grams"])
            # Of several texts of an id, those with the set that stands for it.
            hi, lo = digests(grams, counts)
            yield made.filter(pa.array((hi == part.column(6).to_numpy()) & (lo == part.column(7).to_numpy())))

    kept = found.mapInArrow(sets, "root long, n long, rep long, copies long, sig binary, grams binary").dropDuplicates(["rep"])
    rows = _cells(kept, "root")
    ordered = rows.select("root", "i", "j", "block", "rep", "copies", "sig", "grams").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(lambda it: _verify(it, threshold), "rep long, links long, root long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id that links lead to), n_links (documents
    at or above the threshold, copies included), n_copies (documents with the same set, itself
    included), n_shingles."""
    return _classified(*classes(docs, size, doc_id, text), docs, threshold, size, doc_id, text)


def _classified(signed: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, size: int, doc_id: str, text: str) -> DataFrame:
    together = leads(candidates(reps, threshold))
    exact = staged(verified(docs, reps, together, size, threshold, doc_id, text), "verified")
    roots = leads(exact.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("hi", "lo", "rep", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("hi", "lo", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined_rows = signed.drop("sig").join(known, ["hi", "lo"], "left")
    return joined_rows.select(
        "doc_id",
        F.when(some, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0))).otherwise(0).alias("n_links"),
        F.when(some, F.coalesce("copies", F.lit(1))).otherwise(1).alias("n_copies"),
        "n_shingles",
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a class of a smaller id; columns as they are. Of rows that
    repeat an id and its text one stays, the least in the other columns; rows without an id all stay."""
    signed, reps = classes(docs, size, doc_id, text)
    classed = _classified(signed, reps, docs, threshold, size, doc_id, text)
    dropped = classed.where("class_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    kept = docs.join(dropped, F.col(doc_id) == F.col("__dropped"), "left_anti")
    again = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    once = kept.join(again, F.col(doc_id) == F.col("__again"), "left_semi").groupBy(doc_id, text).agg(F.min(F.struct(*rest) if rest else F.lit(1)).alias("__rest"))
    once = once.select(*[F.col(f"__rest.{c}").alias(c) if c in rest else F.col(c) for c in docs.columns])
    return kept.join(again, F.col(doc_id) == F.col("__again"), "left_anti").unionByName(once)
