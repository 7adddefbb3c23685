"""Bigram language model over the whole corpus, as a sharded Elias-Fano trie that is built where it
is queried.

Every token, of training and of other documents, is dealt to a shard by its context, the word before
it. A shard has all that follows its contexts, so it counts them, builds its part of the trie, scores
its tokens, and sends on what the shard of the following word must add: the probability of that word
by itself. Nothing of the model goes through the driver but the number of tokens, the number of
words, and the counts of common words, hot words and hot pairs.

Hot is what training has HOT_TOKENS times or more, or with a share of 1/HOT or more. So there are at
most max(HOT, N / HOT_TOKENS) hot words and as many hot pairs, two millionths of the input's bytes.
Tokens behind a hot word are dealt by both words; their context's count, and what it leaves, are known
beforehand: the pairs behind hot words are counted in a pass of their own, and of a hot word the driver
gets how many pairs have which quantised probability, 255 numbers at most. Tokens of hot pairs are scored
where the text is read, and not dealt at all. So no key brings a shard more than about HOT_TOKENS
tokens. Hot or not decides on the place alone; no score depends on it.

Common words, at most COMMON of the most frequent, have their counts broadcast: what is found and ends
in one is finished in its shard, and only the rest goes on to the shards of the words. It is the same
sum either way.

Trie: the contexts' hashes, pointers to where each context's successors begin, and the successors as
numbers of words, relative to where the context before ends, all in Elias-Fano code; discounted
probabilities and the mass left to the lower order, each quantised to a byte; all in memory maps. A
query takes its context's range from the pointers and searches the successor within it.

p(w|v) = a(v,w) + left(v) * p(w). a is absolute discounting of pairs met MIN_COUNT times or more in
training, so of all, left what the context leaves. p(w) = (c + 0.5) / (N + 0.5 (V + 1)). The probabilities of all
words sum to one.

Tokens: A-Z in lower case, words between blanks, one end for each text. Null texts are empty, and have
the end alone. Rows stand for themselves, also repeated ones; an id may be null. Other columns are not
read. Batches of documents are known by the task that read them, so a task that runs again must read
the same rows: `docs` should be read from files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, mapped
from .text import Shared, binary, joined, mix, release, slices, span_hashes, staged, word_spans

FOLDS, HELD = 5, 1
DISCOUNT, MIN_COUNT = 0.75, 1
HOT, HOT_TOKENS = 64, 4_000_000
#: Words whose counts are broadcast: 1 MB.
COMMON = 65_536
#: Tokens of a shard, and bytes of text in a batch.
SHARD_TOKENS, BATCH_BYTES = 1_000_000, 4 << 20
#: Least number of shards; shards that one task works on, in turn; bytes of sums that a task adds up
#: before they leave it.
LEAST_SHARDS, SHARDS_A_TASK, SUM_BYTES = 64, 4, 32 << 20
#: Quantisation of log10 p: steps of STEP_SIZE, down to the 255th.
STEP_SIZE = 0.05

#: Hashes of the marks before and behind each text.
BEGIN, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_LOWER = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOB = "part int, kind int, batch long, data binary"
#: Kinds of rows: a batch's documents, counts of single words, tokens of a batch in a shard, tokens
#: that were found and wait for the single word, sums for a batch's documents.
_HEAD, _WORDS, _TOKENS, _FOUND, _SUMS = 0, 1, 2, 3, 4
#: Types of the sums of the first pass (base, known words, quantisation steps of what contexts leave,
#: gain of the common words found) and of the second (gain of the others).
_FIRST_SUMS, _GAINS = ("f8", "i8", "i8", "f4"), ("f4",)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob, each in the smallest unsigned type for its values."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max())))
        parts.append(np.array([len(a)], "<u4").tobytes() + a.dtype.str.encode().ljust(4) + a.tobytes())
    return b"".join(parts)


def unpack(blob: bytes | memoryview) -> list[np.ndarray]:
    arrays, at = [], 0
    while at < len(blob):
        n, kind = int(np.frombuffer(blob, "<u4", 1, at)[0]), np.dtype(bytes(blob[at + 4 : at + 8]).decode().strip())
        arrays.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return arrays


def held_out(ids: list, folds: int = FOLDS, held: int = HELD) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % folds == held if i is not None else False for i in ids], bool)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token of the texts, as hashes, and the number of each text's tokens."""
    data, bounds = joined([t.translate(_LOWER) for t in texts])
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends, 3)
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first) + 1
    text_ends = np.cumsum(counts) - 1
    inside = np.ones(int(counts.sum()), bool)
    inside[text_ends] = False
    follows = np.full(len(inside), END)
    follows[inside] = words
    context = np.concatenate(([BEGIN], follows[:-1])) if len(follows) else follows
    context[np.concatenate(([0], text_ends[:-1] + 1))] = BEGIN
    return context, follows, counts


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _part_of(number: int) -> int:
    """A part for what belongs to a batch, as any will do."""
    return (number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33


def is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def dealing_keys(context: np.ndarray, follows: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What decides on a token's shard: its context, behind a hot one both words."""
    with np.errstate(over="ignore"):
        return np.where(is_in(context, hot), mix(context * np.uint64(3) + follows), mix(context))


def hot_from(total: int) -> int:
    """The least count of a hot word or a hot pair."""
    return max(HOT + 1, min(-(-total // HOT), HOT_TOKENS))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def batch_blobs(context: np.ndarray, follows: np.ndarray, doc: np.ndarray, shards: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The tokens of a batch for each shard: contexts, words behind them, documents, counts. Documents
    are numbers, twice their place in the batch, and one more for those held out."""
    deal = dealing_keys(context, follows, hot)
    with np.errstate(over="ignore"):
        order = np.argsort((deal & np.uint64(0xFFFFFFFF00000000)) | (mix(context ^ mix(follows)) >> np.uint64(32)), kind="stable")
    deal, context, follows, doc = deal[order], context[order], follows[order], doc[order]
    entry = _runs(context, follows, doc)
    n = np.diff(np.append(entry, len(doc)))
    deal, context, follows, doc = deal[entry], context[entry], follows[entry], doc[entry]
    part = shard_of(deal, shards).astype(np.int64)
    cuts = np.append(_runs(part), len(part)) if len(part) else np.zeros(0, np.int64)
    for a, z in zip(cuts[:-1], cuts[1:]):
        v, w, d, c = context[a:z], follows[a:z], doc[a:z], n[a:z]
        pair = _runs(v, w)
        head = _runs(v[pair])
        sizes = lambda begins, total: np.diff(np.append(begins, total)) - 1
        yield int(part[a]), pack(v[pair][head], sizes(head, len(pair)), w[pair], sizes(pair, len(v)), d, c)


def blob_tokens(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, word, document, count of the entries of a shard's blob."""
    v, nv, w, nw, d, c = unpack(blob)
    nv, nw = nv.astype(np.int64) + 1, nw.astype(np.int64) + 1
    return np.repeat(np.repeat(v, nv), nw), np.repeat(w, nw), d.astype(np.int64), c.astype(np.int64)


def quantised(p: np.ndarray) -> np.ndarray:
    """log10 p in 254 steps; 255 stands for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP_SIZE), 254), 255).astype(np.uint8)


_VALUES = np.append(10.0 ** (-STEP_SIZE * np.arange(255)), 0.0)


def discounted(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Codes of a: pairs met `count` times behind contexts met `total` times."""
    return quantised(np.where(count >= MIN_COUNT, (count - DISCOUNT) / total, 0.0))


def left_over(taken: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Codes of what contexts leave: what the quantised probabilities of the words behind them, `taken`
    in all, leave, and at least the discount of one."""
    return quantised(np.maximum(1 - taken, DISCOUNT / np.maximum(total, 1)))


def gains(a: np.ndarray, left: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What pairs gain over the single word, in log10, from the codes of both and the word's probability."""
    return np.log10(_VALUES[a] + _VALUES[left] * p) - np.log10(p)


class Hot:
    """Hot words and, as numbers of two of them, hot pairs, with their counts in training; and the codes
    of what hot words leave. Also the counts of common words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.common, self.common_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pairs = self.pair_counts = np.zeros(0, np.int64)
        self.left = np.zeros(len(words), np.uint8)

    def numbers(self, context: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The number of each pair of hot words, -1 for others."""
        if not len(self.words):
            return np.full(len(context), -1)
        v, w = (np.searchsorted(self.words, x) for x in (context, follows))
        both = is_in(context, self.words) & is_in(follows, self.words)
        return np.where(both, v * len(self.words) + w, -1)

    def scored(self, number: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hot pairs: what the context adds to the base, whether it is a word, and what the pair
        gains over the single word."""
        v, w = np.divmod(self.pairs, len(self.words))
        word = self.words[v] != BEGIN
        left = _VALUES[self.left[v]]
        a = _VALUES[discounted(self.pair_counts, self.counts[v])]
        p = (self.counts[w] + 0.5) / z
        at = np.searchsorted(self.pairs, number)
        return np.where(word, np.log10(self.counts[v] + 0.5), 0.0)[at], word[at], (np.log10(a + left * p) - np.log10(p))[at]


class Trie:
    """Contexts and the words behind them, with quantised probabilities."""

    def __init__(self, context: np.ndarray, follows: np.ndarray, count: np.ndarray, hot: Hot):
        """Of distinct pairs in rising order, all met in training. Behind hot words they need not be
        all pairs."""
        head = _runs(context)
        v = context[head]
        sums = np.add.reduceat(count, head) if len(head) else np.zeros(0, np.int64)
        warm = is_in(v, hot.words)
        at = np.searchsorted(hot.words, v[warm])
        sums[warm] = hot.counts[at]
        size = np.diff(np.append(head, len(context)))
        a_code = discounted(count, np.repeat(sums, size))
        left = left_over(np.add.reduceat(_VALUES[a_code], head) if len(head) else np.zeros(0), sums)
        left[warm] = hot.left[at]
        self.contexts = EliasFano(v)
        self.counts = mapped(sums)
        self.left = mapped(left)
        has = a_code < 255
        words = np.unique(follows[has])
        self.words = EliasFano(words)
        self.n_words = len(words)
        rank = np.repeat(np.arange(len(v)), size)[has]
        number = np.searchsorted(words, follows[has])
        pointers = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(v)))))
        # A context's successors count on from the last one before it.
        last = np.where(pointers[1:] > pointers[:-1], number[np.maximum(pointers[1:] - 1, 0)] + 1, 0) if len(number) else np.zeros(len(v), np.int64)
        bases = np.concatenate(([0], np.cumsum(last)))
        self.pointers = EliasFano(pointers)
        self.successors = EliasFano(bases[rank] + number)
        self.codes = mapped(a_code[has])

    @property
    def nbytes(self) -> int:
        return sum(level.nbytes for level in (self.contexts, self.counts, self.left, self.words, self.pointers, self.successors, self.codes))

    def ranges(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of contexts, in rising order, begin and end."""
        return self.pointers.at(rank), self.pointers.at(rank + 1)

    def entries_before(self, place: np.ndarray) -> np.ndarray:
        """What the successors that begin at `place` count from."""
        return np.where(place > 0, self.successors.at(np.maximum(place - 1, 0)) + 1, 0) if self.successors.n else np.zeros(len(place), np.int64)

    def find(self, context: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs in rising order: counts of their contexts, codes of a, codes of what is left."""
        head = _runs(context)
        rank, known = self.contexts.successors(context[head])
        size = np.diff(np.append(head, len(context)))
        rank, known = np.repeat(rank, size), np.repeat(known, size)
        count = np.where(known, self.counts[np.minimum(rank, len(self.counts) - 1)], 0) if len(self.counts) else np.zeros(len(context), np.int64)
        left = np.where(known, self.left[np.minimum(rank, len(self.left) - 1)], 0).astype(np.uint8) if len(self.left) else np.zeros(len(context), np.uint8)
        by_word = np.argsort(follows, kind="stable")
        number, met = np.empty(len(follows), np.int64), np.empty(len(follows), bool)
        number[by_word], met[by_word] = self.words.successors(follows[by_word])
        code = np.full(len(context), 255, np.uint8)
        asked = np.flatnonzero(known & met)
        if not len(asked):
            return count, code, left
        begin, end = self.ranges(rank[asked])
        base = self.entries_before(begin)
        place, equal = self.successors.successors((base + number[asked]).astype(np.uint64))
        equal &= (begin <= place) & (place < end)
        code[asked[equal]] = self.codes[place[equal]]
        return count, code, left


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The rows of each part, from rows sorted by part."""
    part, rows = None, []
    for batch in batches:
        for p, kind, number, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            if p != part:
                if rows:
                    yield part, rows
                    release()
                part, rows = p, []
            rows.append((kind, number, memoryview(data.as_buffer())))
    if rows:
        yield part, rows
    release()


def _sparse(place: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places that occur, in rising order, and the sums of the values at each."""
    places, at = np.unique(place, return_inverse=True)
    return places, *(np.bincount(at, v, len(places)) for v in values)


def _pack_sums(kinds: tuple, places: np.ndarray, *sums: np.ndarray) -> bytes:
    """Only documents that have something to add take up room."""
    return pack(np.diff(places, prepend=0), *(s.astype(k) for s, k in zip(sums, kinds)))


def _added_up(rows: Iterator[tuple], kinds: tuple) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows as they come, but sums of one batch, as places and values, added up over the shards of a
    task, in the types of `kinds`, until they take up SUM_BYTES."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def flush():
        for number, sums in held.items():
            yield _part_of(number), _SUMS, number, _pack_sums(kinds, *_sparse(*map(np.concatenate, zip(*sums))))
        held.clear()

    for row in rows:
        if row[1] != _SUMS or not isinstance(row[3], tuple):
            yield row
            continue
        held.setdefault(row[2], []).append(row[3])
        size += sum(a.nbytes for a in row[3]) + 128
        if size > SUM_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _blob_batches(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "batch", "data"])

    for row in rows:
        held.append(row)
        size += len(row[3]) + 32
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _shard_rows(rows: list[tuple[int, int, bytes]], shards: int, hot: Hot, z: float) -> Iterator[tuple]:
    """First pass over a shard: the trie is built from its training tokens, and all are scored."""
    numbers, begins, parts = [], [0], []
    for _, number, data in rows:
        v, w, d, c = blob_tokens(data)
        parts.append((v, w, (d >> 1) + begins[-1], c, (d & 1).astype(bool)))
        numbers.append(number)
        begins.append(int(parts[-1][2].max()) + 1)
    v, w, doc, n, held = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((w, v))
    v, w, doc, n, held = v[order], w[order], doc[order], n[order], held[order]
    pair = _runs(v, w)
    size = np.diff(np.append(pair, len(v)))
    learned = np.add.reduceat(np.where(held, 0, n), pair)
    met = learned > 0
    trie = Trie(v[pair][met], w[pair][met], learned[met], hot)
    count, code, left = trie.find(v[pair], w[pair])
    warm = is_in(v[pair], hot.words)
    at = np.searchsorted(hot.words, v[pair][warm])
    count[warm], left[warm] = hot.counts[at], hot.left[at]
    entry = np.repeat(np.arange(len(pair)), size)
    word = v != BEGIN  # a context that is a word stands for that word's own token
    found = code < 255
    # What is left is a sum of steps, so a whole number.
    base = np.where(word, np.log10(count + 0.5)[entry], 0.0) * n
    common = found & is_in(w[pair], hot.common)
    gain = np.zeros(len(pair))
    own = np.flatnonzero(common)
    gain[own] = gains(code[own], left[own], (hot.common_counts[np.searchsorted(hot.common, w[pair][own])] + 0.5) / z)
    places, *sums = _sparse(doc, base, (word & (count > 0)[entry]) * n, np.where(found, 0, left.astype(np.int64))[entry] * n, gain[entry] * n)
    cuts = np.searchsorted(places, begins)
    for number, begin, a, z in zip(numbers, begins, cuts[:-1], cuts[1:]):
        yield 0, _SUMS, number, (places[a:z] - begin, *(s[a:z] for s in sums))
    # To the shards of the words: words, pairs with their codes, documents.
    chosen = np.flatnonzero((found & ~common)[entry])
    if not len(chosen):
        return
    e = entry[chosen]
    deal = dealing_keys(w[chosen], v[chosen], hot.words)
    with np.errstate(over="ignore"):
        order = np.argsort((deal & np.uint64(0xFFFFFFFF00000000)) | (mix(w[chosen] ^ mix(v[chosen])) >> np.uint64(32)), kind="stable")
    chosen, e, deal = chosen[order], e[order], deal[order]
    at = np.searchsorted(begins, doc[chosen], side="right") - 1
    inner = doc[chosen] - np.array(begins)[at]
    batch = np.array(numbers, np.uint64)
    part = shard_of(deal, shards).astype(np.int64)
    cuts = np.append(_runs(part), len(part))
    for a, z in zip(cuts[:-1], cuts[1:]):
        pairs = _runs(e[a:z])
        batches, of = np.unique(at[a:z], return_inverse=True)
        yield int(part[a]), _FOUND, 0, pack(w[chosen[a:z]][pairs], code[e[a:z]][pairs], left[e[a:z]][pairs], np.diff(np.append(pairs, z - a)), batch[batches], of, inner[a:z], n[chosen[a:z]])


def _word_rows(rows: list[tuple[int, int, bytes]], z: float, hot: np.ndarray, hot_counts: np.ndarray) -> Iterator[tuple]:
    """Second pass: the single words' probabilities are added to the tokens found."""
    words, counts = [hot], [hot_counts]
    for kind, _, data in rows:
        if kind == _WORDS:
            w, c = unpack(data)
            words.append(w)
            counts.append(c.astype(np.int64))
    words, counts = np.concatenate(words), np.concatenate(counts)
    words, first = np.unique(words, return_index=True)
    counts = counts[first]
    found = []
    for kind, _, data in rows:
        if kind != _FOUND:
            continue
        w, a, left, sizes, batch, at, inner, n = unpack(data)
        c = np.where(is_in(w, words), counts[np.minimum(np.searchsorted(words, w), len(words) - 1)], 0) if len(words) else np.zeros(len(w))
        p = (c + 0.5) / z
        gain = np.repeat(gains(a, left, p), sizes) * n
        found.append((batch[at], inner.astype(np.uint32), gain.astype(np.float32)))
    if not found:
        return
    batch, inner, gain = map(np.concatenate, zip(*found))
    del found
    order = np.argsort(batch, kind="stable")
    batch, inner, gain = batch[order], inner[order], gain[order]
    cuts = np.append(_runs(batch), len(batch))
    for b, e in zip(cuts[:-1], cuts[1:]):
        yield 0, _SUMS, int(batch[b]), _sparse(inner[b:e], gain[b:e])


def _document_rows(rows: list[tuple[int, bytes]], n_docs: int, total: int, z: float) -> dict[str, object] | None:
    """A batch's documents from its head and all sums."""
    head = next((d for k, d in rows if k == _HEAD), None)
    if head is None:
        return None
    ids, empty, held, n = unpack(head)
    base, known, left, gain = (np.zeros(len(ids)) for _ in range(4))
    for kind, data in rows:
        if kind == _SUMS:
            steps, *sums = unpack(data)
            at = np.cumsum(steps.astype(np.int64))
            if len(sums) > 1:
                base[at] += sums[0]
                known[at] += sums[1]
                left[at] -= STEP_SIZE * sums[2]
            gain[at] += sums[-1]
    base = base + np.log10(n_docs + 0.5) - n * np.log10(z)
    return {
        "doc_id": pa.array(ids.astype(np.int64), pa.int64(), mask=empty.astype(bool)),
        "held_out": held.astype(bool),
        "n_tokens": n.astype(np.int64),
        "n_known": known.astype(np.int64) + (n_docs > 0),
        "train_tokens": np.full(len(ids), total, np.int64),
        "base_score": base,
        "score": base + left + gain,
    }


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_counts(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """word (hash), c: counts of the words of training documents; END counts the documents. A task adds
    up what its batches have before rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BATCH_BYTES):
            learned = ~held_out(part.column(0).to_pylist(), folds, held)
            texts = [t for t, on in zip(binary(part.column(1)).to_pylist(), learned) if on]
            if texts:
                keys, counts = np.unique(tokens(texts)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])

    return docs.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def pair_counts(docs: DataFrame, hot: Hot, folds: int, held: int) -> DataFrame:
    """context (place among the hot words), word (hash), c: counts of all pairs behind hot words in
    training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BATCH_BYTES):
            learned = ~held_out(part.column(0).to_pylist(), folds, held)
            texts = [t for t, on in zip(binary(part.column(1)).to_pylist(), learned) if on]
            if texts:
                context, follows, _ = tokens(texts)
                warm = is_in(context, hot.words)
                v, w = np.searchsorted(hot.words, context[warm]), follows[warm]
                order = np.lexsort((w, v))
                v, w = v[order], w[order]
                pair = _runs(v, w)
                counts = np.diff(np.append(pair, len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(v[pair], pa.int32()), pa.array(w[pair].view(np.int64)), pa.array(counts, pa.int64())], names=["context", "word", "c"])

    return docs.mapInArrow(run, "context int, word long, c long").groupBy("context", "word").agg(F.sum("c").alias("c"))


def pair_codes(counted: DataFrame, hot: Hot, least: int) -> DataFrame:
    """context, code, word, n: how many pairs behind a hot word have a code of a; and of each hot pair,
    as code -1, its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            v, w, c = (x.to_numpy() for x in part.columns)
            keys, n = np.unique(v.astype(np.int64) << 8 | discounted(c, hot.counts[v]), return_counts=True)
            often = c >= least
            columns = (np.append(keys >> 8, v[often]), np.append(keys & 255, np.full(often.sum(), -1)), np.append(np.zeros(len(keys), np.int64), w[often]), np.append(n, c[often]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["context", "code", "word", "n"])

    return counted.mapInArrow(run, "context int, code int, word long, n long").groupBy("context", "code", "word").agg(F.sum("n").alias("n"))


def _common(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON of the most frequent words and their counts. Counts fall into classes, 16 for each
    doubling, and the words of whole classes are taken."""
    classed = words.withColumn("class", F.floor(16 * F.log2("c")).cast("int"))
    least, held = None, 0
    for r in sorted(classed.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        held += r.n
        if held > COMMON:
            break
        least = r["class"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = classed.where(F.col("class") >= least).select("word", "c").toArrow()
    w, c = found.column("word").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(w)
    return w[order], c[order]


def _hot(docs: DataFrame, words: DataFrame, total: int, n_docs: int, folds: int, held: int) -> Hot:
    """At most max(HOT, total / HOT_TOKENS) words, the marks among them, as many pairs, and 256 numbers
    of each word come to the driver."""
    least = hot_from(total)
    found = words.where(F.col("c") >= least).toArrow()
    some = sorted(zip(found.column("word").to_numpy().view(np.uint64).tolist(), found.column("c").to_pylist()))
    if n_docs >= least:
        some = sorted([*some, (int(BEGIN), n_docs)])
    hot = Hot(np.array([w for w, _ in some], np.uint64), np.array([c for _, c in some], np.int64))
    if some:
        v, code, w, n = (x.to_numpy() for x in pair_codes(pair_counts(docs, hot, folds, held), hot, least).orderBy("context", "code", "word").toArrow().columns)
        often = code < 0
        hot.left = left_over(np.bincount(v[~often], n[~often] * _VALUES[code[~often]], len(some)), hot.counts)
        number = hot.numbers(hot.words[v[often]], w[often].view(np.uint64))
        order = np.argsort(number)
        hot.pairs, hot.pair_counts = number[order], n[often][order]
    return hot


def score(docs: DataFrame, folds: int = FOLDS, held: int = HELD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document. Documents whose id falls into the held fold are scored, not learned from."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = staged(word_counts(docs, folds, held), "words")
    end = int(np.array([END], np.uint64).view(np.int64)[0])
    total, distinct, n_docs = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == end, F.col("c")))).first()
    total, distinct, n_docs = total or 0, distinct or 0, n_docs or 0
    z = total + 0.5 * (distinct + 1)
    hot = _hot(docs, words, total, n_docs, folds, held)
    hot.common, hot.common_counts = _common(words)
    shared = Shared(docs.sparkSession, hot)
    shards = max(LEAST_SHARDS, -(-int(total * folds / max(1, folds - 1)) // SHARD_TOKENS))
    tasks = -(-shards // SHARDS_A_TASK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            task, number = TaskContext.get().partitionId(), 0
            for part in slices(batches, 1, BATCH_BYTES):
                ids, texts = part.column(0), binary(part.column(1)).to_pylist()
                fold = held_out(ids.to_pylist(), folds, held)
                context, follows, counts = tokens(texts)
                hot = shared.value
                number_of = hot.numbers(context, follows)
                known = is_in(number_of, hot.pairs)
                name = task << 32 | number
                yield _part_of(name), _HEAD, name, pack(ids.fill_null(0).to_numpy().view(np.uint64), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), fold.astype(np.uint8), counts)
                doc = np.repeat(np.arange(len(counts)), counts)
                if known.any():
                    base, word, gain = hot.scored(number_of[known], z)
                    places, base, word, gain = _sparse(doc[known], base, word, gain)
                    yield _part_of(name), _SUMS, name, _pack_sums(_FIRST_SUMS, places, base, word, np.zeros(len(places)), gain)
                doc = 2 * doc + np.repeat(fold, counts)
                for shard, blob in batch_blobs(context[~known], follows[~known], doc[~known], shards, hot.words):
                    yield shard, _TOKENS, name, blob
                number += 1

        yield from _blob_batches(rows())

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, group in _by_part(batches):
                yield from ((part, k, b, bytes(d)) for k, b, d in group if k in (_HEAD, _SUMS))
                own = [r for r in group if r[0] == _TOKENS]
                if own:
                    yield from _shard_rows(own, shards, shared.value, z)

        yield from _blob_batches(_added_up(rows(), _FIRST_SUMS))

    def word_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                w, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                with np.errstate(over="ignore"):
                    key = mix(w)
                order = np.argsort(key)
                part = shard_of(key[order], shards).astype(np.int64)
                cuts = np.append(_runs(part), len(part)) if len(part) else np.zeros(0, np.int64)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    yield int(part[a]), _WORDS, 0, pack(w[order[a:b]], c[order[a:b]])

        yield from _blob_batches(rows())

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, group in _by_part(batches):
                yield from ((part, k, b, bytes(d)) for k, b, d in group if k in (_HEAD, _SUMS))
                yield from _word_rows(group, z, shared.value.words, shared.value.counts)

        yield from _blob_batches(_added_up(rows(), _GAINS))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []

        def made():
            out = _document_rows(rows, n_docs, total, z)
            if out:
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

        for batch in batches:
            for _, kind, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if name != number:
                    yield from made() if rows else ()
                    number, rows = name, []
                rows.append((kind, data))
        if rows:
            yield from made()

    dealt = docs.mapInArrow(deal, _BLOB)
    scored = dealt.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part").mapInArrow(first_pass, _BLOB)
    with_words = scored.unionByName(words.mapInArrow(word_blobs, _BLOB))
    added = with_words.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part").mapInArrow(second_pass, _BLOB)
    return added.repartition("batch").sortWithinPartitions("batch").mapInArrow(finish, SCHEMA)
