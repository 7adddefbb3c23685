"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's tokens are the bytes of UTF-8 text as they are, so no two characters are taken for one, and
an n-gram of order n is a number below 256**n. Trusted text, the documents that
labels call good, is counted in tasks; counts are summed in shards by n-gram. Each lower order's
continuation counts, the discounts and the mass left to the lower order come from joins of the
sharded tables. The finished table has a row for each n-gram that trusted text has; it is broadcast, and
joined with the n-grams of whole texts inside the tasks.

Thresholds are quantiles, for each language, of the trusted documents' perplexity on both sides:
text that is harder to predict than they are, or easier, is rejected. All trusted documents are counted,
and all of them set the thresholds; no document is scored by thresholds that its own language cannot
give: without trusted documents of a language, those of all languages together hold; without any, all
is kept.

Null and empty texts have no tokens and are rejected. A null language is a language of its own. Rows
stand for themselves; other columns are not read, and are kept as they are when rows are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Shared, binary, slices, staged

ORDER, BITS = 4, 8
#: Marks the edge of a text. No UTF-8 text has this byte.
EDGE = 255
#: The share of trusted documents beyond each threshold, and how much of the logarithm of perplexity
#: a text of n tokens may lie beyond it: SLACK / sqrt(n).
TAIL, SLACK = 0.004, 0.6

SCORE = "tokens long, log10_prob double"


def classes() -> np.ndarray:
    """The class of each byte of UTF-8 text, for `Model.dense`; class 0 marks the edge of a text."""
    table = np.full(256, 1, np.int64)  # control characters and the like
    table[33:127] = 2  # other punctuation
    for i, chars in enumerate((b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*<>@", b"\"'", b"-"), 3):
        table[list(chars)] = i
    table[48:58], table[65:91] = 12, 13  # digits, capital letters
    table[97:123] = np.arange(14, 40)
    table[0xC0:0xE0], table[0xE0:] = 40, 41  # lead bytes
    table[0x80:0xC0] = 42 + (np.arange(64) >> 2)  # others of a character beyond ASCII, in 16 groups
    table[EDGE] = 0
    return table


def tokens(text: bytes) -> np.ndarray:
    """The bytes of a text between marks for its edges."""
    return np.frombuffer(bytes([EDGE]) * (ORDER - 1) + text + bytes([EDGE]), np.uint8).astype(np.int64)


def ngrams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, and the number of each text's."""
    parts = [tokens(t) if t else np.zeros(0, np.int64) for t in texts]
    out = []
    for part in parts:
        size = max(0, len(part) - ORDER + 1)
        key = np.zeros(size, np.int64)
        for k in range(ORDER - order, ORDER):
            key = key << BITS | part[k : k + size]
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.fromiter(map(len, out), np.int64, len(out))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """gram, c: counts of the highest order over a column of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, 2 << 20):
            grams, _ = ngrams(binary(part.column(0)).to_pylist())
            keys, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["gram", "c"])

    return texts.mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discount(d: dict[int, list[float]], order: int) -> Column:
    c = F.col("c")
    return F.when(c == 1, d[order][0]).when(c == 2, d[order][1]).otherwise(d[order][2])


def discounts(tables: list[DataFrame]) -> dict[int, list[float]]:
    """By order, the three discounts from the numbers of n-grams with counts 1 to 4."""
    few = [t.where("c <= 4").groupBy(F.lit(n).alias("order"), "c").agg(F.count("*").alias("n")) for n, t in enumerate(tables, 1)]
    n: dict[int, dict[int, int]] = {k: {} for k in range(1, len(tables) + 1)}
    for r in reduce(DataFrame.unionByName, few).collect():
        n[r["order"]][r["c"]] = r["n"]

    def of(m: dict[int, int]) -> list[float]:
        if not m.get(1) or not m.get(2):
            return [0.5, 1.0, 1.5]
        y = m[1] / (m[1] + 2 * m[2])
        return [min(k, max(0.05, k - (k + 1) * y * m.get(k + 1, 0) / m[k])) if m.get(k) else k / 2 for k in (1, 2, 3)]

    return {k: of(m) for k, m in n.items()}


def smoothed(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """order, gram, p of all n-grams seen; and order, context, left: the mass that a context leaves to
    the lower order. All tables are sharded by n-gram, and each order is a join with the one below."""
    tables = [counts]
    for n in range(order - 1, 0, -1):  # continuation counts: in how many ways it goes on to the left
        tables.insert(0, tables[0].groupBy((F.col("gram") % (1 << BITS * n)).alias("gram")).agg(F.count("*").alias("c")))
    d = discounts(tables)
    seen, lefts = [], []
    for n, table in enumerate(tables, 1):
        taken = _discount(d, n)
        cut = table.select("gram", "c", F.floor(F.col("gram") / (1 << BITS)).alias("context"), taken.alias("taken"))
        sums = cut.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("taken") / F.sum("c")).alias("left"))
        lefts.append(sums.select(F.lit(n).alias("order"), "context", "left"))
        own = cut.join(sums, "context").select("gram", ((F.col("c") - F.col("taken")) / F.col("total")).alias("own"), "left")
        if n == 1:
            seen.append(own.select(F.lit(n).alias("order"), "gram", (F.col("own") + F.col("left") / (1 << BITS)).alias("p")))
        else:
            below = seen[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            seen.append(own.join(below, F.col("gram") % (1 << BITS * (n - 1)) == F.col("suffix")).select(F.lit(n).alias("order"), "gram", (F.col("own") + F.col("left") * F.col("q")).alias("p")))
    return reduce(DataFrame.unionByName, seen), reduce(DataFrame.unionByName, lefts)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray | float) -> np.ndarray:
    """The values of wanted keys, among sorted ones, or the default."""
    if not len(keys):
        return np.broadcast_to(default, wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Model:
    """The tables as arrays: by order, the sorted n-grams seen with their probabilities, and the sorted
    contexts with what they leave. 8 bytes for each n-gram and context of trusted text."""

    def __init__(self, seen: DataFrame, lefts: DataFrame):
        def arrays(frame: DataFrame, key: str, value: str) -> list[tuple[np.ndarray, np.ndarray]]:
            table = frame.select("order", F.col(key).alias("key"), F.col(value).cast("float").alias("value")).toArrow()
            order, keys, values = (c.to_numpy() for c in table.columns)
            parts = [(keys[order == n].astype(np.uint32), values[order == n]) for n in range(1, ORDER + 1)]
            return [(k[by], v[by]) for k, v in parts for by in (np.argsort(k),)]

        self.seen, self.lefts = arrays(seen, "gram", "p"), arrays(lefts, "context", "left")

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """p of n-grams of the highest order. An n-gram that was not seen has what its context leaves of the
        probability without its first token."""
        p: np.ndarray = np.full(len(grams), 1 / (1 << BITS))
        for n, (seen, lefts) in enumerate(zip(self.seen, self.lefts), 1):
            own = (grams & ((1 << BITS * n) - 1)).astype(np.uint32)
            p = _at(*seen, own, p * _at(*lefts, own >> BITS, 1.0))
        return p

    def dense(self) -> np.ndarray:
        """log10 p of each of 64 classes of bytes after three of them, as a table of fixed size to look at:
        the mean over the contexts that a context of classes stands for. Scores do not use it."""
        of, size = classes(), 64
        p = np.bincount(of, minlength=size) / len(of)
        below = Model.__new__(Model)
        for n, (seen, lefts) in enumerate(zip(self.seen, self.lefts), 1):

            def row(grams: np.ndarray, k: int) -> np.ndarray:
                return sum((of[grams.astype(np.int64) >> BITS * i & 255] << 6 * i for i in range(k)), np.zeros(len(grams), np.int64))

            below.seen, below.lefts = self.seen[: n - 1], self.lefts[: n - 1]
            lower = below.probabilities(seen[0].astype(np.int64) & ((1 << BITS * (n - 1)) - 1))
            own = seen[1] - _at(*lefts, seen[0] >> BITS, 1.0) * lower if n > 1 else seen[1] - lefts[1] / (1 << BITS)
            rows = row(lefts[0], n - 1)
            many = np.bincount(rows, minlength=size ** (n - 1))
            left = np.where(many > 0, np.bincount(rows, lefts[1], len(many)), 1.0) / np.maximum(many, 1)
            p = (p if n == 1 else np.tile(p, size)).reshape(-1, size) * left[:, None]
            p = p.ravel() + np.bincount(row(seen[0], n), own, p.size) / np.repeat(np.maximum(many, 1), size)
        return np.log10(np.maximum(p, 1e-30)).astype(np.float16)  # some classes have no bytes


def fit(trusted: DataFrame) -> Model:
    """The model of a column of trusted texts."""
    return Model(*smoothed(staged(count_ngrams(trusted), "ngrams")))


def log_probs(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and log10 of its probability."""
    grams, sizes = ngrams(texts)
    once, at = np.unique(grams, return_inverse=True)
    values = np.concatenate(([0.0], np.cumsum(np.log10(model.probabilities(once))[at])))
    ends = np.cumsum(sizes)
    return sizes, values[ends] - values[ends - sizes]


def trusted_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts of all documents that the labels call good. There may be as many ids as documents, so
    they are not broadcast: a shuffle brings each text to its id, and a hash join sorts no texts."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("__good")).distinct()
    return docs.where(F.col(text).isNotNull()).join(good.hint("shuffle_hash"), F.col(doc_id) == F.col("__good"), "left_semi").select(text)


def scores(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, tokens, log10_prob of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sizes, sums = log_probs(model.value, binary(part.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).fill_null(""), pa.array(sizes, pa.int64()), pa.array(sums)], names=["doc_id", "lang", "tokens", "log10_prob"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(run, f"doc_id long, lang string, {SCORE}")


def _rate() -> Column:
    return -F.col("log10_prob") / F.col("tokens")


def thresholds(scored: DataFrame, labels: DataFrame, tail: float = TAIL) -> tuple[DataFrame, tuple[float, float]]:
    """lang, low, high: quantiles of log10 perplexity over all trusted documents of each language; and
    those over all of them."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    rated = scored.where("tokens > 0").join(good, "doc_id", "left_semi").select("lang", _rate().alias("r"))
    cut = [F.percentile_approx("r", F.lit(q), F.lit(10_000)).alias(n) for n, q in (("low", tail), ("high", 1 - tail))]
    every = rated.agg(*cut).first()
    return staged(rated.groupBy("lang").agg(*cut), "thresholds"), (every.low if every.low is not None else -1e9, every.high if every.high is not None else 1e9)


def verdict(rate, tokens, low, high, slack: float = SLACK):
    """Whether a rate is within the thresholds; for numpy arrays."""
    room = slack / np.sqrt(np.maximum(tokens, 1))
    return (tokens > 0) & (rate >= low - room) & (rate <= high + room)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """The broadcast model, the scores of all documents, and the thresholds."""
    model = Shared(docs.sparkSession, fit(trusted_texts(docs, labels, doc_id, text)))
    scored = staged(scores(docs, model, doc_id, text, lang), "scores")
    return model, scored, *thresholds(scored, labels)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: perplexity, the thresholds of its language, and whether it is kept."""
    _, scored, by_lang, every = fitted(docs, labels, doc_id, text, lang)
    rated = scored.join(by_lang, "lang", "left")
    low, high = (F.coalesce(F.col(n), F.lit(v)) for n, v in zip(("low", "high"), every))
    room = SLACK / F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
    known = F.col("tokens") > 0
    return rated.select(
        "doc_id",
        "lang",
        "tokens",
        "log10_prob",
        F.when(known, F.pow(F.lit(10.0), _rate())).alias("perplexity"),
        F.pow(F.lit(10.0), low - room).alias("least"),
        F.pow(F.lit(10.0), high + room).alias("most"),
        F.when(known, (_rate() >= low - room) & (_rate() <= high + room)).otherwise(False).alias("kept"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, all columns as they are. Texts are scored where they
    are read, and not shuffled."""
    model, _, by_lang, every = fitted(docs, labels, doc_id, text, lang)
    at = docs.columns.index(text)
    bounds = by_lang.select(F.col("lang").alias("__lang"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    joined = docs.join(bounds, F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col("__lang"), "left").select(*docs.columns, F.coalesce("__low", F.lit(every[0])).alias("__low"), F.coalesce("__high", F.lit(every[1])).alias("__high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            sizes, sums = log_probs(model.value, binary(part.column(at)).to_pylist())
            low, high = (part.column(part.num_columns - k).to_numpy() for k in (2, 1))
            keep = verdict(-sums / np.maximum(sizes, 1), sizes, low, high)
            yield pa.RecordBatch.from_arrays(part.columns[:-2], names=part.schema.names[:-2]).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
