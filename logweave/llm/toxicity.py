"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words, all of them. Each word enters by an embedding of the
word and by the mean of embeddings of its character 3- and 4-grams; a GRU reads the window in either
direction, attention pools the states, and a logistic unit scores the window. A document scores as its
highest window, through a logistic calibration.

Training sees labels of documents only: of a toxic document the window that scores highest is taken as
toxic, of another the highest windows as clean. It uses whole texts of at most SAMPLE labelled
documents of each class, chosen by a hash of the id, and of these, in the order of the hash, those
that fit into SAMPLE_BYTES; the model's size is fixed by the constants below.

Null and empty texts are one window that holds no word. Rows stand for themselves; columns other than
the id and the text are not read, and labels only in training. Without labels of both classes nothing
can be learned, and every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD_BYTES, Shared, map_texts

#: Most labelled documents of each class in training, the bound of the sample.
SAMPLE = 1000
#: Most bytes of their texts, for each class.
SAMPLE_BYTES = 32 << 20
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
WORDS, GRAMS = 4096, 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
BATCH, RATE = 64, 0.01
#: Passes over the sample, and as many more as small samples need for so many steps.
EPOCHS, STEPS = 5, 240
THRESHOLD = 0.7
#: Words whose inputs a task remembers.
REMEMBERED = 100_000

SCHEMA = "doc_id long, score double, predicted int, n_windows long"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, and the number of each word's."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    keys, owners = [], []
    for n in (3, 4):
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = key * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        inside = word[n - 1 :] == word[: len(word) - n + 1]
        keys.append(key[inside].astype(np.int64))
        owners.append(word[: len(word) - n + 1][inside])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=len(words))


def window_table(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, its first word among all texts' words, its length."""
    owner, first, length = [], [], []
    begin = 0
    for i, n in enumerate(sizes):
        count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
        starts = np.arange(count) * STRIDE
        owner.append(np.full(count, i))
        first.append(begin + starts)
        length.append(np.minimum(WINDOW, n - starts))
        begin += n
    return np.concatenate(owner), np.concatenate(first), np.concatenate(length)


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    known: dict[bytes, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        normal = lambda *shape: (rng.standard_normal(shape) * (0.4 / np.sqrt(shape[0]) if len(shape) > 1 else 0.1)).astype(np.float32)
        p = {"word": (rng.standard_normal((len(vocabulary) + 2, WORD_DIM)) * 0.1).astype(np.float32), "gram": (rng.standard_normal((GRAMS, GRAM_DIM)) * 0.1).astype(np.float32)}
        for way in "fb":
            p |= {f"x{way}": normal(d, 3 * h), f"h{way}": normal(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        p |= {"a": normal(2 * h, ATTENTION), "ac": np.zeros(ATTENTION, np.float32), "av": normal(ATTENTION), "o": normal(2 * h), "oc": np.zeros(1, np.float32)}
        return cls(vocabulary, p)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "inputs": None}

    def word_inputs(self, words: list[bytes]) -> np.ndarray:
        """The embeddings of words: the word's own, 1 for an unknown one, beside its n-grams' mean."""
        keys, counts = grams_of(words)
        ids = np.array([self.vocabulary.get(w, 1) for w in words], np.int64)
        sums = np.add.reduceat(self.p["gram"][keys], np.cumsum(counts) - counts, axis=0)
        return np.concatenate((self.p["word"][ids], sums / counts[:, None].astype(np.float32)), axis=1)

    def remembered(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, after the inputs to the gates of those not met before are worked out."""
        if len(self.known) > REMEMBERED:
            self.known, self.inputs = {}, None
        if self.inputs is None:
            empty = np.concatenate((self.p["word"][:1], np.zeros((1, GRAM_DIM), np.float32)), axis=1)
            self.inputs = np.concatenate([empty @ self.p[f"x{w}"] + self.p[f"c{w}"] for w in "fb"], axis=1)
        new = list(set(words).difference(self.known))
        if new:
            x = self.word_inputs(new)
            self.known.update(zip(new, range(len(self.inputs), len(self.inputs) + len(new))))
            self.inputs = np.concatenate((self.inputs, np.concatenate([x @ self.p[f"x{w}"] + self.p[f"c{w}"] for w in "fb"], axis=1)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def states(self, gates: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hidden states [time, window, 2h] of windows whose words' gate inputs are gates[at]."""
        n, steps, h = len(at), at.shape[1], HIDDEN
        out = np.empty((steps, n, 2 * h), np.float32)
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            x = gates[:, : 3 * h] if way == "f" else gates[:, 3 * h :]
            u, state = self.p[f"h{way}"], np.zeros((n, h), np.float32)
            side = slice(0, h) if way == "f" else slice(h, 2 * h)
            for t in order:
                g, m = x[at[:, t]], state @ u
                zr = sigmoid(g[:, : 2 * h] + m[:, : 2 * h])
                z = zr[:, :h]
                state = np.where((t < lengths)[:, None], z * state + (1 - z) * np.tanh(g[:, 2 * h :] + zr[:, h:] * m[:, 2 * h :]), state)
                out[t, :, side] = state
        return out

    def pooled(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows."""
        energy = np.tanh(states @ self.p["a"] + self.p["ac"]) @ self.p["av"]
        energy[np.arange(len(energy))[:, None] >= lengths] = -1e9
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        return np.einsum("tn,tnh->nh", weight, states) @ self.p["o"] + self.p["oc"][0]

    def logits(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of the texts: its text, first word, length and logit."""
        sizes = [len(w) for w in split]
        owner, first, length = window_table(sizes)
        ids = np.concatenate((self.remembered([w for words in split for w in words]), np.zeros(WINDOW, np.int64)))
        at = ids[np.minimum(first[:, None] + np.arange(WINDOW), len(ids) - 1)]
        at[np.arange(WINDOW) >= length[:, None]] = 0
        length = np.maximum(length, 1)  # a window without words holds the empty word
        values = np.empty(len(owner), np.float32)
        for a in range(0, len(owner), 4096):
            part = slice(a, a + 4096)
            values[part] = self.pooled(self.states(self.inputs, at[part], length[part]), length[part])
        return owner, first, length, values

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text, and the number of its windows."""
        owner, _, _, values = self.logits([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, values)
        return sigmoid(self.scale[0] * best + self.scale[1]), np.bincount(owner, minlength=len(texts))

    def gradients(self, words: list[list[bytes]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over windows, by backpropagation through time."""
        p, h, n = self.p, HIDDEN, len(words)
        steps = max(1, max(map(len, words)))
        lengths = np.array([max(1, len(w)) for w in words])
        distinct = list({w for ws in words for w in ws})
        number = {w: i + 1 for i, w in enumerate(distinct)}
        at = np.zeros((n, steps), np.int64)
        for i, ws in enumerate(words):
            at[i, : len(ws)] = [number[w] for w in ws]
        empty = np.concatenate((p["word"][:1], np.zeros((1, GRAM_DIM), np.float32)), axis=1)
        inputs = np.concatenate((empty, self.word_inputs(distinct))) if distinct else empty
        trace, states = {}, np.empty((steps, n, 2 * h), np.float32)
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates, u, state = inputs @ p[f"x{way}"] + p[f"c{way}"], p[f"h{way}"], np.zeros((n, h), np.float32)
            for t in order:
                m = state @ u
                g = gates[at[:, t]]
                zr = sigmoid(g[:, : 2 * h] + m[:, : 2 * h])
                c = np.tanh(g[:, 2 * h :] + zr[:, h:] * m[:, 2 * h :])
                on = (t < lengths)[:, None].astype(np.float32)
                trace[way, t] = (state, zr, c, m[:, 2 * h :], on)
                state = state + on * (1 - zr[:, :h]) * (c - state)
                states[t, :, :h] = state if way == "f" else states[t, :, :h]
                states[t, :, h:] = state if way == "b" else states[t, :, h:]
        hidden = np.tanh(states @ p["a"] + p["ac"])
        energy = hidden @ p["av"]
        energy[np.arange(steps)[:, None] >= lengths] = -1e9
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        error = ((sigmoid(pooled @ p["o"] + p["oc"][0]) - labels) / n).astype(np.float32)
        grads = {"o": pooled.T @ error, "oc": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_energy[..., None] * p["av"] * (1 - hidden**2)
        grads |= {"av": np.einsum("tn,tna->a", d_energy, hidden), "a": np.einsum("tnh,tna->ha", states, d_hidden), "ac": d_hidden.sum(axis=(0, 1))}
        d_states = weight[..., None] * d_pooled + d_hidden @ p["a"].T
        d_inputs = np.zeros_like(inputs)
        for way, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            u = p[f"h{way}"]
            d_u, d_gates, d_state = np.zeros_like(u), np.zeros((len(inputs), 3 * h), np.float32), np.zeros((n, h), np.float32)
            for t in order:
                before, zr, c, m, on = trace[way, t]
                z, r = zr[:, :h], zr[:, h:]
                d = d_state + d_states[t, :, :h] if way == "f" else d_state + d_states[t, :, h:]
                live = d * on
                d_c = live * (1 - z) * (1 - c**2)
                d_z = live * (before - c) * z * (1 - z)
                d_r = d_c * m * r * (1 - r)
                d_m = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_u += before.T @ d_m
                np.add.at(d_gates, at[:, t], np.concatenate((d_z, d_r, d_c), axis=1))
                d_state = d_m @ u.T + live * z + d * (1 - on)
            grads |= {f"h{way}": d_u, f"x{way}": inputs.T @ d_gates, f"c{way}": d_gates.sum(axis=0)}
            d_inputs += d_gates @ p[f"x{way}"].T
        grads["word"], grads["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(grads["word"], [0] + [self.vocabulary.get(w, 1) for w in distinct], d_inputs[:, :WORD_DIM])
        if distinct:
            keys, counts = grams_of(distinct)
            np.add.at(grads["gram"], keys, np.repeat(d_inputs[1:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return grads


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """The network that tells the labels apart, calibrated on the same documents; None without both."""
    labels = np.array(labels)
    if len(set(labels.tolist())) < 2:
        return None
    split = [words_of(t) for t in texts]
    counts: dict[bytes, int] = {}
    for words in split:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted((w for w in counts if counts[w] >= 5), key=lambda w: (-counts[w], w))[:WORDS]
    net = Network.new({w: i + 2 for i, w in enumerate(frequent)}, seed)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    owner, first, length = window_table([len(w) for w in split])
    begin = np.concatenate(([0], np.cumsum([len(w) for w in split])))
    values = rng.standard_normal(len(owner)).astype(np.float32)
    chosen_least = int(np.minimum(np.bincount(owner), np.where(labels == 1, 1, 2)).sum())
    epochs = max(epochs, -(-STEPS // -(-chosen_least // BATCH)))
    for epoch in range(epochs):
        if epoch:
            net.known, net.inputs = {}, None
            values = net.logits(split)[3]
        # Each document's highest windows: one of a toxic document, two of another.
        order = np.lexsort((-values, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[rank < np.where(labels[owner[order]] == 1, 1, 2)]
        chosen = rng.permutation(chosen)
        weight = RATE * (0.5 if epoch >= epochs - 2 else 1.0)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            words = [split[owner[i]][first[i] - begin[owner[i]] :][: max(0, length[i])] for i in part]
            step += 1
            for name, g in net.gradients(words, labels[owner[part]]).items():
                one, two = moments[name]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                net.p[name] -= (weight * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.known, net.inputs = {}, None
    values = net.logits(split)[3]
    best = np.full(len(split), -np.inf)
    np.maximum.at(best, owner, values)
    net.scale = calibrated(best, labels)
    net.known, net.inputs = {}, None
    return net


def calibrated(best: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with both classes of equal weight."""
    slope, offset = 1.0, 0.0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for _ in range(500):
        error = (sigmoid(slope * best + offset) - labels) * weight
        slope, offset = max(0.05, slope - 0.5 * float((error * best).sum()) - 0.5e-3 * slope), offset - 0.5 * float(error.sum())
    return slope, offset


def too_long(rows: DataFrame, bound: int) -> list:
    """Ids of chosen documents whose texts do not fit into the bound of their class any more."""
    sizes = rows.groupBy("__labelled", "__toxic").agg(F.sum(F.octet_length("__text")).alias("n"))
    used, out = {0: 0, 1: 0}, []
    for r in sizes.orderBy(F.xxhash64("__labelled"), "__labelled").collect():
        if used[r["__toxic"]] + r["n"] > bound:
            out.append(r["__labelled"])
        else:
            used[r["__toxic"]] += r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Network | None:
    """Trains on whole texts of at most `sample` documents, and SAMPLE_BYTES, of each class of `labels`
    (doc_id, toxic)."""
    one = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("toxic").alias("__toxic"))
    chosen = [one.where(F.col("__toxic") == c).orderBy(F.xxhash64("__labelled"), "__labelled").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen[0].unionAll(chosen[1])), F.col("__id") == F.col("__labelled"))
    left_out = too_long(rows, SAMPLE_BYTES)
    rows = rows.where(~F.col("__labelled").isin(left_out)) if left_out else rows
    table = sorted({(r[0], r[1], r[2]) for r in rows.select("__id", "__text", "__toxic").toLocalIterator()})
    return train([t.encode() for _, t, _ in table], [c for _, _, c in table])


def toxicity(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_windows of every document."""
    shared = Shared(docs.sparkSession, net)

    def step(ids, texts):
        if shared.value is None:
            scores, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        else:
            scores, counts = shared.value.score(texts)
        return {"doc_id": ids, "score": scores.astype(np.float64), "predicted": (scores >= THRESHOLD).astype(np.int32), "n_windows": counts}

    return map_texts(docs, step, SCHEMA, doc_id, text)
