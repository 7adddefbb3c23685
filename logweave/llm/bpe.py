"""Byte-level BPE encoding and decoding with a given vocabulary, in batched numpy merge rounds.

Texts are split by the pattern of the vocabulary's pre-tokenizer. The distinct words of a batch are
laid out as symbols in one flat array. Each round ranks all adjacent pairs by binary search over the
sorted pair keys, takes the lowest rank of each word, merges its places from left to right, and
drops words without a pair left. Rounds end when no word is left; there is no limit to them.

Null texts are empty: they have no ids and decode to an empty text. Strings of special tokens in a
text are those tokens, as the library reads them by default. Rows stand for themselves; columns other
than the id and the text are not read. The vocabulary is read once on the driver from a path that
the caller names, and broadcast: its size is that of the vocabulary file, whatever the input.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from .text import Shared, map_texts

#: The pre-tokenizer's pattern, a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose pieces a task remembers.
REMEMBERED = 100_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes stand for themselves,
    the others, in order, for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    pieces: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        letters, vocab = byte_letters(), described["model"]["vocab"]
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        pieces = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        return cls(pieces, byte_ids, keys, first, merged[first], special)


def merge(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_owner, done_place, done_symbols = [], [], []
    place = np.arange(len(symbols))  # where a symbol began; keeps the order when words end early
    none = np.iinfo(np.int64).max
    ranks, slots = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)
    changed = np.arange(len(symbols) - 1)  # pairs whose ranks are not known yet, by their first symbol
    while len(symbols):
        pairs = symbols[changed] << 32 | symbols[changed + 1]
        slot = np.minimum(np.searchsorted(vocabulary.keys, pairs), len(vocabulary.keys) - 1)
        known = (vocabulary.keys[slot] == pairs) & (owner[changed + 1] == owner[changed])
        ranks[changed], slots[changed] = np.where(known, vocabulary.ranks[slot], none), slot
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = np.minimum.reduceat(ranks, starts)
        lengths = np.diff(np.append(starts, len(owner)))
        least = np.repeat(lowest, lengths)
        stay = least < none
        if not stay.all():
            done_owner.append(owner[~stay])
            done_place.append(place[~stay])
            done_symbols.append(symbols[~stay])
        # Equal symbols in a row give overlapping pairs: every other one of a run is merged.
        at = np.flatnonzero(stay & (ranks == least))
        if len(at):
            new_run = np.concatenate(([True], np.diff(at) > 1))
            run_start = at[new_run][np.cumsum(new_run) - 1]
            at = at[(at - run_start) % 2 == 0]
        symbols[at] = vocabulary.merged[slots[at]]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        stay[at + 1] = False
        ranks[at] = none
        symbols, owner, place, ranks, slots, touched = (a[stay] for a in (symbols, owner, place, ranks, slots, touched))
        touched[:-1] |= touched[1:]
        changed = np.flatnonzero(touched[:-1])
        if len(ranks):
            ranks[-1] = none
    if not done_owner:
        return [np.zeros(0, np.int64) for _ in words]
    owner, place, symbols = map(np.concatenate, (done_owner, done_place, done_symbols))
    order = np.argsort(place)
    cuts = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]
    return np.split(symbols[order], cuts)


class Encoder:
    """Encodes texts, and remembers the ids of words it has met, up to REMEMBERED of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}
        self.digits = [str(i) for i in range(len(vocabulary.pieces))]
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def _words(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.special else [text]
        words = self.pattern.findall(parts[0])
        for i in range(1, len(parts), 2):
            words.append(parts[i])
            words.extend(self.pattern.findall(parts[i + 1]))
        return words

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self._words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        if not self.known:
            self.known.update({t: [i] for t, i in self.vocabulary.special.items()})
        known = self.known
        new = list({w for words in split for w in words}.difference(known))
        if new:
            known.update(zip(new, [ids.tolist() for ids in merge(self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in new])]))
        return [[i for w in words for i in known[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        pieces = self.vocabulary.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; `ids` adds the ids themselves."""
    shared = Shared(docs.sparkSession, Vocabulary.load(vocabulary_path))
    made: list[Encoder] = []

    def step(doc_ids, texts):
        if not made:
            made.append(Encoder(shared.value))
        encoder = made[0]
        encoded = encoder.encode([t.decode("utf-8", "replace") for t in texts])
        out = {
            "doc_id": doc_ids,
            "n_tokens": [len(e) for e in encoded],
            "ids_sha256": [hashlib.sha256(",".join([encoder.digits[i] for i in e]).encode()).hexdigest() for e in encoded],
            "decoded_sha256": [hashlib.sha256(encoder.decode(e).encode()).hexdigest() for e in encoded],
        }
        return out | ({"ids": encoded} if ids else {})

    return map_texts(docs, step, SCHEMA + ", ids array<int>" * ids, doc_id, text)
