"""Quality rules on repetition: how much of a text stands in n-grams and lines that it repeats.

Words of a batch of whole texts are numbered, and all n-grams hashed by rolling sums over their words,
in numpy. An n-gram is duplicated if the same n words stand at two places of the text or more: where
hashes are equal, the words are compared. The measures
are characters inside duplicated n-grams, for several n, of the most frequent short n-gram, and
inside repeated lines. Null and empty texts have no words: they fail the base rule. Rows stand for
themselves, so repeated rows give repeated results; columns other than the id and the text are not
read. A text needs some 60 times its size in memory while it is measured.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .text import map_texts, mix, word_spans

#: Most characters, as a share of all word characters, inside duplicated n-grams of n words.
COVERED_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Most characters inside the places of the most frequent n-gram.
TOP_LIMITS = {2: 0.30, 3: 0.25, 4: 0.22}
#: Most characters in lines equal to an earlier line, and most symbols a word.
LINE_LIMIT, SYMBOL_LIMIT = 0.30, 0.25
#: Texts with fewer words are not judged by their most frequent n-gram.
TOP_MIN_WORDS = 30
#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_LENGTH, BASE_PERCENT = 10, 5, 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_share double, covered_share double, top_share double, reasons string, kept boolean"

_BLANK = bytes(32 if b in b" \t\n\x0b\x0c\r" else 65 for b in range(256))
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `flags` between consecutive bounds."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def numbered(items: list[bytes]) -> np.ndarray:
    """The same number for equal items."""
    number = {x: i for i, x in enumerate(dict.fromkeys(items))}
    return np.fromiter(map(number.__getitem__, items), np.int64, len(items))


def _runs(keys: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in sorted order, and where a new key begins in it."""
    order = np.argsort(keys, kind=kind)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, new


def repeated(keys: np.ndarray, at: np.ndarray, length: int, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words that begins at one of the places `at`: whether the same words
    stand at another place of the text, and at how many. `keys` are hashes of the windows; where windows
    of one key differ, exact keys take their place."""
    order, new = _runs(keys)
    heads = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b = at[order[~new]], at[heads[~new]]
    same = owner[a] == owner[b]
    for k in range(length):
        same &= words[a + k] == words[b + k]
    if not same.all():
        exact = owner[at]
        for k in range(length):
            exact = np.unique(exact * (int(words.max()) + 1) + words[at + k], return_inverse=True)[1]
        order, new = _runs(exact)
    group = np.cumsum(new) - 1
    places = np.empty(len(keys), np.int64)
    places[order] = np.bincount(group)[group]
    return places > 1, places


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of `size` words stand inside a window of `length` words from one of the starts."""
    edge = np.zeros(size + length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:size] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, as columns."""
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    n = len(texts)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
    bounds = np.concatenate(([0], ends))
    starts, stops = word_spans(np.frombuffer(raw.translate(_BLANK), np.uint8))
    begins_point = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(begins_point, dtype=np.int64)))
    word_size = points[stops] - points[starts]
    first_word = np.searchsorted(starts, bounds)
    owner = np.repeat(np.arange(n), np.diff(first_word))
    sums = np.concatenate(([0], np.cumsum(word_size)))
    word_chars = np.diff(sums[first_word])
    n_words = np.diff(first_word)

    line_ends = np.flatnonzero(data == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    line_owner = np.searchsorted(ends, line_starts, side="right")
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    with np.errstate(over="ignore"):
        order, new = _runs(numbered(raw.split(b"\n")[:-1]) * n + line_owner, "stable")
        later = np.empty(len(order), bool)
        later[order] = ~new
        dup_line = later & has_word
        line_size = points[line_ends] - points[line_starts]
        n_dup_lines = np.bincount(line_owner, dup_line, n).astype(np.int64)
        dup_line_chars = np.bincount(line_owner, dup_line * line_size, n)
        all_chars = np.maximum(np.bincount(line_owner, line_size, n), 1)

        number = numbered(raw.split())
        words = mix(number.astype(np.uint64) + np.uint64(1))
        total = np.maximum(word_chars, 1)
        rolling = np.zeros(len(words), np.uint64)
        covered_share, top_share = {}, {}
        n_repeat_words = np.zeros(n, np.int64)
        factor = 1
        for length in range(1, max(COVERED_LIMITS) + 1):
            size = len(words) - length + 1
            if size <= 0:
                break
            rolling = rolling[:size] + words[length - 1 :] * np.uint64(factor)
            factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
            if length not in COVERED_LIMITS and length not in TOP_LIMITS:
                continue
            at = np.flatnonzero(owner[:size] == owner[length - 1 :])
            keys = mix(rolling[at] + owner[at].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
            again, places = repeated(keys, at, length, number, owner)
            if length in COVERED_LIMITS:
                hit = covered(at[again], length, len(words))
                covered_share[length] = np.bincount(owner, hit * word_size, n) / total
                if length == BASE_LENGTH:
                    n_repeat_words = np.bincount(owner, hit, n).astype(np.int64)
            else:
                chars = (sums[at + length] - sums[at]) * places * again
                top = np.zeros(n)
                np.maximum.at(top, owner[at], chars)
                top_share[length] = top / total
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_text(_IS_SYMBOL[data], bounds),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "dup_line_share": dup_line_chars / all_chars,
        "covered": {k: v for k, v in covered_share.items()},
        "top": {k: v for k, v in top_share.items()},
    }


def judged(texts: list[bytes]) -> dict:
    m = measure(texts)
    n = len(texts)
    none = np.zeros(n)
    base_failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    rules = {"base": base_failed, "lines": m["dup_line_share"] > LINE_LIMIT, "symbols": m["n_symbols"] > SYMBOL_LIMIT * np.maximum(m["n_words"], 1)}
    rules |= {f"covered{k}": m["covered"].get(k, none) > most for k, most in COVERED_LIMITS.items()}
    rules |= {f"top{k}": (m["top"].get(k, none) > most) & (m["n_words"] >= TOP_MIN_WORDS) for k, most in TOP_LIMITS.items()}
    reasons = [",".join(name for name, failed in rules.items() if failed[i]) for i in range(n)]
    return {
        **{k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share")},
        "base_failed": base_failed,
        "covered_share": np.max([none, *m["covered"].values()], axis=0),
        "top_share": np.max([none, *m["top"].values()], axis=0),
        "reasons": reasons,
        "kept": np.array([not r for r in reasons], bool),
    }


def repetition_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, shares, the names of the rules it breaks, and whether it is kept."""
    return map_texts(docs, lambda ids, texts: {"doc_id": ids, **judged(texts)}, SCHEMA, doc_id, text)
