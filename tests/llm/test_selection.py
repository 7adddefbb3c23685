"""Sharding, whitening and resampling against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from logweave.llm import eigen, numbering, resampling, sharding, whitening

DOCS = "doc_id long, text string, shard string, slot string, weight string, score string, bucket string, part string, copies string, begin string"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word(name: str, key: str) -> float:
    return (int(hashlib.sha256(f"{name}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def placed(tree: sharding.Tree, key: str) -> sharding.Leaf:
    """Down the tree in plain Python."""
    own = [x for x in tree.leaves if x.weight > 0]
    for depth in (2, 3, 4):
        groups = collections.defaultdict(list)
        for x in own:
            groups["/".join(map(str, (x.batch, x.region, x.rack, x.shard)[:depth]))].append(x)
        best = min(groups, key=lambda g: -math.log(word(g, key)) / sum(x.weight for x in groups[g]))
        own = groups[best]
    return own[0]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "The of and stone River naïve été 日本 x1 y's don't A-b " + "w" * 90
    texts = [None, "", " \n", "one", "Two two", "z" * 500, " ".join(rng.choices(words.split(" "), k=4000))]
    texts += [" ".join(rng.choices(words.split(" "), k=rng.randint(1, 60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 9 + [(None, texts[8]), (None, None), (None, None), (9, "another text of the same id " * 5)]
    return spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards_go_down_the_tree(spark, docs, empty):
    tree = sharding.Tree.regular(2, 2, 3).weighted(4, 2.5).weighted(5, 0)
    out = sharding.assign(docs, tree).collect()
    key = lambda i: "null" if i is None else str(i)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), placed(tree, key(r.doc_id)).shard, placed(tree.grown(), key(r.doc_id)).shard) for r in rows]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out) == collections.Counter(want)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, tree).count() == 0
    assert sharding.op11_sharding.__name__ == "op11_sharding"


def test_slots_do_not_depend_on_buckets(spark):
    """Equal rows in parts of COPIES, and an order that is the same for any number of buckets."""
    n = 2 * numbering.COPIES + 5
    rows = spark.range(300).selectExpr("id % 3 as shard", "id % 50 as v").union(spark.range(n).selectExpr("1L", "7L"))
    few, many = (sorted(map(tuple, sharding.slots(rows, k).select("shard", "v", "slot").collect())) for k in (1, 10**9))
    assert few == many and len(few) == 300 + n
    for shard in range(3):
        assert sorted(s for g, _, s in few if g == shard) == list(range(sum(g == shard for g, _, _ in few)))


def test_what_moves_between_shards(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    at = lambda tree: dict(map(tuple, sharding.with_shard(rows, tree).select("doc_id", "shard").collect()))
    tree = sharding.Tree.regular(3, 2, 2)
    before = at(tree)
    sizes = collections.Counter(before.values())
    assert set(sizes) == set(range(12)) and all(abs(n - 4000 / 12) < 90 for n in sizes.values())
    grown = tree
    for new in (12, 13, 14):
        grown = grown.grown(2.0)
        after = at(grown)
        assert all(after[i] in (before[i], new) for i in before)
        assert any(after[i] == new for i in before)
        before = after
    # A shard that is emptied: what moves leaves or enters a subtree on the way to it.
    first, changed = at(tree), tree.weighted(5, 0)
    for i, shard in at(changed).items():
        if shard != first[i]:
            assert first[i] // 4 == 1 or shard // 4 == 1
            assert first[i] // 4 != 1 or shard // 4 != 1 or {first[i] // 2, shard // 2} & {2}
    assert 5 not in at(changed).values()
    with pytest.raises(ValueError):
        sharding.Tree((sharding.Leaf(0, 0, 0, 1), sharding.Leaf(0, 0, 1, 1)))
    with pytest.raises(ValueError):
        sharding.Tree((sharding.Leaf(0, 0, 0, 1, 0.0),))


def test_eigenpairs():
    rng = np.random.default_rng(4)
    square = lambda n: rng.standard_normal((n, n))
    turn = np.linalg.qr(square(30))[0]
    cases = [(lambda a: a @ a.T)(square(n)) for n in (1, 2, 3, 17, 64)] + [(lambda a: a + a.T)(square(n)) for n in (2, 40)]
    cases += [np.diag([3.0, 3, 3, 1, 0, 0]), np.zeros((4, 4)), np.ones((6, 6)), np.kron(np.eye(3), np.array([[2.0, 1], [1, 2]])), np.diag([3.0, 2, 1]) * 1e-180]
    cases += [turn @ np.diag([5, 5, 5 + 1e-10] + [1.0] * 27) @ turn.T]
    for a in cases:
        values, vectors = eigen.leading(a, 5)
        k, scale = len(values), np.abs(a).max() or 1.0
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * scale * len(a)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-12
        below = eigen.counts_below(*eigen.tridiagonal(a / scale)[:2], np.array([-100.0, 100.0 * len(a)]))
        assert below.tolist() == [0, len(a)]


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))).tolist()
    odd = [None, [], [None] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], [3e3, -200.0, 0.0, 0.0, 0.0, 1e-9]]
    rows = [(i, v, 1.0) for i, v in enumerate([*base, *odd, *[base[0]] * 40, [x + 1e-5 for x in base[1]]])] + [(None, base[2], 2.0), (3, base[3], 2.0), (3, base[3], 2.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(4)
    out = whitening.whiten(table, whitening.fit(table)).collect()
    kept = [(i, np.floor(256 * np.array(v)).astype(object)) for i, v, _ in rows if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(map(int, x)) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    got = collections.defaultdict(list)
    for r in out:
        assert r.n == n and r.identity_error <= 1e-9
        got[r.component].append((r.vec_id, r.deviation, r.whitened))
    assert set(got) == {1, 2, 3, 4}
    for k in range(1, 5):
        e, u = values[-k], vectors[:, -k]
        want = [(i, sum((n * int(c) - s) ** 2 for c, s in zip(x, sums)), float((x.astype(float) - mean) @ u / math.sqrt(e))) for i, x in kept]
        assert collections.Counter(g[:2] for g in got[k]) == collections.Counter(w[:2] for w in want)
        order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        a, b = np.array([g[2] for g in sorted(got[k], key=order)]), np.array([w[2] for w in sorted(want, key=order)])
        sign = np.sign(a[0] * b[0])
        a = np.array([g[2] for g in sorted(((i, d, sign * x) for i, d, x in got[k]), key=order)])
        assert np.abs(a - b).max() < 1e-6
        assert all(abs(r.explained / (e / np.trace(v)) - 1) < 1e-9 for r in out if r.component == k)


def test_whitening_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    nothing = spark.createDataFrame([(1, None)], schema)
    for table in (same, nothing, same.limit(0)):
        assert whitening.whiten(table, whitening.fit(table)).count() == 0
    # Two dimensions and one direction: a single component.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)
    assert {r.component for r in whitening.whiten(line, whitening.fit(line)).collect()} == {1}


def test_deviation_beyond_a_long(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(table, whitening.fit(table)).collect()
    assert {r.vec_id for r in out} == {1, 2, 3} and all(r.deviation is None for r in out if r.vec_id != 2)


def test_packed_rows_come_back():
    x = np.array([[1, -(1 << 15)], [1 << 15, 0], [-(1 << 31), 3], [1 << 31, 0], [(1 << 63) - 1, -(1 << 63)]])
    import pyarrow as pa

    rows = whitening.packed(x)
    assert [len(r) // 2 for r in rows] == [2, 4, 4, 8, 8]
    assert sorted(map(tuple, np.concatenate(list(whitening.unpacked(pa.array(rows, pa.binary()), 2))).tolist())) == sorted(map(tuple, x.tolist()))


def test_crcs_of_pairs():
    rng = random.Random(6)
    words = [bytes(rng.choices(range(97, 123), k=rng.randint(1, 80))) for _ in range(400)]
    for known in ([], words[:50], words):
        head = resampling.Head(known, 997, 30)
        single, pair = head.features(words)
        assert single.tolist() == [zlib.crc32(w) % 997 for w in words]
        assert pair.tolist() == [zlib.crc32(a + b" " + b) % 997 for a, b in zip(words, words[1:])]


def test_long_texts_in_pieces():
    text = b"Ab c " * 50 + b"x" * 100 + b" y"
    words = text.lower().split()
    assert [w for p in resampling.pieces(text, 16) for w in p] == words
    head = resampling.Head([b"ab"])
    whole, cut = ([resampling._run_features(head, lists, before) for _, lists, before in resampling.runs([text], limit)] for limit in (1 << 20, 16))
    for k in (0, 2):
        assert np.concatenate([p[k] for p in whole]).tolist() == np.concatenate([p[k] for p in cut]).tolist()


def test_resampling_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(resampling, "HEAD_WORDS", 4)
    target = spark.createDataFrame([("River stone of the stone naïve",), (None,), ("",), ("y s don t",)], "text string")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    features = lambda t: (lambda w: [*w, *map(" ".join, zip(w, w[1:]))])(re.findall(ALNUM, lower(t)))
    bucket = lambda f: zlib.crc32(f.encode()) % 101
    rows = docs.select("doc_id", "text").collect()
    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(map(bucket, features(r.text)))
    for r in target.collect():
        t.update(map(bucket, features(r.text)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 101) / ((s[b] + 1) * (t.total() + 101)))) for b in range(101)]
    want = []
    for r in rows:
        own = features(r.text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        want.append((r.doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(re.findall(ALNUM, lower(r.text))) >= 20))
    for share in ((25, 100), (1, 1), (0, 1)):
        out = resampling.resample(docs, target, share=share, buckets=101).collect()
        assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in out) == collections.Counter(w[:4] for w in want)
        able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is not None, w[0] or 0, w[1]))
        drawn = able[: len(able) * share[0] // share[1]]
        ranked = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
        assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
        assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == [w[:4] for w in drawn]
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)
