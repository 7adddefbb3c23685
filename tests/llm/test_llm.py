"""Operators and pipeline against brute force on small tables with nulls, empty and long texts, ties,
repeated rows and columns whose names clash."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import bpe, chat, components, decontaminate, jaccard, licenses, linededup, lm, quality, queries, repetition, toxicity
from logweave.llm.eliasfano import EliasFano
from tests.oracle import duck, mismatch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, lines string"
BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def some_texts() -> list[str | None]:
    rng = random.Random(5)
    words = "The of and stone River gnu general public license apache mit cc by naïve été 日本 x1 y's MIT License, the".split(" ")
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = ["A line that stands in many of the documents", "  another SHARED line of some length\t", "short"]
    texts: list[str | None] = [None, "", " \n\t", "one", "a b c d", "x" * 3000, line(6000)]
    for _ in range(25):
        body = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 8))]
        body += rng.sample(shared, rng.randint(0, 3)) * rng.randint(1, 2)
        rng.shuffle(body)
        texts.append("\n".join(body))
    long = line(200).split(" ")
    texts += [" ".join(long), " ".join(long), " ".join(long[:-2] + ["changed", "end"]), " ".join(long[100:])]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None, None, "k", "s", "l") for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame) -> dict:
    return {r.doc_id: r for r in frame.collect()}


def texts_of(docs) -> dict[int, str]:
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert mismatch(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])[1] is None


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi </s>[INST] <\\s> [\\/INST] <\\\\s>"),
        (1, 1, "user", None),
        (1, 1, "user", None),
        (1, None, "system", "first"),
        (1, 2, "assistant", "[/INST]<s>"),
        (2, 5, None, ""),
        (None, 1, "assistant", "a"),
        (3, 700, "assistant", "late"),
        (3, 1, "assistant", "early"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chats(table, block=2).withColumn("turns", chat.read_chats(F.col("formatted"))).collect()}
    for conv, r in out.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        loss = [s.text for s in r.segments if s.loss]
        assert len(loss) == sum(x[2] == "assistant" for x in own)
    assert out[3].formatted.count("<s>") == 1 and out[1].formatted.count("<s>") == 3
    assert chat.format_chats(table.limit(0)).count() == 0


def test_line_dedup_brute_force(spark, docs, empty):
    texts = texts_of(docs)
    holders = collections.defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = {k: max(h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    out = by_id(linededup.line_report(docs))
    cut = texts_of(linededup.without_repeated_lines(docs))
    assert set(out) == set(texts) and gone
    for i, t in texts.items():
        kept = [line for line in t.split("\n") if gone.get(key(line), i) == i]
        r = out[i]
        assert (r.n_lines, r.n_dropped) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept))
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert cut[i] == "\n".join(kept)
    assert linededup.without_repeated_lines(docs).columns == docs.columns
    assert linededup.line_report(empty).count() == 0


def test_line_runs_across_partitions():
    """A pass over sorted rows gives the same decisions wherever partitions begin and end."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(k), 0, int(d)) for k, d in zip(rng.integers(0, 12, 120), rng.integers(0, 40, 120))} | {(5, 0, d) for d in range(60)}, key=lambda r: (r[0], r[1], -r[2]))
    schema = pa.schema([("kind", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("at", pa.binary()), ("docs", pa.int32())])
    want = set()
    for k in {r[0] for r in rows}:
        held = [r[2] for r in rows if r[0] == k]
        if len(held) >= 3:
            want |= {(k, d) for d in held if d != max(held)}
    for parts in (1, 3, 17, 60):
        out = []
        for part in np.array_split(np.arange(len(rows)), parts):
            batches = [pa.RecordBatch.from_arrays([pa.array([rows[i][c] for i in b], pa.int64()) for c in range(3)] + [pa.array([b"\0\0\0\0"] * len(b), pa.binary())], names=["hi", "lo", "doc_id", "at"]) for b in np.array_split(part, 2) if len(b)]
            for made in linededup._stream(iter(batches), 3, schema):
                out += made.to_pylist()
        runs = collections.defaultdict(lambda: [0, -1])
        for r in out:
            if r["kind"] == 2:
                runs[r["hi"]] = [runs[r["hi"]][0] + r["docs"], max(runs[r["hi"]][1], r["doc_id"])]
        got = {(r["hi"], r["doc_id"]) for r in out if r["kind"] == 0}
        got |= {(r["hi"], r["doc_id"]) for r in out if r["kind"] == 1 and runs[r["hi"]][0] >= 3 and r["doc_id"] != runs[r["hi"]][1]}
        assert got == want, parts


def test_toxicity_learns_and_scores(spark, empty):
    rng = random.Random(2)
    names = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lar men tos rik vun".split()]
    rows = []
    for i in range(400):
        words = [rng.choice(names) for _ in range(rng.randint(1, 150))]
        toxic = i % 2
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grobal", "grobix", "grobun"]))
        rows.append((i, " ".join(words), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(table.select("doc_id", "text"), table.where("doc_id < 300").select("doc_id", "toxic"))
    out = by_id(toxicity.toxicity(table.select("doc_id", "text", F.lit("x").alias("score")), net))
    tested = rows[300:]
    assert sum(out[i].predicted == t for i, _, t in tested) >= 0.9 * len(tested)
    assert all(0 <= r.score <= 1 for r in out.values())
    edge = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, "")], "doc_id long, text string")
    assert toxicity.toxicity(edge, net).count() == 4
    assert {r.score for r in toxicity.toxicity(edge, toxicity.train([b"a"], [1])).collect()} == {0.0}
    assert toxicity.toxicity(empty, net).count() == 0


def plain_score(net, text: str) -> float:
    """A document's score by plain Python: each word of each window goes through both recurrences."""
    p = {k: v.tolist() for k, v in net.p.items()}
    h, words = toxicity.HIDDEN, [w.encode() for w in re.findall(ALNUM, lower(text))]
    logistic = lambda x: 1 / (1 + math.exp(-x))
    times = lambda x, m: [sum(a * row[j] for a, row in zip(x, m)) for j in range(len(m[0]))]

    def entered(word: bytes | None) -> list[float]:
        if word is None:
            return p["word"][0] + [0.0] * toxicity.GRAM_DIM
        marked, found = b"<" + word + b">", []
        for n in (3, 4):
            for i in range(len(marked) - n + 1):
                key = n
                for b in marked[i : i + n]:
                    key = (key * 0x100000001B3 + b) % 2**64
                found.append(p["gram"][key * 0x9E3779B97F4A7C15 % 2**64 >> 50])
        return p["word"][net.vocabulary.get(word, 1)] + [sum(c) / len(found) for c in zip(*found)]

    def window(own: list[bytes | None]) -> float:
        states = [[] for _ in own]
        for way, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            state = [0.0] * h
            for t in order:
                g = [a + b for a, b in zip(times(entered(own[t]), p[f"x{way}"]), p[f"c{way}"])]
                m = times(state, p[f"h{way}"])
                z, r = ([logistic(g[k + j] + m[k + j]) for j in range(h)] for k in (0, h))
                c = [math.tanh(g[2 * h + j] + r[j] * m[2 * h + j]) for j in range(h)]
                state = [z[j] * state[j] + (1 - z[j]) * c[j] for j in range(h)]
                states[t] = states[t] + state
        energy = [sum(math.tanh(x + y) * v for x, y, v in zip(times(s, p["a"]), p["ac"], p["av"])) for s in states]
        weight = [math.exp(e - max(energy)) for e in energy]
        return sum(w * sum(a * b for a, b in zip(s, p["o"])) for w, s in zip(weight, states)) / sum(weight) + p["oc"][0]

    size, step = toxicity.WINDOW, toxicity.STRIDE
    starts = [0]
    while starts[-1] + size < len(words):
        starts.append(starts[-1] + step)
    best = max(window(words[a : a + size] or [None]) for a in starts)
    return logistic(net.scale[0] * best + net.scale[1])


def test_toxicity_scores_by_plain_python(spark):
    """All windows of a long text, texts that end at a window's edge, ties between windows, repeated rows."""
    rng = random.Random(3)
    names = "balar bamen citos cirik divun dusel grobal naïve 日本 x1".split()
    texts = [" ".join(rng.choice(names) for _ in range(n)) for n in (300, 64, 65, 112, 113, 1)] + ["the same words " * 100, "", "-- ++"]
    net = toxicity.train([t.encode() for t in texts[:6]] + [b"grobal grobal"] * 6, [0] * 6 + [1] * 6, epochs=2)
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[3])], "doc_id long, text string")
    out = toxicity.toxicity(rows.repartition(2), net).collect()
    assert len(out) == len(texts) + 2
    want = {i: plain_score(net, t) for i, t in enumerate(texts)} | {None: plain_score(net, texts[3])}
    for r in out:
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= toxicity.THRESHOLD)
    assert {r.doc_id: r.n_windows for r in out} == {0: 6, 1: 1, 2: 2, 3: 2, 4: 3, 5: 1, 6: 6, 7: 1, 8: 1, None: 2}


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000, raising=False)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: list(zip(texts, labels)))
    rows = [(i, ("é" * 600 if i in (4, 7) else f"text {i} " * (1 + i % 5)), i % 2) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    taken = toxicity.fit(table, table)
    for c in (0, 1):
        own = [t for t, label in taken if label == c]
        assert 850 < sum(map(len, own)) <= 1000 and set(own) < {t.encode() for _, t, label in rows if label == c}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 20, raising=False)
    assert len(toxicity.fit(table, table)) == 100


def test_toxicity_gradients():
    net = toxicity.Network.new({b"the": 2, b"a": 3})
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) * 3
    words, labels = [[b"the", b"xyz", b"a"], [b"q"], []], np.array([1, 0, 1])

    def loss():
        net.known, net.inputs = {}, None
        s = toxicity.sigmoid(net.logits(words)[3].astype(np.float64))
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    for name, g in net.gradients(words, labels).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert abs(g[at] - (up - down) / 2 / e) < 1e-4, name


def test_bpe_equals_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    known = tokenizers.Tokenizer.from_file(path)
    out = by_id(bpe.encode_texts(docs, path))
    for i, t in texts_of(docs).items():
        ids = known.encode(t, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(empty, path).count() == 0
    rng = random.Random(3)
    ranges = [(32, 127), (160, 1500), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (9, 14)]
    texts = ["aaaaaaa" * 9 + "<|endoftext|>b", *("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(150)) for _ in range(200))]
    assert bpe.Encoder(bpe.Vocabulary.load(path)).encode(texts) == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_licenses(docs, empty):
    assert len(licenses.rules()) > 200
    out = by_id(licenses.scan(docs))
    for i, t in texts_of(docs).items():
        words = re.findall(ALNUM, lower(t))
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = out[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        every = [(m.start(), m.end(), rule.priority, k) for k, (rule, c) in enumerate(licenses.Scanner().rules) for m in c.finditer(lower(t))] if i < 12 else None
        if every is not None:
            kept = [x for x in every if not any(y != x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and ((y[0], y[1]) != (x[0], x[1]) or (-y[2], y[3]) < (-x[2], x[3])) for y in every)]
            assert sorted((s.start, s.stop) for s in r.spans) == sorted({(a, b) for a, b, _, _ in kept})
    assert licenses.scan(empty).count() == 0
    found = licenses.Scanner().spans("spdx-license-identifier: apache-2.0\nunder the apache license, version 2.0")
    assert [s.label for s in found] == ["apache-2.0", "apache-2.0"]


@pytest.mark.parametrize(
    "expression, names",
    [
        ("MIT OR Apache-2.0", ["mit", "apache-2.0"]),
        ("(MIT OR Apache-2.0) AND ( BSD-3-Clause OR (ISC AND Zlib) )", ["mit", "apache-2.0", "bsd-3-clause", "isc", "zlib"]),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR LicenseRef-MIT OR EPL-2.0", ["gpl-2.0", "epl-2.0"]),
        ("MIT AND MIT\n// SPDX-License-Identifier: Unlicense", ["mit", "mit", "unlicense"]),
        ("Apache-2.0", ["apache-2.0"]),
    ],
)
def test_licenses_of_an_expression(spark, expression, names):
    text = f"// SPDX-License-Identifier: {expression}\n"
    spans = [s for s in licenses.Scanner().spans(lower(text)) if s.priority == 5]
    assert [s.label for s in spans] == names and all(lower(text[s.start : s.stop]).startswith(s.label) for s in spans)
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(names) <= set(row.labels.split(",")) and row.score == 1


def expansions(items) -> list[str]:
    """Texts of a parsed pattern: every branch, every listed character, optional parts left out and
    taken; one of each part at a time where all combinations would be too many."""
    options = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [{"LITERAL": lambda: chr(arg), "RANGE": lambda: chr(arg[0])}.get(str(kind), lambda: " 1au"["SPACE DIGIT WORD NOT_SPACE".split().index(str(arg)[9:])])() for kind, arg in arg]
        elif name == "BRANCH":
            some = [t for b in arg[1] for t in expansions(b)]
        elif name == "SUBPATTERN":
            some = expansions(arg[3])
        elif name == "MAX_REPEAT":
            some = [""] * (not arg[0]) + [t * max(1, arg[0]) for t in expansions(arg[2])]
        else:
            some = ['"' if name == "ANY" else ""]
        options.append(list(dict.fromkeys(some)))
    if math.prod(map(len, options)) <= 4000:
        return ["".join(x) for x in itertools.product(*options)]
    return ["".join(options[j][0] if j != i else t for j in range(len(options))) for i, some in enumerate(options) for t in some]


def test_licenses_prefilter_loses_no_alternative():
    """All that a rule's pattern can take contains the rule's keyword."""
    for rule, pattern in licenses.Scanner().rules:
        if rule.priority == 5:
            assert rule.keyword == "spdx-license-identifier"
            continue
        made = [t for t in expansions(re._parser.parse(rule.pattern)) if pattern.search(t)]
        assert made and [t for t in made if rule.keyword not in re.sub(r"\s+", " ", t)] == []
    found = licenses.Scanner().spans("elastic licence 2.0. eclipse distribution licence. open data commons database license.")
    assert [s.label for s in found] == ["elastic-2.0", "epl-1.0", "odbl-1.0"]
    assert [s.label for s in licenses.Scanner().spans("except as contained in this\nnotice, the names of the above copyright holders")] == ["x11"]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 100])
def test_decontamination_brute_force(spark, docs, empty, monkeypatch, block_bytes):
    """In one block, and in several passes over blocks of the benchmark."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    texts = texts_of(docs)
    source = re.findall(ALNUM, lower(texts[6]))
    items = [(1, " ".join(source[50:75]).upper()), (2, "one"), (3, None), (4, "--"), (5, "gnu general public"), (5, "by the"), (6, "not to be found anywhere in these texts at all, never"), (None, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert (decontaminate._Blocks(bench, "item_id", "text").n > 2) == (block_bytes == 100)
    twice = docs.unionByName(docs.where("doc_id in (6, 20)"))
    out = by_id(decontaminate.decontaminate(docs, bench))
    assert sorted(map(str, decontaminate.decontaminate(twice, bench).collect())) == sorted(map(str, [*out.values(), out[6], out[20]]))
    clean = set(texts_of(decontaminate.clean_documents(docs, bench)))
    for i, t in texts.items():
        words, hit, met = re.findall(ALNUM, lower(t)), set(), set()
        for item, body in items:
            w = re.findall(ALNUM, lower(body or ""))
            for a in range(max(1, len(w) - 9) if w else 0):
                window = w[a : a + 10]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        met.add("null" if item is None else str(item))
        r = out[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(words), len(hit), sorted(met), bool(hit))
        assert sum(b - a for a, b in zip(r.hit_starts, r.hit_ends)) == len(hit)
        assert (i in clean) == (not hit)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def kneser_ney(texts: list[bytes]):
    """The model by its definition, over dictionaries."""
    order, size = quality.ORDER, 1 << quality.BITS
    grams = [collections.Counter() for _ in range(order)]
    for t in texts:
        seq = quality.tokens(t).tolist()
        grams[-1].update(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
    for n in range(order - 2, -1, -1):
        grams[n] = collections.Counter(g[1:] for g in grams[n + 1])
    cuts = []
    for table in grams:
        m = collections.Counter(table.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else None
        cuts.append([0.5, 1.0, 1.5] if y is None else [min(k, max(0.05, k - (k + 1) * y * m[k + 1] / m[k])) if m[k] else k / 2 for k in (1, 2, 3)])
    contexts = []
    for table, d in zip(grams, cuts):
        sums = collections.defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            sums[g[:-1]][0] += c
            sums[g[:-1]][1] += d[min(c, 3) - 1]
        contexts.append(sums)

    def p(gram):
        if not gram:
            return 1 / size
        n = len(gram) - 1
        total, taken = contexts[n].get(gram[:-1], (0, 0))
        if not total:
            return p(gram[1:])
        c = grams[n].get(gram, 0)
        return (c - (cuts[n][min(c, 3) - 1] if c else 0)) / total + taken / total * p(gram[1:])

    return p


def test_quality_model_by_definition(spark):
    texts = [f"Some words, number {i} of {i * 7 % 11}.\nThe end!" for i in range(30)]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney([t.encode() for t in texts])
    for t in (b"Some words, and others", "où été".encode(), b"|||"):
        seq = quality.tokens(t).tolist()
        want = sum(math.log10(p(tuple(seq[i : i + quality.ORDER]))) for i in range(len(seq) - quality.ORDER + 1))
        sizes, got = quality.log_probs(model, [t])
        assert sizes[0] == len(t) + 1 and abs(got[0] - want) < 2e-3 * abs(want)
    context = np.random.default_rng(1).integers(0, 64, 3)
    start = int(context[0] << 18 | context[1] << 12 | context[2] << 6)
    assert abs((10.0 ** model.dense()[start : start + 64].astype(np.float64)).sum() - 1) < 1e-2


def test_quality_counts_all_trusted_documents(spark):
    """24,000 of them, whose trigrams are mostly met once or twice, so that a part gives other counts."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(24_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    p = kneser_ney([t.encode() for t in texts])
    out = by_id(quality.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"))))
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        seq = quality.tokens(t.encode()).tolist()
        want = sum(math.log10(p(tuple(seq[k : k + quality.ORDER]))) for k in range(len(seq) - quality.ORDER + 1))
        assert abs(out[i].log10_prob - want) < 2e-3 * abs(want)


def test_quality_tells_all_characters_apart(spark):
    """Capitals, digits, signs and letters beyond ASCII are not taken for others of their kind."""
    assert len({tuple(quality.tokens(bytes([b]))) for b in range(255)}) == 255
    texts = [f"BCD {i * 12 % 13 + 120} éè <{i % 7}> ж ." for i in range(40)]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    known = "BCD 121 éè <1> ж ."
    p = kneser_ney([t.encode() for t in texts])
    for other in ("BDC 121 éè <1> ж .", "BCD 989 éè <1> ж .", "BCD 121 èé <1> ж .", "BCD 121 éè $1> ж .", "BCD 121 éè <1> д ."):
        _, (a, b) = quality.log_probs(model, [known.encode(), other.encode()])
        seq = list(other.encode())
        seq = [255] * 3 + seq + [255]
        want = sum(math.log10(p(tuple(seq[i : i + 4]))) for i in range(len(seq) - 3))
        assert a > b + 0.5 and abs(b - want) < 1e-4 * abs(want)


def test_quality_keeps_good_and_rejects_noise(spark, docs, empty):
    rng = random.Random(4)
    names = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lar men tos rik vun".split()]
    rows = [(i, " ".join(rng.choice(names) for _ in range(120)) + ".", "en", 1) for i in range(200)]
    rows += [(i, "".join(chr(rng.randrange(33, 127)) for _ in range(600)), "en", 0) for i in range(200, 240)]
    rows += [(240, None, None, 1), (241, "", "en", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = table.where("doc_id % 2 = 0").select("doc_id", "quality")
    out = by_id(quality.classify(table.drop("quality").withColumn("kept", F.lit(1)), labels))
    assert sum(out[i].kept for i in range(200)) >= 196 and not any(out[i].kept for i in range(200, 242))
    kept = quality.good_documents(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs.where("length(text) > 0"), labels.limit(0)).where("kept").count() == docs.where("length(text) > 0").count()


def test_jaccard_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    for i in range(1000, 1060):  # one group of near copies, larger than what is compared pair by pair
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(300)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(2000, "a b c d"), (2001, None), (2002, "a b c d")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    sets = {}
    for i, t in rows:
        w = re.findall(ALNUM, lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links, root = collections.Counter(), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = by_id(jaccard.jaccard_classes(table))
    assert {i: (r.class_id, r.n_links) for i, r in out.items()} == {i: (find(i), links[i]) for i in ids}
    kept = {r.doc_id for r in jaccard.one_of_each_class(table).collect()}
    assert kept == {i for i in ids if find(i) == i}
    assert jaccard.jaccard_classes(empty).count() == 0
    again = table.unionAll(table.where("doc_id < 10"))
    assert jaccard.jaccard_classes(again).count() == again.count()
    nameless = table.where("doc_id = 1000").withColumn("doc_id", F.lit(None).cast("long"))
    none = [r for r in jaccard.jaccard_classes(table.unionByName(nameless)).collect() if r.doc_id is None]
    assert [(r.class_id, r.n_links, r.n_copies) for r in none] == [(None, 0, 1)]


def test_ids_that_repeat(spark):
    """Copies under one id are one document in the pipeline; of an id's different texts one is compared,
    always the same one, and the other is in the class of its set."""
    base = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(base), " ".join(["x", *base[1:]]), " ".join(f"q{i}" for i in range(30))
    rows = [(5, one, "b"), (5, one, "a"), (5, other, "c"), (7, near, "d"), (8, other, "e"), (9, "alone here", "f"), (9, "alone here", "f"), (None, one, "g"), (None, one, "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = [sorted(map(str, jaccard.jaccard_classes(table.repartition(n)).collect())) for n in (1, 3, 5)]
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    kept = jaccard.one_of_each_class(table)
    assert kept.columns == table.columns
    out = sorted(map(tuple, kept.collect()), key=str)
    assert [r for r in out if r[0] in (9, None)] == [(9, "alone here", "f"), (None, one, "g"), (None, one, "g")]
    fives = [r for r in out if r[0] == 5]
    assert (5, one, "a") in fives and (5, one, "b") not in fives and (5, other, "c") in fives
    assert {r[0] for r in out} & {7, 8} in ({7}, {8})


def test_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 100 + i % 3] + [f"x{i}"] + base[102:])) for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_classes(table).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 69)}


@pytest.mark.parametrize("hub", [components.LEAST_HUB, 3])
def test_components(spark, monkeypatch, hub):
    """Also with so low a bound that there are hubs."""
    monkeypatch.setattr(components, "LEAST_HUB", hub)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    links += [(500, 500 + i) for i in range(1, 40)]
    root = {n: n for e in links for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    frame = spark.createDataFrame(links, "a long, b long")
    out = {r.node: r.root for r in components.components(frame).collect()}
    assert out == {n: find(n) for e in links for n in e if e[0] != e[1]}
    led = components.leads(frame).collect()
    assert {r.node: r.root for r in led} == {n: r for n, r in out.items() if n != r} and len(led) == len({r.node for r in led})
    assert components.components(frame.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 5), (10_000, 1 << 62), (5_000, 20_000), (4_096, 4_096), (8_193, 100)):
        values = np.sort(rng.integers(0, most, n).astype(np.uint64))
        coded = EliasFano(values)
        assert (coded.all() == values).all()
        sought = np.sort(np.concatenate((values[:500], rng.integers(0, most, 500).astype(np.uint64))))
        place, equal = coded.successors(sought)
        assert (place == np.searchsorted(values, sought)).all() and (equal == np.isin(sought, values)).all()
    dense = EliasFano(np.sort(rng.integers(0, 1 << 30, 100_000)))
    assert dense.nbytes < 0.4 * 8 * 100_000


@pytest.mark.parametrize("hot_tokens", [lm.HOT_TOKENS, 20])
def test_lm_base_and_model(spark, docs, empty, monkeypatch, hot_tokens):
    """Also with so low a bound that there are hot pairs, which no shard meets."""
    monkeypatch.setattr(lm, "BATCH_BYTES", 4000)
    monkeypatch.setattr(lm, "HOT_TOKENS", hot_tokens)
    if hot_tokens == 20:
        monkeypatch.setattr(lm, "HOT", 8)
    docs = docs.unionByName(docs.where("doc_id in (9, 12)")).unionByName(docs.where("doc_id in (14, 1)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, re.findall(BLANK, lower(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, pairs, behind = collections.Counter(), collections.Counter(), collections.Counter()
    for i, words in rows:
        if not held(i):
            chain = ["<", *words, ">"]
            counts.update(chain[1:])
            pairs.update(zip(chain, chain[1:]))
            behind.update(chain[:-1])
    total, z = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    hot = {w for w in behind if behind[w] >= lm.hot_from(total)}
    hot_pairs = [x for x, n in pairs.items() if n >= lm.hot_from(total)]
    assert all(v in hot for v, _ in hot_pairs) and (len(hot_pairs) > 20 or hot_tokens != 20)
    left = {v: max(1 - sum(n - lm.DISCOUNT for (u, _), n in pairs.items() if u == v) / behind[v], lm.DISCOUNT / behind[v]) for v in behind}
    want = []
    for i, words in rows:
        base, score = 0.0, 0.0
        chain = ["<", *words, ">"]
        for v, w in zip(chain, chain[1:]):
            p = (counts[w] + 0.5) / z
            base += math.log10(p)
            a = (pairs[v, w] - lm.DISCOUNT) / behind[v] if pairs[v, w] else 0.0
            score += math.log10(a + left.get(v, 1.0) * p)
        want.append((i, held(i), len(words) + 1, sum(counts[w] > 0 for w in chain[1:]), total, base, score))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    out = sorted((tuple(r) for r in lm.score(docs).collect()), key=order)
    assert [r[:5] for r in out] == [r[:5] for r in sorted(want, key=order)]
    for r, e in zip(out, sorted(want, key=order)):
        assert abs(r[5] - e[5]) < 1e-9 * max(1, abs(e[5]))
        # Two values of half a step of quantisation at most.
        assert abs(r[6] - e[6]) < lm.STEP_SIZE * r[2] + 0.01
    assert lm.score(empty).count() == 0


def test_trie_finds_within_a_context():
    """Every pair against a dictionary, contexts and words at the edges among them."""
    rng = np.random.default_rng(9)
    keys = sorted({(int(v), int(w)) for v, w in zip(rng.integers(0, 40, 3000) ** 2, rng.integers(0, 4000, 3000))} | {(0, 0), (1600, 5000)})
    counts = {k: int(n) for k, n in zip(keys, rng.integers(1, 50, len(keys)))}
    v, w = (np.array(c, np.uint64) for c in zip(*keys))
    trie = lm.Trie(v, w, np.array(list(counts.values())), lm.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    asked = sorted({*keys[::3], *((a, b) for a in (0, 1, 4, 9, 1600, 1700) for b in range(0, 5001, 7))})
    n, code, left = trie.find(*(np.array(c, np.uint64) for c in zip(*asked)))
    behind = collections.Counter()
    for (a, _), c in counts.items():
        behind[a] += c
    for (a, b), total, found, rest in zip(asked, n, code, left):
        assert total == behind[a] and (rest > 0) == (a in behind)
        assert (found < 255) == ((a, b) in counts)
        if found < 255:
            assert found == lm.discounted(np.array([counts[a, b]]), np.array([behind[a]]))[0]
    assert trie.nbytes > 0


@pytest.mark.parametrize("hot, hot_tokens, common", [(64, 4_000_000, 65_536), (8, 20, 12), (10**9, 10**9, 0)])
def test_lm_one_rule_for_all_contexts(spark, docs, monkeypatch, hot, hot_tokens, common):
    """Against the quantised values, with some, many and no hot words, and with all, some and no common ones."""
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "BATCH_BYTES", 4000)
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "HOT_TOKENS", hot_tokens)
    split = {i: ["<", *re.findall(BLANK, lower(t)), ">"] for i, t in texts_of(docs).items()}
    counts, behind = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, chain in split.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(chain[1:])
            for v, w in zip(chain, chain[1:]):
                behind[v][w] += 1
    total, z = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    n_hot = sum(sum(c.values()) >= lm.hot_from(total) for c in behind.values())
    assert n_hot == 0 if hot == 10**9 else n_hot > 3
    step = lambda p: round(-math.log10(p) / lm.STEP_SIZE) if p else None
    value = lambda p: 10 ** (-lm.STEP_SIZE * step(p)) if p else 0.0
    a = {v: {w: value((n - lm.DISCOUNT) / sum(c.values())) for w, n in c.items()} for v, c in behind.items()}
    left = {v: value(max(1 - sum(a[v].values()), lm.DISCOUNT / sum(c.values()))) for v, c in behind.items()}
    out = by_id(lm.score(docs))
    for i, chain in split.items():
        want = sum(math.log10(a.get(v, {}).get(w, 0.0) + left.get(v, 1.0) * (counts[w] + 0.5) / z) for v, w in zip(chain, chain[1:]))
        assert abs(out[i].score - want) < 1e-5 * max(1, abs(want))


def test_repetition_brute_force(docs, empty):
    out = by_id(repetition.repetition_rules(docs))
    for i, t in texts_of(docs).items():
        words = re.findall(BLANK, t)
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = t.split("\n")
        dup = sum(bool(re.search(BLANK, line)) and line in lines[:k] for k, line in enumerate(lines))
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (dup, len(again), failed)
        assert not (r.kept and failed) and r.kept == (r.reasons == "")
        for n in repetition.COVERED_LIMITS:
            c = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
            inside = {k + j for k in range(len(words) - n + 1) if c[tuple(words[k : k + n])] > 1 for j in range(n)}
            share = sum(len(words[k]) for k in inside) / max(1, r.word_chars)
            assert (f"covered{n}" in r.reasons.split(",")) == (share > repetition.COVERED_LIMITS[n])
        for n in repetition.TOP_LIMITS:
            c = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
            top = max((m * sum(map(len, g)) for g, m in c.items() if m > 1), default=0) / max(1, r.word_chars)
            assert (f"top{n}" in r.reasons.split(",")) == (top > repetition.TOP_LIMITS[n] and r.n_words >= repetition.TOP_MIN_WORDS)
        chars = sum(len(line) for k, line in enumerate(lines) if re.search(BLANK, line) and line in lines[:k])
        assert abs(r.dup_line_share - chars / max(1, sum(map(len, lines)))) < 1e-12
    assert repetition.repetition_rules(empty).count() == 0


def thue_morse(size: int) -> tuple[str, str]:
    """Two texts whose polynomial hashes modulo a power of two are equal."""
    ones = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[i] for i in ones), "".join("ba"[i] for i in ones)


def test_texts_that_cancel_out_are_told_apart(spark):
    a, b = thue_morse(4096)
    four = "the same four words"
    texts = [f"{a}\n{b}", f"{four} {a} {four} {b} and then some more words", f"{four} {a} {four} {a}"]
    rows = by_id(repetition.repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(rows[i].n_dup_lines, rows[i].n_repeat_words) for i in range(3)] == [(0, 0), (0, 0), (0, 10)]
    known = {r.doc_id: r.n_known for r in lm.score(spark.createDataFrame([(1, f"x {a}"), (5, f"{b} x")], "doc_id long, text string")).collect()}
    assert zlib.crc32(b"5") % 5 == 1 and known == {1: 3, 5: 2}
    _, words, _ = lm.tokens([a.encode(), b.encode()])
    assert len(set(words.tolist())) == 3


def test_windows_of_one_hash_are_compared():
    """The same counts from one key for all windows, which exact keys replace, as from keys that differ."""
    rng = np.random.default_rng(3)
    words, owner = rng.integers(0, 3, 200), np.repeat([0, 1], 100)
    at = np.flatnonzero(owner[:198] == owner[2:])
    met = collections.Counter((int(owner[i]), *words[i : i + 3].tolist()) for i in at)
    want = [met[(int(owner[i]), *words[i : i + 3].tolist())] for i in at]
    exact = np.unique(np.stack([owner[at], *(words[at + k] for k in range(3))]), axis=1, return_inverse=True)[1].ravel()
    for keys in (np.zeros(len(at), np.uint64), exact, exact // 2):
        again, places = repetition.repeated(keys, at, 3, words, owner)
        assert places.tolist() == want and again.tolist() == [n > 1 for n in want]


def test_pipeline_stages_follow_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = texts_of(docs)
    whole = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    good = kept["quality classifier"]
    assert all(whole[i] == t for i, t in good.items()) and 0.7 * len(whole) < len(good) < len(whole)
    report = by_id(linededup.line_report(spark.createDataFrame(list(good.items()), "doc_id long, text string")))
    cut = kept["line dedup"]
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in cut.items()} == {i: r.kept_sha256 for i, r in report.items()}
    classes = by_id(jaccard.jaccard_classes(spark.createDataFrame(list(cut.items()), "doc_id long, text string")))
    single = kept["n-gram Jaccard join"]
    assert single == {i: t for i, t in cut.items() if classes[i].class_id == i}
    found = by_id(decontaminate.decontaminate(spark.createDataFrame(list(single.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    clean = kept["benchmark decontamination"]
    assert clean == {i: t for i, t in single.items() if not found[i].contaminated}
    known = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    rows = by_id(corpus_pipeline.run(spark, SF))
    assert {i: r.ids for i, r in rows.items()} == {i: known.encode(t, add_special_tokens=False).ids for i, t in clean.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents at all; null ids and texts, an id that repeats with equal and with other texts."""
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, line, "en", "s", 9), (1, line, "en", "s", 9), (1, f"{line} and more", "en", "r", 9), (2, None, "en", None, None), (3, "", None, "s", 0), (None, line, "en", "s", 9), (None, "other words here", "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("empty", []), ("odd", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        left = sorted(map(tuple, docs.collect()), key=lambda r: (str(r[0]), -len(r[1] or ""), str(r)))
        assert [r[:2] for r in left if r[0] is None] == ([(None, line), (None, "other words here")] if own else [])
        assert [r[1] for r in left if r[0] == 1] == ([f"{line} and more", line] if own else [])
        assert {r[0] for r in left} == ({1, 2, 3, None} if own else set())
        out = corpus_pipeline.run(spark, at)
        assert "ids" in out.columns and out.count() == 0 if not own else {r.doc_id for r in out.collect()} <= {1, None}


def pipeline_tables() -> tuple[list[tuple], dict[int, int], list[str]]:
    """Documents, labels, and texts of a benchmark, with something to do for every stage."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lar men tos rik vun sel".split()]
    line = lambda n=14: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts: list[str | None] = ["\n".join(line() for _ in range(4)) for _ in range(330)]
    common = line()
    for i in (3, 50, 90, 141, 308):
        texts[i] = f"{texts[i]}\n  {common.upper() if i == 90 else common}"
    for i, like in ((20, 120), (121, 20), (315, 60)):  # near copies, two of them in one class
        texts[like] = " ".join(texts[like].split())
        texts[i] = re.sub(r"^\S+", "vunvun", texts[like])
    bench = [" ".join(texts[i].split("\n")[1].split()[1:13]) for i in (33, 311)] + [" ".join(texts[40].split("\n")[0].split()[:9]) + " unheard"]
    texts += [None, "", *("".join(chr(rng.randrange(33, 127)) for _ in range(300)) for _ in range(8)), "ba" * 150]
    rows = [(i, t, ("en", "fr", None)[0 if i < 280 else 1 if i < 300 else 2] if i < 320 else "de", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    labels = {i: 1 for i in range(300) if i % 11} | {i: 0 for i in range(332, 336)}
    return rows, labels, bench


def expected_quality(rows: list[tuple], labels: dict[int, int]) -> dict[int, tuple[float, float, float, bool]]:
    """log10 p, both thresholds of the rate, and the verdict of each document."""
    p = kneser_ney([t.encode() for i, t, *_ in rows if t is not None and labels.get(i) == 1])
    rate, sums, sizes, by = {}, {}, {}, collections.defaultdict(list)
    for i, t, lang, *_ in rows:
        seq = quality.tokens(t.encode()).tolist() if t else []
        sizes[i] = max(0, len(seq) - quality.ORDER + 1)
        sums[i] = sum(math.log10(p(tuple(seq[k : k + quality.ORDER]))) for k in range(sizes[i]))
        rate[i] = -sums[i] / max(1, sizes[i])
        if sizes[i] and labels.get(i) == 1:
            by[lang or ""].append(rate[i])
            by[None].append(rate[i])
    cuts = {k: [sorted(r)[math.ceil(q * len(r)) - 1] for q in (quality.TAIL, 1 - quality.TAIL)] for k, r in by.items()}
    out = {}
    for i, _, lang, *_ in rows:
        low, high = cuts.get(lang or "", cuts[None])
        room = quality.SLACK / math.sqrt(max(1, sizes[i]))
        out[i] = sums[i], low - room, high + room, sizes[i] > 0 and low - room <= rate[i] <= high + room
        assert not sizes[i] or min(abs(rate[i] - low + room), abs(rate[i] - high - room)) > 2e-3, "too close for half floats"
    return out


def expected_stages(rows: list[tuple], labels: dict[int, int], bench: list[str]) -> list[list[tuple]]:
    """What each of the first four stages leaves, by plain Python."""
    verdicts = expected_quality(rows, labels)
    stages = [[r for r in rows if verdicts[r[0]][3]]]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t, *_ in stages[0]:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = {k: max(h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    cut = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t, *_ in stages[0]}
    stages.append([(i, cut[i], lang, source, len(cut[i])) for i, _, lang, source, _ in stages[0]])
    words = {i: re.findall(ALNUM, lower(t)) for i, t, *_ in stages[1]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    stages.append([r for r in stages[1] if find(r[0]) == r[0]])
    windows = {tuple(w[a : a + 10]) for w in (re.findall(ALNUM, lower(t)) for t in bench) for a in range(max(1, len(w) - 9))}
    stages.append([r for r in stages[2] if not any(tuple(words[r[0]][k : k + 10]) in windows for k in range(len(words[r[0]])))])
    return stages


def test_quality_verdicts_and_pipeline_rows_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, labels, bench = pipeline_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for name, frame in (("documents", docs), ("labels", marks), ("benchmark", spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    found = by_id(quality.classify(docs, marks))
    for i, (log10_prob, low, high, kept) in expected_quality(rows, labels).items():
        r = found[i]
        assert abs(r.log10_prob - log10_prob) <= 2e-3 * abs(log10_prob) and r.kept == kept
        assert abs(math.log10(r.least) - low) < 2e-3 and abs(math.log10(r.most) - high) < 2e-3
    stages = expected_stages(rows, labels, bench)
    sizes = [len(rows), *map(len, stages)]
    assert all(a > b for a, b in zip(sizes[:1] + sizes[2:], sizes[1:2] + sizes[3:])) and stages[0] != stages[1]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), expected in zip(corpus_pipeline.STAGES, stages):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert sorted(map(tuple, docs.collect())) == expected
    known = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    whole = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert {i: r.ids for i, r in whole.items()} == {i: known.encode(t, add_special_tokens=False).ids for i, t, *_ in stages[-1]}
