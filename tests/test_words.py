import random

from pyspark.sql import functions as F

from logweave.functions import bigint as B
from logweave.functions import words as W

EDGES = [0, 1, 2**60 - 1, 2**60, 2**64 - 1, 2**64, 2**120 - 1, 2**120, 10**18, 10**36, 10**77, 2**180, 2**240, 2**255 - 1, 2**255, 2**256 - 1]


def values(n=400):
    rnd = random.Random(7)
    return EDGES + [rnd.getrandbits(rnd.randint(1, 256)) for _ in range(n)]


def test_words_to_text_and_keys(spark):
    vs = values()
    df = spark.createDataFrame([(i, f"{v:064x}") for i, v in enumerate(vs)], "i int, w string")
    rows = df.select(
        "i",
        F.expr(W.uint_text("w")).alias("u"),
        F.expr(W.int_text("w")).alias("s"),
        W.int_key(F.col("w")).alias("k"),
    ).collect()
    signed = [v - (1 << 256) if v >> 255 else v for v in vs]
    for r in rows:
        assert r.u == str(vs[r.i])
        assert r.s == str(signed[r.i])
        assert r.k == W.key_literal(signed[r.i], signed=True)
    by_key = [r.i for r in sorted(rows, key=lambda r: r.k)]
    assert [signed[i] for i in by_key] == sorted(signed)


def test_decimal_keys_sort_as_numbers(spark):
    vs = values(100)
    signed = sorted(set(vs + [-v for v in vs]))
    df = spark.createDataFrame([(str(v),) for v in signed], "v string")
    rows = df.select("v", W.decimal_key(F.col("v")).alias("k")).collect()
    assert all(r.k == W.decimal_key_literal(int(r.v)) for r in rows)
    assert [int(r.v) for r in sorted(rows, key=lambda r: r.k)] == signed


def test_exact_sums(spark):
    vs = values(300)
    df = spark.createDataFrame([(i % 5, str(v), -1 if i % 3 else 1) for i, v in enumerate(vs)], "g int, v string, s int")
    out = df.groupBy("g").agg(
        B.sum_u256(F.col("v")).alias("u"),
        B.sum_weighted(F.col("v"), F.col("s")).alias("w"),
        B.sum_signed(F.when(F.col("s") < 0, F.concat(F.lit("-"), F.col("v"))).otherwise(F.col("v"))).alias("n"),
    )
    for r in out.collect():
        mine = [(v, -1 if i % 3 else 1) for i, v in enumerate(vs) if i % 5 == r.g]
        assert r.u == str(sum(v for v, _ in mine))
        assert r.w == r.n == str(sum(v * s for v, s in mine))


def test_difference_and_small_sums(spark):
    pairs = [("5", "7"), ("0", "0"), ("1012679061520274098", "1012625572111479566"), (str(2**256 - 1), "-1"), ("-3", "-3")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", B.difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == str(int(r.a) - int(r.b))


def test_quantities_and_hex(spark):
    texts = ["0x1a", "0x0", "0x", "1a", "0xzz", None, "0x7fffffffffffffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(W.quantity(F.col("t")).alias("q")).collect()]
    assert got == [26, 0, None, None, None, None, 2**63 - 1]
    raw = spark.createDataFrame([("0xdeadbeef",), ("0xabc",), ("0xzz",), ("0x",)], "t string")
    got = [r.x for r in raw.select(W.bytes_to_hex(W.hex_to_bytes(F.col("t"))).alias("x")).collect()]
    assert got == ["0xdeadbeef", None, None, "0x"]
