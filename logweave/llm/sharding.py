"""Shards by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A key goes down the tree. At each node every child draws -ln(u) / weight, where u comes from a hash of
the child's name and the key; the least draw wins, so a child wins in proportion to its weight. The
weight of a region or a rack is the sum of its shards' weights.

What moves if the tree changes:

- A draw depends on no other child. If a shard's weight changes, so do the weights of its rack and
  region, and at each level rows move only into or out of the child whose weight changed. Two
  subtrees whose weights stay exchange nothing.
- Shards that are added later form a batch of their own: the batch has its own regions and racks below
  the root, under the same numbers, with the weight of what it adds. A rack's share is then the sum
  over its batches, and no weight of an earlier batch changes, so a new shard takes rows only into
  itself, wherever it is put.

No row is compared with another: the shard is an expression of the key, without a shuffle. Slots, the
rows' numbers inside a shard, need counts and are made by `slots`.

Defined results: a null key is the text "null", so such rows share a shard. Null texts have no bytes
and the CRC of an empty text, 0. Rows with equal keys go to one shard, each to a slot of its own; equal
rows are interchangeable. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import begins, counted, each_copy, numbers_within
from .text import staged

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of a shard that one task numbers, as long as there are at most 2^MOST_BITS such buckets.
BUCKET_ROWS, MOST_BITS = 4096, 12
_WORD = float(1 << 32)


@dataclass(frozen=True)
class Leaf:
    batch: int
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """The shards with their places. Shards of weight 0 get no rows."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self) -> None:
        shards = [x.shard for x in self.leaves]
        if len(set(shards)) < len(shards):
            raise ValueError("a shard has one place in the tree")
        if not any(x.weight > 0 for x in self.leaves) or any(x.weight < 0 for x in self.leaves):
            raise ValueError("weights are not negative, and one at least is positive")

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Tree:
        """`shards` shards of weight 1 in each of `racks` racks of each of `regions` regions."""
        return Tree(tuple(Leaf(0, i // (racks * shards), i // shards % racks, i) for i in range(regions * racks * shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in the rack of the least weight, as a batch of its own."""
        racks: dict[tuple[int, int], float] = {}
        for x in self.leaves:
            racks[x.region, x.rack] = racks.get((x.region, x.rack), 0.0) + x.weight
        region, rack = min(racks, key=lambda r: (racks[r], r))
        new = Leaf(max(x.batch for x in self.leaves) + 1, region, rack, max(x.shard for x in self.leaves) + 1, weight)
        return Tree((*self.leaves, new))

    def weighted(self, shard: int, weight: float) -> Tree:
        """The same places, another weight for a shard."""
        return Tree(tuple(replace(x, weight=float(weight)) if x.shard == shard else x for x in self.leaves))

    def levels(self) -> list[list[list[tuple[str, float, int]]]]:
        """For each level and each node of the level above: its children's names, weights and numbers.
        The number of an inner node is its place in the next level's list, that of a leaf its shard."""
        names = lambda x: (f"{x.batch}/{x.region}", f"{x.batch}/{x.region}/{x.rack}", f"{x.batch}/{x.region}/{x.rack}/{x.shard}")
        live = [x for x in self.leaves if x.weight > 0]
        weights: dict[str, float] = {}
        for x in live:
            for name in names(x):
                weights[name] = weights.get(name, 0.0) + x.weight
        shard = {names(x)[2]: x.shard for x in live}
        parents, out = [""], []
        for depth in range(3):
            nodes = list(dict.fromkeys(names(x)[depth] for x in live))
            number = {n: shard.get(n, i) for i, n in enumerate(nodes)}
            parent = lambda n: n.rsplit("/", 1)[0] if depth else ""
            out.append([[(n, weights[n], number[n]) for n in nodes if parent(n) == p] for p in parents])
            parents = nodes
        return out


def _draw(name: Column, weight: Column, key: Column) -> Column:
    word = F.conv(F.substring(F.sha2(F.concat(name, F.lit(":"), key), 256), 1, 8), 16, 10).cast("double")
    return -F.ln((word + 0.5) / _WORD) / weight


def with_shard(rows: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """The rows with the number of the shard that the tree gives their key."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    columns = rows.columns
    rows = rows.withColumns({"__key": text, "__node": F.lit(0)})
    for level in tree.levels():
        children = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("number")) for n, w, i in own]) for own in level])
        draws = F.transform(F.get(children, F.col("__node")), lambda c: F.struct(_draw(c["name"], c["weight"], F.col("__key")).alias("draw"), c["number"].alias("number")))
        rows = rows.withColumn("__node", F.array_min(draws)["number"])
    return rows.select(*[F.col(c) for c in columns if c != out], F.col("__node").alias(out))


def slots(rows: DataFrame, n_rows: int, shard: str = "shard") -> DataFrame:
    """The rows with their `slot`, 0, 1, 2 ... in each shard, in the order of a hash of the whole row.

    n_rows: about how many there are; it sets only how many buckets a shard is numbered in, as the
    order is that of the hash whatever its leading bits have been used for."""
    columns = rows.columns
    shards = 1 + (rows.agg(F.max(shard)).first()[0] or 0)
    bits = min(MOST_BITS, max(0, (n_rows // (shards * BUCKET_ROWS)).bit_length()))
    parts = counted(rows)
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns], F.col("part").cast("string"))
    hashed = parts.withColumn("order", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"))
    hashed = hashed.withColumn("bucket", F.shiftright("order", 60 - bits))
    totals = hashed.groupBy(shard, "bucket").agg(F.sum("copies").alias("copies"))
    # At most shards * 2^MOST_BITS rows.
    placed = hashed.join(F.broadcast(begins(totals, [shard], "bucket")), [shard, "bucket"])
    first = numbers_within(placed, [shard, "bucket"], ["order", *[c for c in columns if c != shard], "part"])
    return first.select(*columns, each_copy(first).alias("slot"))


#: The tree of the query: 4 regions of 2 racks of 5 shards.
TREE = Tree.regular(4, 2, 5)


def assign(docs: DataFrame, tree: Tree = TREE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: the place of every row, and its shard if the
    tree had one more. The texts are read once; what is left of a row goes through a written table."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = with_shard(with_shard(rows, tree), tree.grown(), out="grown_shard")
    held = staged(rows, "shards")
    return slots(held, held.count())


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def _tree_sql(tree: Tree, out: str, source: str) -> tuple[str, str]:
    """Common table expressions that send the rows of `source` down the tree, and the last one's name."""
    steps, at = [], source
    for depth, level in enumerate(tree.levels()):
        nodes = ", ".join(f"({p}, '{n}', {w}, {i})" for p, own in enumerate(level) for n, w, i in own)
        now = f"{out}_{depth}"
        node = "0" if depth == 0 else f"{out}_node"
        carried = "d.* EXCLUDE (" + f"{out}_node)" if depth else "d.*"
        steps.append(
            f"{now} AS (SELECT {carried}, (SELECT arg_min(n.number, -ln((('0x' || substr(sha256(n.name || ':' || d.key), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296) / n.weight::DOUBLE)"
            f" FROM (VALUES {nodes}) n(parent, name, weight, number) WHERE n.parent = {node}) AS {out}_node FROM {at} d)"
        )
        at = now
    return ",\n".join(steps), at


#: CRC-32 of a list of bytes, by the table of the polynomial that is usual for it.
CRC_TABLE_SQL = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i)))"


def crc_sql(blob: str) -> str:
    """The CRC-32 of a blob, where crc_table is in scope."""
    data = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_SHARD, _AT = _tree_sql(TREE, "shard", "keyed")
_GROWN, _GROWN_AT = _tree_sql(TREE.grown(), "grown", _AT)
ORACLE = rf"""
WITH {CRC_TABLE_SQL}, keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, {crc_sql("encode(coalesce(text, ''))")} AS text_crc32
  FROM documents, crc_table
), {_SHARD},
{_GROWN}, parts AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 4096 AS part FROM {_GROWN_AT}
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard_node::INT AS shard, grown_node::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard_node ORDER BY substr(sha256(concat_ws(':', key, size, text_crc32, shard_node, grown_node, part)), 1, 15), doc_id, size, text_crc32, part) - 1 AS slot
FROM parts
"""
