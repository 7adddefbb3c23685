"""The driver's tables as raw contract logs (deterministic, one pass over each table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import encode as X
from logweave.functions.abi_types import EventDef
from logweave.sources.catalog import Catalog

CHAIN = 1

TRANSFER = EventDef.parse("Transfer(address indexed from, address indexed to, uint256 value)")
NFT_TRANSFER = EventDef.parse("Transfer(address indexed from, address indexed to, uint256 indexed tokenId)")
APPROVAL = EventDef.parse("Approval(address indexed owner, address indexed spender, uint256 value)")
MINT = EventDef.parse("Mint(address indexed to, uint256 amount)")
BURN = EventDef.parse("Burn(address indexed from, uint256 amount)")
ERROR_SEEN = EventDef.parse("ErrorSeen(uint256 code)")
TOKEN_CATALOG = Catalog.of(CHAIN, [TRANSFER, APPROVAL, MINT, BURN])

CREATED = EventDef.parse("ProposalCreated(uint256 indexed proposalId, address indexed creator, uint8 indexed accessLevel, bytes32 ipfsHash)")
ACTIVATED = EventDef.parse("VotingActivated(uint256 indexed proposalId, bytes32 indexed snapshotBlockHash, uint24 votingDuration)")
QUEUED = EventDef.parse("ProposalQueued(uint256 indexed proposalId, uint128 votesFor, uint128 votesAgainst)")
FAILED = EventDef.parse("ProposalFailed(uint256 indexed proposalId, uint128 votesFor, uint128 votesAgainst)")
EXECUTED = EventDef.parse("ProposalExecuted(uint256 indexed proposalId)")
CANCELED = EventDef.parse("ProposalCanceled(uint256 indexed proposalId)")
PAYLOAD = EventDef.parse("PayloadSent(uint256 indexed proposalId, uint40 payloadId, address indexed payloadsController, uint256 indexed chainId, uint256 payloadNumberOnProposal, uint256 numberOfPayloadsOnProposal)")
VOTE = EventDef.parse("VoteForwarded(uint256 indexed proposalId, address indexed voter, bool indexed support, (address,uint128)[] votingAssetsWithSlot)")
GOVERNANCE_CATALOG = Catalog.of(CHAIN, [CREATED, ACTIVATED, QUEUED, FAILED, EXECUTED, CANCELED, PAYLOAD, VOTE])

DELTA = EventDef.parse("Delta(address indexed account, int256 amount)")
READING = EventDef.parse("Reading(int64 indexed delta, bytes4 indexed tag, int256 signed, uint128 amount, bool open, uint8 level, bytes32 digest)")
POSTED = EventDef.parse("Posted(uint256 indexed docId, string indexed lang, string text, bytes source, uint256[] sizes, (address,uint128)[] pairs)")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, read as it lies; spark.sql.files.maxPartitionBytes sets the size of its tasks."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def word_hash(value: Column) -> Column:
    return F.concat(F.lit("0x"), X.uint_word(value))


def _log(address: Column, topics: Column, data: Column, block: Column, timestamp: Column, tx: Column, index: Column) -> Column:
    return F.struct(
        address.alias("address"),
        topics.alias("topics"),
        data.alias("data"),
        block.cast("long").alias("block_number"),
        word_hash(block).alias("block_hash"),
        timestamp.cast("long").alias("block_timestamp"),
        tx.alias("transaction_hash"),
        F.lit(0).alias("transaction_index"),
        index.cast("int").alias("log_index"),
        F.lit(False).alias("removed"),
    )


def token_logs(spark: SparkSession, sf: str) -> DataFrame:
    """events -> Transfer, NFT Transfer, Approval, Mint, Burn and an unregistered event."""
    e = table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", cents("value").alias("cents")
    )
    block = F.lit(1) + F.floor(F.col("event_id") / 10).cast("long")
    user = X.uint_word(F.col("user_id"))
    other = X.uint_word((F.col("user_id") * 7 + F.col("event_id")) % 150)
    amount = X.uint_word(F.col("cents"))
    kind = F.col("event_type")

    def topics(event: EventDef, *indexed: Column) -> Column:
        return X.log_topics(event, list(indexed))

    all_topics = (
        F.when(kind == "purchase", topics(TRANSFER, user, other))
        .when(kind == "click", topics(APPROVAL, user, other))
        .when(kind == "signup", topics(MINT, user))
        .when(kind == "view", topics(NFT_TRANSFER, user, other, amount))
        .otherwise(topics(ERROR_SEEN))
    )
    data = F.when(kind == "view", "0x").otherwise(F.concat(F.lit("0x"), amount))

    def log(t: Column, d: Column, index: Column) -> Column:
        return _log(
            X.address(F.lit(1) + F.col("event_id") % 3),
            t,
            d,
            block,
            F.lit(1_700_000_000) + 12 * block,
            word_hash(F.col("event_id") + 1),
            index,
        )

    index = F.col("event_id") % 10
    main = log(all_topics, data, index)
    burn = log(topics(BURN, user), F.concat(F.lit("0x"), amount), index + 10)
    burns = (kind == "purchase") & (F.col("event_id") % 5 == 0)
    return e.select(F.inline(F.when(burns, F.array(main, burn)).otherwise(F.array(main))))


def part_logs(spark: SparkSession, sf: str, catalog: DataFrame) -> DataFrame:
    """lineitem -> logs of an event for each part, Part<key>(address indexed, uintN, (address,bytes4)[]);
    the event hashes come from a catalogue frame."""
    lines = table(spark, sf, "lineitem").withColumn("event_name", F.concat(F.lit("Part"), F.col("l_partkey").cast("string")))
    # A catalogue may have as many events as there are parts; its files say little of its size.
    hashed = lines.join(catalog.select("event_name", "event_hash").hint("shuffle_hash"), "event_name")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    n = (line % 3).cast("int")
    items = F.transform(F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), n), lambda i: F.concat(X.uint_word(order + i), X.left_word(F.lpad(F.lower(F.hex(line + i)), 8, "0"))))
    body = F.concat(X.uint_word(F.col("l_quantity").cast("long")), X.uint_word(F.lit(64)), X.uint_word(n), F.array_join(items, ""))
    topics = F.array(F.col("event_hash"), F.concat(F.lit("0x"), X.uint_word(F.col("l_suppkey"))))
    log = _log(X.address(order), topics, F.concat(F.lit("0x"), body), order, F.lit(0), word_hash(order), line)
    return hashed.select(F.inline(F.array(log)))


def governance_block(order: Column, stage: int) -> Column:
    return F.lit(17_000_000 + stage) + order * 10


def governance_time(block: Column, order: Column) -> Column:
    return F.when(order % 7 != 0, F.lit(1_600_000_000) + block)


_GOVERNOR = "0x" + "9a" * 20


def proposal_logs(spark: SparkSession, sf: str) -> DataFrame:
    """orders -> proposal lifecycle logs."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("cents")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    pid = X.uint_word(key)

    def log(stage: int, event: EventDef, indexed: list[Column], body: list[Column]) -> Column:
        block = governance_block(key, stage)
        return _log(
            F.lit(_GOVERNOR),
            X.log_topics(event, indexed),
            X.log_data(event, body),
            block,
            governance_time(block, key),
            word_hash(key * 16 + stage),
            F.lit(stage),
        )

    votes = [X.uint_word(F.col("cents")), X.uint_word(customer)]
    failed = (status == "F") & (level == "1")
    stages = [
        (F.lit(True), log(0, CREATED, [pid, X.uint_word(customer), X.uint_word(level)], [X.uint_word(key)])),
        (
            (status != "O") | (level != "5"),
            log(1, ACTIVATED, [pid, X.uint_word(key + 7)], [X.uint_word(1000 + customer % 100)]),
        ),
        ((status == "P") | ((status == "F") & (level != "1")), log(2, QUEUED, [pid], votes)),
        (failed, log(2, FAILED, [pid], votes)),
        ((status == "F") & (level != "1"), log(3, EXECUTED, [pid], [])),
        (key % 10 == 0, log(4, CANCELED, [pid], [])),
    ]
    return o.select(F.inline(F.array_compact(F.array(*[F.when(c, s) for c, s in stages]))))


def line_hash() -> Column:
    """A hash of a whole lineitem row, as transaction hash."""
    text = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_extendedprice"), cents("l_tax"), "l_linestatus")
    return F.concat(F.lit("0x"), F.sha2(text, 256))


def vote_logs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem -> VoteForwarded (with tuple arrays, empty ones included) and PayloadSent."""
    li = table(spark, sf, "lineitem").withColumns({"pid": X.uint_word(F.col("l_orderkey")), "tx": line_hash()})
    key, line, pid = F.col("l_orderkey"), F.col("l_linenumber"), F.col("pid")
    pairs = F.transform(
        F.slice(F.sequence(F.lit(1), line), F.lit(1), line - 1),
        lambda i: F.concat(X.uint_word(F.col("l_suppkey") + i), X.uint_word(F.col("l_quantity").cast("long") * i)),
    )

    def log(stage: int, topics: Column, data: Column) -> Column:
        block = governance_block(key, stage)
        return _log(F.lit(_GOVERNOR), topics, data, block, governance_time(block, key), F.col("tx"), line)

    vote = log(
        5,
        X.log_topics(VOTE, [pid, X.uint_word(F.col("l_partkey")), X.bool_word(F.col("l_returnflag") == "A")]),
        X.log_data(VOTE, [pairs]),
    )
    payload = log(
        6,
        X.log_topics(PAYLOAD, [pid, X.uint_word(F.col("l_suppkey")), X.uint_word(line)]),
        X.log_data(
            PAYLOAD,
            [X.uint_word(F.col("l_partkey")), X.uint_word(line), X.uint_word(F.col("l_quantity"))],
        ),
    )
    return li.select(F.inline(F.array(vote, payload)))


def governance_logs(spark: SparkSession, sf: str) -> DataFrame:
    return proposal_logs(spark, sf).unionByName(vote_logs(spark, sf))


def wide_logs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem -> Transfer of cents * 2^192 + l_orderkey, and a signed Delta of the same size."""
    li = table(spark, sf, "lineitem").withColumns({"c": cents("l_extendedprice"), "tx": line_hash()})
    key, c = F.col("l_orderkey"), F.col("c")

    def word(high: Column, middle: str, low: Column) -> Column:
        high, low = (F.lpad(F.lower(F.hex(x)), 16, "0") for x in (high, low))
        return F.concat(high, F.lit(middle * 32), low)

    value = word(c, "0", key)
    # Two's complement: the borrow from the low piece makes the upper pieces complements.
    negative = F.when(key == 0, word(-c, "0", key)).otherwise(word(-c - 1, "f", -key))
    signed = F.when(F.col("l_returnflag") == "R", negative).otherwise(value)
    block = F.lit(1) + key
    supplier, part = X.uint_word(F.col("l_suppkey")), X.uint_word(F.col("l_partkey"))

    def log(topics: Column, data: Column) -> Column:
        return _log(
            X.address(F.lit(99)), topics, F.concat(F.lit("0x"), data), block, F.lit(1_700_000_000) + block, F.col("tx"), F.col("l_linenumber")
        )

    return li.select(
        F.inline(F.array(log(X.log_topics(TRANSFER, [supplier, part]), value), log(X.log_topics(DELTA, [supplier]), signed)))
    )


def reading_logs(spark: SparkSession, sf: str) -> DataFrame:
    """orders -> an event of static types, negative integers included."""
    o = table(spark, sf, "orders").withColumn("c", cents("o_totalprice"))
    key = F.col("o_orderkey")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    block = F.lit(1) + key
    return o.select(
        F.inline(
            F.array(
                _log(
                    X.address(F.col("o_custkey")),
                    X.log_topics(
                        READING,
                        [X.int_word(sign * F.col("o_custkey")), X.left_word(F.lpad(F.lower(F.hex(key)), 8, "0"))],
                    ),
                    X.log_data(
                        READING,
                        [
                            X.int_word(sign * F.col("c")),
                            X.uint_word(F.col("c")),
                            X.bool_word(F.col("o_orderstatus") == "O"),
                            X.uint_word(F.substring("o_orderpriority", 1, 1)),
                            X.uint_word(key),
                        ],
                    ),
                    block,
                    F.lit(1_700_000_000) + block,
                    word_hash(key),
                    F.lit(0),
                )
            )
        )
    )


def document_logs(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> an event with string, bytes and array parameters, whole texts."""
    d = table(spark, sf, "documents")
    key, n = F.col("doc_id"), F.col("n_chars")
    count = (key % 4).cast("int")
    steps = F.slice(F.sequence(F.lit(0), count), F.lit(1), count)
    sizes = F.transform(steps, lambda i: X.uint_word(n + i))
    pairs = F.transform(steps, lambda i: F.concat(X.uint_word(key + i), X.uint_word(n * i)))
    block = F.lit(1) + key
    return d.select(
        F.inline(
            F.array(
                _log(
                    X.address(F.lit(7)),
                    X.log_topics(POSTED, [X.uint_word(key), X.uint_word(F.length("lang"))]),
                    X.log_data(POSTED, [F.col("text"), F.encode("source", "UTF-8"), sizes, pairs]),
                    block,
                    F.lit(1_700_000_000) + block,
                    word_hash(key),
                    F.lit(0),
                )
            )
        )
    )
