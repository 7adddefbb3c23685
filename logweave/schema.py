"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LOG = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("block_hash", T.StringType()),
        T.StructField("block_timestamp", T.LongType()),
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("transaction_index", T.IntegerType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("removed", T.BooleanType()),
    ]
)

# Log records as a JSON-RPC node prints them: every number is a 0x quantity.
RAW_LOG_JSON = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("blockNumber", T.StringType()),
        T.StructField("blockHash", T.StringType()),
        T.StructField("blockTimestamp", T.StringType()),
        T.StructField("transactionHash", T.StringType()),
        T.StructField("transactionIndex", T.StringType()),
        T.StructField("logIndex", T.StringType()),
        T.StructField("removed", T.BooleanType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("block_number", T.LongType()),
        T.StructField("block_hash", T.StringType()),
        T.StructField("block_timestamp", T.LongType()),
    ]
)

PARAM = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("indexed", T.BooleanType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

EVENT_CATALOG = T.StructType(
    [
        T.StructField("chain_id", T.LongType()),
        T.StructField("event_hash", T.StringType()),
        T.StructField("event_signature", T.StringType()),
        T.StructField("canonical_signature", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("n_topics", T.IntegerType()),
        T.StructField("params", T.ArrayType(PARAM)),
        T.StructField("table_name", T.StringType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("chain_id", T.LongType()),
        T.StructField("event_hash", T.StringType()),
        T.StructField("event_signature", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("first_block", T.LongType()),
        T.StructField("last_block", T.LongType()),
    ]
)

# Files of chunks end with a mark: a record that has the range of the chunk and nothing else.
CHUNK_JSON = T.StructType(
    RAW_LOG_JSON.fields + [T.StructField("chunkStart", T.StringType()), T.StructField("chunkEnd", T.StringType())]
)

# The four columns every event table starts with, in order.
FIXED_COLUMNS = ("block_number", "transaction_hash", "log_index", "contract_address")
EVENT_KEY = ("block_number", "transaction_hash", "log_index")

# Suffix of the optional order-key columns kept beside 256-bit integers.
KEY_SUFFIX = "__w"

