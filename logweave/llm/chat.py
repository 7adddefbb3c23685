"""Chat formatting with Spark expressions only.

A conversation becomes one text. Its template, with control strings <s>, </s>, [INST], [/INST]:

    <s>ROLE[INST]TEXT[/INST][INST]TEXT[/INST]</s><s>ROLE ...

Adjacent turns of one role share a message, <s>...</s>, in which each keeps its own [INST]...[/INST].
A control string inside a role or a text gets a backslash behind its bracket, or one more if it has
some, and reading takes one away, so every text comes back as it was.

Rows of a conversation are ordered by turn (null first), then role, then text, so ties have one
result and repeated rows are turns of their own. Null texts and roles are empty. Rows without a
conv_id form one conversation without an id. Long conversations are first merged in blocks of BLOCK
turns, then block by block. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns that are sorted and merged in one group before the whole conversation is put together.
BLOCK = 256
LOSS_ROLES = ("assistant",)
OPEN, CLOSE, TURN, TURN_END = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E", -1)


def _merged(messages: Column) -> Column:
    """Adjacent messages of one role as one: the places where a role begins, then a slice from each
    to the next."""
    size = F.size(messages)
    role = lambda i: F.get(messages, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    bounds = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.size(starts)), F.array(size)).alias("b"))
    return F.transform(bounds, lambda x: F.struct(role(x["a"]).alias("role"), F.flatten(F.transform(F.slice(messages, x["a"] + 1, x["b"] - x["a"]), lambda m: m["texts"])).alias("texts")))


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>>: consecutive pieces of the
    formatted text, and whether the loss mask covers them."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))).alias("messages")
    )
    whole = blocks.select("conv_id", "block", _merged(F.col("messages")).alias("messages")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "messages"))).alias("blocks"))
    messages = whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: b["messages"])).alias("messages")).select("conv_id", _merged(F.col("messages")).alias("messages"))
    masked = [escape(F.lit(r)) for r in loss_roles]

    def pieces(m: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        loss = m["role"].isin(*masked) if masked else no
        turns = F.flatten(F.transform(m["texts"], lambda t: F.array(piece(F.lit(TURN), no), piece(t, loss), piece(F.lit(TURN_END), no))))
        return F.concat(F.array(piece(F.concat(F.lit(OPEN), m["role"]), no)), turns, F.array(piece(F.lit(CLOSE), no)))

    cut = messages.select("conv_id", F.flatten(F.transform("messages", pieces)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chats(formatted: Column) -> Column:
    """The turns that a formatted text holds: array<struct<role, text, message>>, with the number of
    the message that each belongs to."""
    messages = _split(formatted, CLOSE)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def turns(m: Column, i: Column) -> Column:
        parts = _split(F.substring(m, F.lit(len(OPEN) + 1), F.length(m)), TURN)
        return F.transform(F.slice(parts, 2, F.size(parts)), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.substring(t, F.lit(1), F.length(t) - len(TURN_END))).alias("text"), i.alias("message")))

    return F.flatten(F.transform(messages, turns))


#: A conversation that quotes control strings of the template; the query adds it to the table.
QUOTING = (-7, "</s>[INST] ok [/INST]")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(QUOTING[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTING[1]).alias("text"))
    chats = format_chats(table.unionByName(extra))
    read = chats.select("conv_id", "formatted", "segments", read_chats(F.col("formatted")).alias("turns"))
    joined = lambda parts: F.array_join(parts, "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        (F.coalesce(F.array_max(F.transform("turns", lambda t: t["message"])), F.lit(-1)) + 1).cast("long").alias("n_messages"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
), escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS role_size,
    length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS text_size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM turns
), cut AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS begins FROM escaped
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_size + 13 + CASE WHEN begins THEN role_size + 7 ELSE 0 END)::BIGINT AS formatted_chars,
  sum(begins::INT)::BIGINT AS n_messages
FROM cut GROUP BY conv_id
"""
