"""Aggregates over event tables: counts, exact 256-bit sums, supply, balances, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bigint as B


def event_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("event_count"))


def top_counterparties(table: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a column; ties go by value."""
    counts = table.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("transfers"))
    return counts.orderBy(F.col("transfers").desc(), F.col(f"`{column}`")).limit(k)


def sum_by(table: DataFrame, value: str, *keys: str, signed: bool = False) -> DataFrame:
    """Exact sum of a decimal-text column per key (or in total), as decimal text."""
    total = (B.sum_signed if signed else B.sum_u256)(F.col(f"`{value}`")).alias("total")
    return table.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(total) if keys else table.agg(total)


def total_supply(mints: DataFrame, burns: DataFrame, amount: str = "amount") -> DataFrame:
    """Minted, burned and remaining amount, in one pass over each table."""
    rows = mints.select(F.col(f"`{amount}`").alias("v"), F.lit(1).alias("sign")).unionByName(
        burns.select(F.col(f"`{amount}`").alias("v"), F.lit(-1).alias("sign"))
    )
    minted, burned = (F.when(F.col("sign") == s, F.col("v")).otherwise("0") for s in (1, -1))
    return rows.agg(
        F.coalesce(B.sum_u256(minted), F.lit("0")).alias("minted"),
        F.coalesce(B.sum_u256(burned), F.lit("0")).alias("burned"),
        F.coalesce(B.sum_weighted(F.col("v"), F.col("sign")), F.lit("0")).alias("supply"),
    )


def balance_of(transfers: DataFrame, account: str, sender: str = "from", receiver: str = "to", value: str = "value") -> DataFrame:
    """Incoming, outgoing and net amount of one account."""
    account = account.lower()
    to, frm = F.lower(F.col(f"`{receiver}`")) == account, F.lower(F.col(f"`{sender}`")) == account
    v = F.col(f"`{value}`")
    incoming, outgoing = F.when(to, v).otherwise("0"), F.when(frm, v).otherwise("0")
    sums = transfers.where(to | frm).agg(
        F.coalesce(B.sum_u256(incoming), F.lit("0")).alias("incoming"),
        F.coalesce(B.sum_u256(outgoing), F.lit("0")).alias("outgoing"),
    )
    return sums.select(F.lit(account).alias("account"), "incoming", "outgoing", B.difference(F.col("incoming"), F.col("outgoing")).alias("balance"))


def balances(
    transfers: DataFrame,
    at_block: int | None = None,
    by: tuple[str, ...] = (),
    sender: str = "from",
    receiver: str = "to",
    value: str = "value",
) -> DataFrame:
    """Net amount of every account, optionally as of a block and per further columns.

    Each transfer counts twice in one scan; limb sums combine within a task, so an account
    that takes part in most transfers costs one row a task in the shuffle."""
    if at_block is not None:
        transfers = transfers.where(F.col("block_number") <= at_block)
    side = F.inline(
        F.array(
            F.struct(F.col(f"`{receiver}`").alias("account"), F.lit(1).alias("sign")),
            F.struct(F.col(f"`{sender}`").alias("account"), F.lit(-1).alias("sign")),
        )
    )
    rows = transfers.select(*by, F.col(f"`{value}`").alias("v"), side)
    return rows.groupBy(*by, "account").agg(B.sum_weighted(F.col("v"), F.col("sign")).alias("balance"))


def reconcile(computed: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """Rebuilt against given values: both sides, their difference and whether they match.

    A key missing on one side counts as 0 there but never as a match."""
    both = computed.select(key, F.col(value).alias("computed")).join(
        truth.select(key, F.col(value).alias("truth")), key, "full_outer"
    )
    zero: Column = F.lit("0")
    return both.select(
        key,
        "computed",
        "truth",
        F.coalesce(F.col("computed") == F.col("truth"), F.lit(False)).alias("matches"),
        B.difference(F.coalesce("computed", zero), F.coalesce("truth", zero)).alias("difference"),
    )
