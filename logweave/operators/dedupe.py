"""Block dimension, and appends that keep keys unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_KEY


class DuplicateKeyError(RuntimeError):
    """on_conflict="error" met a key twice."""


def blocks_from_logs(logs: DataFrame) -> DataFrame:
    """One row per block: hash and timestamp (0 if missing) of its first log.

    Grouping by all values first uses a hash aggregate with an integer buffer, so each
    task sends one row a block, whatever the number of logs in it."""
    values = (
        logs.where(F.col("block_number").isNotNull())
        .groupBy("block_number", "block_hash", F.coalesce("block_timestamp", F.lit(0)).cast("long").alias("block_timestamp"))
        .agg(F.min("log_index").alias("first_log"))
    )
    order = F.struct("first_log", "block_timestamp")
    return values.groupBy("block_number").agg(
        F.min_by("block_hash", order).alias("block_hash"),
        F.min_by("block_timestamp", order).alias("block_timestamp"),
    )


def first_per_key(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by `order_by`; combines within each task first."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__row")
    )
    return picked.select(*keys, "__row.*").select(*rows.columns)


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def new_rows(
    target: DataFrame | None,
    new: DataFrame,
    keys: Sequence[str] = EVENT_KEY,
    order_by: Sequence[str] | None = None,
    on_conflict: str = "ignore",
) -> DataFrame:
    """The rows of `new` that an insert into `target` adds.

    ignore: the first row of each key stays, keys already stored are skipped.
    error: any repeated key raises, nothing is added. Restrict `target` to the block range
    of the batch (`in_block_span`) so that the check does not read the whole history."""
    if on_conflict == "error":
        clash = duplicate_keys(new, keys).limit(1).collect()
        if not clash and target is not None:
            clash = new.join(target.select(*keys), list(keys), "left_semi").limit(1).collect()
        if clash:
            raise DuplicateKeyError(f"key {tuple(clash[0][k] for k in keys)} is stored twice")
        return new
    if on_conflict != "ignore":
        raise ValueError("on_conflict must be 'ignore' or 'error'")
    once = first_per_key(new, keys, order_by) if order_by else new.dropDuplicates(list(keys))
    return once if target is None else once.join(target.select(*keys), list(keys), "left_anti").select(*new.columns)


def append_new(
    target: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = EVENT_KEY,
    order_by: Sequence[str] | None = None,
    on_conflict: str = "ignore",
) -> DataFrame:
    """`target` with the new rows added."""
    return target.unionByName(new_rows(target, new, keys, order_by, on_conflict))


def block_span(rows: DataFrame) -> tuple[int, int] | None:
    """Lowest and highest block of a batch; None if it is empty."""
    lo, hi = rows.agg(F.min("block_number"), F.max("block_number")).first()
    return None if lo is None else (lo, hi)


def in_block_span(target: DataFrame, span: tuple[int, int], bucket_blocks: int) -> DataFrame:
    """Rows of a stored table within a block span; prunes its bucket partitions."""
    lo, hi = span
    out = target.where(F.col("block_number").between(lo, hi))
    if "block_bucket" in target.columns:
        out = out.where(F.col("block_bucket").between(lo // bucket_blocks, hi // bucket_blocks))
    return out
