"""Numbers without gaps for rows that no single task could number, with Spark expressions only.

Equal rows are counted first, so however often one repeats it is a row or a few here. What is left is
numbered inside buckets of bounded size, and a bucket begins where those before it end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Copies of a row that stand as one row while rows are numbered: 2^COPY_BITS at most.
COPY_BITS = 12
COPIES = 1 << COPY_BITS


def counted(rows: DataFrame) -> DataFrame:
    """The distinct rows, each in parts of at most COPIES copies: `part` from 0, `copies` in it."""
    whole = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("copies") - 1, COPY_BITS))))
    return parts.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES).cast("long"))


def begins(totals: DataFrame, group: Sequence[str], bucket: str, descending: bool = False) -> DataFrame:
    """Of a table of buckets with their `copies`: how many stand before each in its group (`begin`)."""
    order = F.desc(bucket) if descending else F.asc(bucket)
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, bucket, F.coalesce(F.sum("copies").over(before), F.lit(0)).cast("long").alias("begin"))


def numbers_within(rows: DataFrame, bucket: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """`begin` plus the copies of the rows before this one in its bucket, as `first`."""
    before = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.col("begin") + F.coalesce(F.sum("copies").over(before), F.lit(0)).cast("long"))


def each_copy(rows: DataFrame) -> Column:
    """The number of each copy, to be selected: one row becomes `copies` rows."""
    return F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
