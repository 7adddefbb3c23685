"""Pages that begin deep in a long result, without a task that takes all rows before them.

The rows are never sorted as a whole. Keys from a sample cut the order into intervals; one pass counts the
rows of each; and the page lies in the interval or two that its place falls into. Only these rows go on: by
a range of the sort key, which reaches the files, so a table that lies in that order is read in part. If they
are still many, they are cut again. The last step sorts what is left, a bounded number of rows.

The order is that of the sort key, then of the event key, so that rows with equal sort keys keep their places
from page to page, and a sort key that most rows share is cut as any other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_KEY

#: Rows that one task may skip and sort.
ENOUGH = 100_000
#: Intervals of a cut, and sampled keys for each.
INTERVALS, SAMPLED = 128, 16


@dataclass(frozen=True)
class Order:
    """Sort key (none: the event key alone) and direction. Ties go by the event key, rising."""

    key: Column | None = None
    descending: bool = False

    def columns(self) -> list[Column]:
        """What to sort by."""
        first = [] if self.key is None else [self.key.desc() if self.descending else self.key.asc()]
        return [*first, *[F.col(c).asc() for c in EVENT_KEY]]

    def keyed(self, rows: DataFrame) -> DataFrame:
        """The rows with their place's key as `__key`, rising with the sort key."""
        return rows.withColumn("__key", F.struct((F.col(EVENT_KEY[0]) if self.key is None else self.key).alias("k"), *EVENT_KEY))

    def starts(self, pivot: Column) -> Column:
        """Whether a keyed row stands at the pivot, a key, or after it."""
        ties = F.struct(*EVENT_KEY) >= F.struct(*[pivot[c].alias(c) for c in EVENT_KEY])
        k, at = F.col("__key.k"), pivot["k"]
        return (k < at if self.descending else k > at) | ((k == at) & ties)

    def between(self, low: tuple | None, high: tuple | None) -> Column:
        """Whether a keyed row stands at `low` or after it, and before `high`. The sort key's own range
        says the same less exactly, in a form that files know."""
        k, inside = F.col("__key.k"), F.lit(True)
        if low is not None:
            inside = inside & (k <= low[0] if self.descending else k >= low[0]) & self.starts(_key(low))
        if high is not None:
            inside = inside & (k >= high[0] if self.descending else k <= high[0]) & ~self.starts(_key(high))
        return inside

    def sorted(self, keys: list[tuple]) -> list[tuple]:
        ties = sorted(set(keys), key=lambda key: key[1:])
        return sorted(ties, key=lambda key: key[0], reverse=self.descending)


def _key(values: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(c) for c, v in zip(("k", *EVENT_KEY), values)])


def _pivots(keyed: DataFrame, order: Order, n: int) -> list[tuple]:
    share = min(1.0, INTERVALS * SAMPLED / n)
    keys = order.sorted([(r["__key"]["k"], *(r["__key"][c] for c in EVENT_KEY)) for r in keyed.select("__key").sample(share, seed=11).collect()])
    step = max(1, len(keys) // INTERVALS)
    return keys[step::step]


def _counted(keyed: DataFrame, order: Order, pivots: Sequence[tuple]) -> list[int]:
    """The number of rows before the first pivot, between each and the next, and from the last on."""
    if not pivots:
        return [keyed.count()]
    passed = F.size(F.filter(F.array(*map(_key, pivots)), order.starts))
    found = {r.i: r.n for r in keyed.groupBy(passed.alias("i")).agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(len(pivots) + 1)]


def page(rows: DataFrame, order: Order, first: int, skip: int, enough: int = ENOUGH) -> DataFrame:
    """Rows skip .. skip + first of the order. Pages that begin early are taken as they are."""
    columns = rows.columns
    if skip + first <= enough:
        return rows.orderBy(*order.columns()).offset(skip).limit(first)
    keyed = order.keyed(rows)
    n = keyed.count()
    while n > enough and skip < n:
        pivots = _pivots(keyed, order, n)
        counts = _counted(keyed, order, pivots)
        low, before = 0, 0
        while low < len(counts) - 1 and before + counts[low] <= skip:
            before += counts[low]
            low += 1
        high, held = low, counts[low]
        while high < len(counts) - 1 and before + held < skip + first:
            high += 1
            held += counts[high]
        if held >= n:
            break  # nothing to cut off: the page takes up most of the rows
        keyed = keyed.where(order.between(pivots[low - 1] if low else None, pivots[high] if high < len(pivots) else None))
        skip, n = skip - before, held
    return keyed.select(*columns).orderBy(*order.columns()).offset(skip).limit(first)
