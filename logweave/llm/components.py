"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Scratch


#: A hub has at least so many links, which one task still takes, and a share of all of one in HUBS.
LEAST_HUB, HUBS = 1_000_000, 1024


def _star(links: DataFrame, small: bool, hub: int | None) -> DataFrame:
    """Each node links its larger neighbours (or, if `small`, its smaller ones and itself) to the
    smallest node among its neighbours and itself. Links of hubs, nodes with `hub` links or more, get
    that node from a broadcast where they lie, and do not meet in one task; without `hub` there are too
    few links for one."""
    if small:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if hub is None:
        return _linked(near.join(least, "u"), least, small)
    # At most 2 * HUBS rows, as all links together are counted twice at most.
    tagged = near.join(F.broadcast(least.where(F.col("n") >= hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    rest = tagged.where(F.col("hub_m").isNull()).join(least.where(F.col("n") < hub), "u").select("u", "v", "m")
    moved = rest.unionByName(tagged.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m")))
    return _linked(moved, least, small)


def _linked(moved: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    """The links of a star, from neighbours v of u and the smallest node m of u's."""
    if small:
        made = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        made = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return made.where(F.col("a") != F.col("b")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node that links to another has one link, and none links to it."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    met = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return met.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def leads(links: DataFrame) -> DataFrame:
    """node, root: for each node of a link (a, b) but the smallest of its component that smallest one.
    Rounds go on until the links are stars; each ends in a written table, and that of the round before
    is removed. Links to itself or to null are none."""
    at = Scratch(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(at.frame):
        n = at.frame.count()
        hub = max(LEAST_HUB, n // HUBS) if 2 * n >= LEAST_HUB else None
        before, at = at, Scratch(_star(_star(at.frame, small=False, hub=hub), small=True, hub=hub), "links")
        before.remove()
    return at.frame.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """node, root: as `leads`, and the smallest nodes themselves."""
    found = leads(links)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
