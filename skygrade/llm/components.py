"""Connected components by alternating large-star and small-star steps on tables of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbourhood."""
    ways = both_ways(links)
    least = ways.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pulled = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pulled.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each linked node that is not the smallest of its component, and that smallest one.

    Links are (a, b) with a <> b. Neighbourhoods are only aggregated and joined,
    never collected. Every step is written out; the loop ends when a pair of
    steps changes nothing.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    current = scratch.write(links.where("a <> b").select("a", "b").distinct(), "links")
    before = state(current)
    while True:
        following = scratch.write(small_star(large_star(current)).where("a <> b").distinct(), "links")
        scratch.drop(current)
        current, after = following, state(following)
        if tuple(after) == tuple(before):
            return current
        before = after
