"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregation to the least neighbour and an equi-join back; links are kept in the shared checkpoint folder
after each round, those of the round before are deleted, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import durable, release


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select(F.col("a"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links here run from a larger a to a smaller b."""
    down = links.join(_least(links), "a")
    other = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.union(down.select("a", F.col("m").alias("b"))).distinct()


def _sum(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).collect()[0]
    return r["n"], r["h"]


def least_member(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): for each linked node but the least of a component, that least node. links: (a, b) of an ordered type, in any
    direction, loops and repeats allowed. Null ends link nothing."""
    now = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sum(now)
    for _ in range(most_rounds):
        if not seen[0]:
            return now
        before, now = now, durable(_small_star(_large_star(now)))
        release(before)
        if (got := _sum(now)) == seen:
            return now
        seen = got
    raise RuntimeError("components didn't settle")
