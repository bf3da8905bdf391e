"""Connected components of a table of links, by alternating large and small stars; only minima are gathered per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut

LINKS = 20_000


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """Hang the neighbours of every node (the larger ones, or the smaller ones and itself) on the least of them."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.coalesce(parts)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").coalesce(parts).distinct()


def _marked(links: DataFrame) -> tuple[DataFrame, int, tuple]:
    """links frozen, how many there are, and a mark that tells two tables of links apart, all from one job."""
    seen = Observation()
    done = cut(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return done, seen.get["n"], (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) that is not its component's least node; root is that least node.

    Rounds go on until a round changes nothing. Each round is frozen in shared storage, in partitions of about LINKS links: a round is many
    small steps, and with a partition per core of the cluster each would cost more than the links it holds.
    """
    links, n, seen = _marked(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while n:
        parts = -(-n // LINKS)
        links, n, mark = _marked(_star(_star(links.coalesce(parts), True, parts), False, parts).coalesce(parts))
        if mark == seen:
            break
        seen = mark
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
