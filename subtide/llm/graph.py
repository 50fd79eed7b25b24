"""Connected components of a link table, for groups of any size.

Alternating large-star and small-star steps: each replaces links by links to the
smallest neighbour, until nothing changes.  A step aggregates a minimum for each
node (combined before the shuffle) and joins it back.  Both sides of that join have
exchanges of their own, so that adaptive execution can split the links of a hub over
tasks; links reach neither the driver nor one task.  Each round is written to the
shared folder, which ends its lineage, and the round before it is removed.

Nodes are of any type with an order (numbers, or structs that sort as wanted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    low = C.summed(both, ["a"], F.min("b").alias("b")).select("a", F.least("b", "a").alias("m"))
    out = both.where("b > a") if large else both
    out = out.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it reaches."""
    spark = links.sparkSession
    links, path = C.scratch_at(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = sign(links)
    while before[0]:
        links, now_at = C.scratch_at(_star(_star(links, True), False), "star")
        C.remove(spark, path)
        path = now_at
        if (now := sign(links)) == before:
            break
        before = now
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
