"""Connected components by alternating large and small stars; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Minima are aggregated and joined back, so no neighbourhood is gathered anywhere. Each round is written; rounds grow
    with the logarithm of the longest path, and links that are stars already need none. Empty links give an empty table;
    loops and repeated links do no harm.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while True:
        # Stars around their least nodes: each u has one v, and no v is a u.
        ends = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
        odd = ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v").isNull()).alias("ups")).where("lo < hi or lo is not null and ups > 0")
        if not odd.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u > v").distinct(), "links")


def roots(parents: DataFrame) -> DataFrame:
    """A written forest (node, parent), each node once and above its parent -> the same nodes with their root.

    Parents are replaced by theirs, so rounds grow with the logarithm of the depth; each is one join, and a parent's many
    children can be split.
    """
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        if not parents.join(above, "parent", "left_semi").limit(1).count():
            return parents
        parents = written(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "parents")
