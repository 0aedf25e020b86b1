"""Connected components over links held as rows, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many links costs one aggregated row where its
minimum is taken and a split, skewed join partition where the minimum meets its links. The number of steps grows
with the logarithm of the largest component. Each step is a table in the shared folder, so lost executors cost a
step, not the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import write_shared


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Links of each node u to its least neighbour m (or itself): from its larger neighbours, or from the smaller ones and itself."""
    least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    met = both.join(least, "u")
    if larger:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    small = met.where((F.col("v") < F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node with a link to another one.

    Nulls and links of a node to itself are dropped; repeated links count once; no links give no rows.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = write_shared(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        both = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        # after a large star every link points from a larger to a smaller node, which is all the small star needs
        pairs = write_shared(_star(both, False), "links")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
