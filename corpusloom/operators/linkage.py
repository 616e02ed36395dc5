"""Complete-linkage grouping over a table of similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import saved


def complete_linkage(nodes: DataFrame, pairs: DataFrame, node: str) -> DataFrame:
    """(node, cluster): groups in which every two nodes are a pair; cluster is the group's smallest node.

    ``pairs`` (a, b, cosine) are all pairs of nodes that are similar enough, once each. In a round every two groups that
    are each other's nearest become one; groups stay neighbours only where all their nodes are pairs, at the least
    cosine among them. As such a union never comes nearer to a third group, this gives the groups that joining one
    nearest pair at a time gives. Ties go to the smaller nodes. Nodes without a pair are groups of their own. The nearest of
    all pairs is joined in every round, so rounds end; there are few unless similarities fall along a chain.
    """
    spark = nodes.sparkSession
    now = saved(pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("s")), spark)
    held = saved(nodes.select(F.col(node)).distinct().withColumn("cluster", F.col(node)), spark)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        best = both.groupBy("a").agg(F.min_by("b", F.struct(-F.col("s"), F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        other = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        joined = saved(best.intersect(other).filter("a < b"), spark)  # b goes into a
        if not joined.limit(1).count():
            return held
        into = joined.select(F.col("b").alias("_old"), F.col("a").alias("_new"))
        held = held.join(into, F.col("cluster") == F.col("_old"), "left").select(node, F.coalesce("_new", "cluster").alias("cluster"))
        held = saved(held, spark)
        for side in ("a", "b"):
            now = now.join(into, F.col(side) == F.col("_old"), "left").withColumn(side, F.coalesce("_new", side)).drop("_old", "_new")
        now = now.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.min("s").alias("s"), F.count("*").alias("n"))
        for side in ("a", "b"):
            now = now.join(joined.select(F.col("a").alias(side), F.lit(2).alias(f"_{side}")), side, "left")
        full = F.coalesce("_a", F.lit(1)) * F.coalesce("_b", F.lit(1))
        now = saved(now.filter(F.col("n") == full).select("a", "b", "s"), spark)
