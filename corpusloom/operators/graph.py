"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.ranks import ranked
from corpusloom.session import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than a node moves, with the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame):
    """Count and checksum of an edge set: two equal ones in a row end the loop."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return edges.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has two columns of one ordered type; self-loops, repeats and either direction are fine, and rows with
    a null end are no edges. Each round is written to the shared folder, so a lost executor repeats one round only.
    The joins are plain equi-joins on both sides, so that Spark splits a node with very many neighbours. No edges
    give an empty result.
    """
    u, v = edges.columns
    now = saved(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v").distinct(), spark)
    mark = _print(now)
    for _ in range(most_rounds):
        if not mark["n"]:
            break
        now = saved(_small_star(_large_star(now)), spark)
        mark, before = _print(now), mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    root = now.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("node"), "component")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)


def numbered(found: DataFrame, name: str = "grp") -> DataFrame:
    """``found`` (node, component) with ``name``: G001, G002, … by the order of the components' smallest nodes."""
    heads = found.select("component").distinct().withColumn("_one", F.lit(1))
    heads = ranked(heads, "_one", [F.col("component")], "_at")
    number = (F.col("_at") + 1).cast("string")
    return found.join(heads.select("component", F.concat(F.lit("G"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0")).alias(name)), "component").select("node", "component", name)
