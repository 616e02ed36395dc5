"""Ranks within groups of any size, without a task that orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import saved


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, the place of each row in its group from 0, and ``_size``, the group's number of rows.

    The rows are sorted by range over group and order, and a row's place is its place in its part plus the rows of the
    group in the parts before; only one row a group and part is counted in order. Null groups are a group; rows equal
    in ``order`` are ranked in some order.
    """
    keys = [F.col(group), *order]
    parts = saved(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), rows.sparkSession)
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_size"))
    within = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    placed = parts.withColumn("_within", within).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(name, F.col("_within") + F.col("_before")).select(*rows.columns, name, "_size")


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column a share): exact quantiles with linear interpolation, from places in the sorted values."""
    placed = ranked(rows.select(group, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL"), group, [F.col("_x")], "_at")
    at = lambda pos: F.max(F.when(F.col("_at") == pos, F.col("_x")))
    n = F.col("_size") - 1
    out = []
    for name, share in shares.items():
        low, high = at(F.floor(n * share)), at(F.ceil(n * share))
        part = F.max(n * share - F.floor(n * share))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(group).agg(*out)
