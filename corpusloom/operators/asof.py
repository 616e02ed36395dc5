"""As-of joins against a table, without a comparison of all rows with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import saved


def next_at_or_above(rows: DataFrame, table: DataFrame, equal: list[str], value: str, place: str, take: list[str], name: str = "fit") -> DataFrame:
    """``rows`` with ``name``, a struct of ``take``: of the ``table`` rows equal in ``equal`` the one with the least ``place`` >= ``value``.

    Both tables are one, sorted by range over the keys and the values, downwards; the last table row before a row is its
    own. Only the last table row of each part and key is carried to the parts after it. Null where no row fits, or where
    ``value`` or a key is null; of table rows with one place the least in ``take`` counts, and null places are none.
    """
    spark = rows.sparkSession
    key = F.struct(*equal)
    fit = F.struct(*[F.col(c) for c in take])
    known = table.filter(F.col(place).isNotNull()).select(key.alias("_k"), F.col(place).cast("double").alias("_v"), F.lit(0).alias("_side"), fit.alias("_fit"), F.lit(None).cast(rows.schema).alias("_row"))
    asked = rows.select(key.alias("_k"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_fit"].dataType).alias("_fit"), F.struct(*rows.columns).alias("_row"))
    order: list[Column] = [F.desc_nulls_last("_v"), F.asc("_side"), F.desc("_fit")]
    parts = known.unionByName(asked).repartitionByRange(F.col("_k"), *order).withColumn("_part", F.spark_partition_id())
    parts = saved(parts, spark)
    last = parts.filter("_side = 0").groupBy("_k", "_part").agg(F.min_by("_fit", F.struct("_v", "_fit")).alias("_last"))
    # a key that spans parts: the last table row of the parts before
    spans = parts.groupBy("_k", "_part").agg(F.lit(1).alias("_one")).join(last, ["_k", "_part"], "left")
    carried = spans.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_k", "_part", "_before")
    within = F.last("_fit", ignorenulls=True).over(Window.partitionBy("_part", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("_own", within).filter("_side = 1").join(carried, ["_k", "_part"], "left")
    whole = F.col("_v").isNotNull()
    for c in equal:
        whole = whole & F.col(f"_k.{c}").isNotNull()
    return placed.select("_row.*", F.when(whole, F.coalesce("_own", "_before")).alias(name))
