"""Names that contain a part, by an index of grams in place of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import saved

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """The different runs of ``size`` characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def first_containing(parts: DataFrame, names: DataFrame, part: str, name: str, size: int = GRAM) -> DataFrame:
    """(``part``, ``name``): for each different part the first name, in order, that contains it; none where no name does.

    A part is looked up by the gram of it that the fewest names have, and the names under that gram are verified. A part
    shorter than ``size`` is one gram of its own length. An empty part is in every name. Nulls are in none.
    """
    spark = parts.sparkSession
    wanted = saved(parts.select(F.col(part).alias("_p")).filter("_p IS NOT NULL").distinct().withColumn("_k", F.least(F.lit(size), F.length("_p"))), spark)
    held = saved(names.select(F.col(name).alias("_n")).filter("_n IS NOT NULL").distinct(), spark)
    asked = wanted.filter("_k > 0").select("_p", F.explode(grams(F.col("_p"), F.col("_k"))).alias("_g"))
    sizes = F.array(*[F.lit(k) for k in range(1, size + 1)])
    index = held.select("_n", F.explode(F.flatten(F.transform(sizes, lambda k: grams(F.col("_n"), k)))).alias("_g"))
    index = saved(index.join(asked.select("_g").distinct(), "_g", "left_semi"), spark)
    counted = asked.join(index.groupBy("_g").agg(F.count("*").alias("_c")), "_g", "left")
    rarest = counted.groupBy("_p").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("_c"), "_g")).alias("r")).select("_p", F.col("r._g").alias("_g"))
    found = rarest.join(index, "_g").filter(F.contains("_n", F.col("_p"))).groupBy("_p").agg(F.min("_n").alias("_n"))
    # one row, the first of all names
    every = wanted.filter("_k = 0").crossJoin(F.broadcast(held.agg(F.min("_n").alias("_n")).filter("_n IS NOT NULL"))).select("_p", "_n")
    return found.unionByName(every).select(F.col("_p").alias(part), F.col("_n").alias(name))
