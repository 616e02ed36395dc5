"""Vector operators by label: centroids, cohesion, outliers, medoids, near labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.keys import order_key
from corpusloom.functions.vectors import dot, norm, unit, vector_sum
from corpusloom.operators.partners import best_matches, near_pairs
from corpusloom.operators.ranks import quantiles, ranked
from corpusloom.session import saved


def units(vectors: DataFrame, size: int, label: str = "label", vec: str = "embedding") -> DataFrame:
    return vectors.filter(F.size(vec) == size).withColumn("e", unit(F.col(vec)))


def label_sums(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """(label, n, total): the sum of the unit vectors of each label, combined on the map side."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), vector_sum(F.col("e"), size).alias("total"))


def cohesion(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """Mean cosine between different vectors of a label, from the length of their sum: linear, no pairs."""
    sums = label_sums(rows, size, label)
    return sums.select(label, "n", F.when(F.col("n") > 1, (dot(F.col("total"), F.col("total")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("intra"))


def leave_one_out(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """``loo``: cosine of each vector with the centroid of the others of its label; null if there is none."""
    joined = rows.join(label_sums(rows, size, label), label)
    rest = F.zip_with("total", "e", lambda t, x: t - x)
    return joined.withColumn("loo", F.when(F.col("n") > 1, dot(F.col("e"), rest) / F.greatest(norm(rest), F.lit(1e-9))))


def outliers(rows: DataFrame, size: int, label: str = "label", spreads: float = 3.0, least_mad: float = 0.02, least_gap: float = 0.1, floor: float = 0.3) -> DataFrame:
    """Leave-one-out cosines far below the label's median, in scaled median deviations, or below ``floor``."""
    # once, for the median, the deviation and the result
    loo = saved(leave_one_out(rows, size, label).filter("loo IS NOT NULL"), rows.sparkSession)
    loo = loo.join(quantiles(loo, label, "loo", {"med": 0.5}), label)
    mad = quantiles(loo.withColumn("_off", F.abs(F.col("loo") - F.col("med"))), label, "_off", {"mad": 0.5})
    loo = loo.join(mad.withColumn("mad", 1.4826 * F.col("mad")), label)
    gap = F.col("med") - F.col("loo")
    far = (gap > spreads * F.greatest("mad", F.lit(least_mad))) & (gap >= least_gap)
    return loo.withColumn("outlier", far | (F.col("loo") < floor))


def medoids(rows: DataFrame, size: int, key: str, label: str = "label") -> DataFrame:
    """The vector of each label with the largest sum of cosines to its label; ties to the smaller key."""
    joined = rows.join(label_sums(rows, size, label), label)
    score = F.round(dot(F.col("e"), F.col("total")), 9)
    return joined.groupBy(label).agg(F.max_by(key, F.struct(score, -F.col(key))).alias("medoid"), F.max(score).alias("score"))


def numbered_centres(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """(grp, key, v, label): the mean direction of each label, keys from 0 in the order of the labels."""
    centres = label_sums(rows, size, label).select(F.col(label).alias("label"), unit(F.col("total")).alias("v"), F.lit(1).alias("grp"))
    return saved(ranked(centres, "grp", [F.col("label")], "key").drop("_size"), rows.sparkSession)


def near_labels(rows: DataFrame, size: int, least: float, label: str = "label") -> DataFrame:
    """Pairs of labels (a, b, cosine) whose centroids have a cosine of ``least`` or more, compared in blocks that may reach it."""
    centres = numbered_centres(rows, size, label)
    named = lambda key, name: centres.select(F.col("key").alias(key), F.col("label").alias(name))
    return near_pairs(centres, least).join(named("key", "a"), "key").join(named("partner", "b"), "partner").select("a", "b", "cosine")


def nearest_label(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """For each label the other one with the largest cosine of centroids; ties to the smaller label."""
    centres = numbered_centres(rows, size, label)
    named = lambda key, name: centres.select(F.col("key").alias(key), F.col("label").alias(name))
    found = best_matches(centres, centres, -2.0, apart=True)
    return found.join(named("key", "a"), "key").join(named("partner", "nearest"), "partner").select("a", "nearest", F.round("cosine", 9).alias("cosine"))


def split_half(rows: DataFrame, size: int, key: str, label: str = "label", least: int = 6, seed: int = 42) -> DataFrame:
    """(label, n, half): cosine of the sums of a label's two halves, which are dealt by hash; labels of ``least`` or more."""
    placed = ranked(rows.select(label, F.col(key).cast("string").alias("_k"), "e"), label, [order_key(seed, "half", F.col("_k")), F.col("_k")], "_at")
    halves = placed.filter(F.col("_size") >= least).withColumn("_side", (F.col("_at") < F.floor(F.col("_size") / 2)).cast("int"))
    sums = halves.groupBy(label, "_side").agg(F.first("_size").alias("n"), vector_sum(F.col("e"), size).alias("t"))
    a, b = (sums.filter(F.col("_side") == i) for i in (0, 1))
    both = a.select(label, "n", unit(F.col("t")).alias("a")).join(b.select(label, unit(F.col("t")).alias("b")), label)
    return both.select(label, "n", dot(F.col("a"), F.col("b")).alias("half"))
