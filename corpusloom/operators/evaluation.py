"""Aggregates of evaluation runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.keys import draw
from corpusloom.operators.ranks import quantiles, ranked


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, median, p90 by nearest rank, population deviation; NaN counts as missing."""
    some = rows.select(*group, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = ranked(some.withColumn("_group", F.struct(*group)), "_group", [F.col("_x")], "_at")
    at = lambda pos: F.max(F.when(F.col("_at") == pos, F.col("_x")))
    n = F.col("_size")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    p90 = at(F.least(n - 1, F.floor(F.lit(0.9) * n)))
    return placed.groupBy(*group).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), middle.alias("median"), p90.alias("p90"), F.stddev_pop("_x").alias("sd"))


def micro_rate(rows: DataFrame, group: list[str], errors: Column, units: Column) -> DataFrame:
    return rows.groupBy(*group).agg((F.sum(errors) / F.greatest(F.lit(1), F.sum(units))).alias("micro"))


def macro_over_micro(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean of the inner groups' means."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.avg("m").alias("macro"), F.count("*").alias("groups"))


def weighted_mean(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    w, x = F.col(weight).cast("double"), F.col(value).cast("double")
    return rows.groupBy(*group).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("wmean"))


def rank_percentiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """min, p5, middle, p95, max by position in the sorted values."""
    placed = ranked(rows.select(*group, value).withColumn("_group", F.struct(*group)), "_group", [F.col(value)], "_at")
    at = lambda pos: F.max(F.when(F.col("_at") == pos, F.col(value)))
    n = F.col("_size")
    return placed.groupBy(*group).agg(F.count("*").alias("n"), at(F.lit(0)).alias("low"), at(F.floor(n / 20)).alias("p5"), at(F.floor(n / 2)).alias("middle"), at(n - F.ceil(n / 20)).alias("p95"), F.max(value).alias("high"))


def failure_report(rows: DataFrame, group: list[str], rate: str, name: str, failed: float = 0.5) -> DataFrame:
    """Per group: n, mean, median and greatest rate, and how many are above ``failed``; the worst one's name, ties to the least."""
    some = summary(rows, group, rate).select(*group, "n", "mean", "median")
    worst = F.min_by(name, F.struct((-F.col(rate)).alias("r"), F.col(name).alias("k")))
    rest = rows.groupBy(*group).agg(F.max(rate).alias("most"), F.count_if(F.col(rate) > failed).alias("n_fail"), worst.alias("worst"))
    return some.join(rest, group)


def scaled(value: Column, floor: Column, ceiling: Column) -> Column:
    """(value - floor) / (ceiling - floor); null where the two are next to equal."""
    return F.when(ceiling - floor > 1e-6, (value - floor) / (ceiling - floor))


def calibrated_thresholds(rows: DataFrame, group: str, score: str, floor: float = 0.35) -> DataFrame:
    """(group, link, half): links above the 99.9th percentile with a margin, halves by the first one, both within bounds."""
    found = quantiles(rows, group, score, {"p": 0.999, "q": 0.01})
    link = F.greatest(F.lit(floor), F.coalesce(F.col("p") + 0.03, F.lit(floor)))
    half = F.coalesce(F.greatest(F.lit(0.15), F.least(F.lit(0.45), F.col("q"))), F.lit(0.3))
    return found.select(group, link.alias("link"), half.alias("half"))


def effective_number(rows: DataFrame, group: list[str], mass: str) -> DataFrame:
    """1 / sum of squared shares of ``mass`` in each group."""
    m = F.col(mass).cast("double")
    return rows.groupBy(*group).agg((F.sum(m) * F.sum(m) / F.sum(m * m)).alias("effective"))


#: Cumulative chances of 0, 1, 2, … under a Poisson law of mean 1: a row's weight in a resampling is how many lie below its draw.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_interval(rows: DataFrame, group: list[str], key: str, value: str, times: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(group, low, high): percentile interval of the mean over ``times`` resamplings.

    A row's weights in the resamplings follow from the hash of its key, so runs agree and every resampling is a sum by
    group; sizes of resamplings vary around the group's. Draws are not those of any one language's generator.
    """
    some = rows.filter(F.col(value).isNotNull()).select(*group, F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_x"))
    drawn = some.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    u = draw(seed, "boot", F.col("_b"), F.col("_k"))
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    means = drawn.withColumn("_w", weight).groupBy(*group, "_b").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    found = means.filter("_m IS NOT NULL").groupBy(*group).agg(F.array_sort(F.collect_list("_m")).alias("_all"))  # ``times`` numbers
    low = F.get("_all", F.least(F.size("_all") - 1, F.floor(F.size("_all") * alpha / 2)).cast("int"))
    high = F.get("_all", F.least(F.size("_all") - 1, F.floor(F.size("_all") * (1 - alpha / 2))).cast("int"))
    return found.select(*group, low.alias("low"), high.alias("high"))


def scaled_within(value: Column, floor: Column, ceiling: Column) -> Column:
    """(value - floor) / (ceiling - floor), where the two are taken to be 1e-6 apart at least."""
    return (value - floor) / F.greatest(ceiling - floor, F.lit(1e-6))


def language_report(rows: DataFrame, group: list[str], rate: str, chars: str, name: str, failed: float = 0.5, times: int = 200) -> tuple[DataFrame, DataFrame]:
    """(report, failing) of rated rows: what a report says of each group, and the names above ``failed``, a row each.

    The report has n, mean, its interval (low, high), median, greatest rate, mean of ``chars``, n_fail and share_fail. The
    list of names grows with the rows, so it is a table.
    """
    some = failure_report(rows, group, rate, name, failed).drop("worst")
    interval = bootstrap_interval(rows, group, name, rate, times)
    more = rows.groupBy(*group).agg(F.avg(chars).alias("cer"))
    report = some.join(interval, group).join(more, group).withColumn("share_fail", F.col("n_fail") / F.col("n"))
    return report, rows.filter(F.col(rate) > failed).select(*group, name, rate)
