"""Gates and verdicts on rows: candidates, conditions, voice changes, clip statuses, batches by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import plausible_duration
from corpusloom.operators.ranks import quantiles
from corpusloom.session import saved


def gated(rows: DataFrame, group: str, most_wer: float = 0.05, low: float = 0.75, high: float = 1.30) -> DataFrame:
    """Candidates (``group``, wer, dur, text) that pass; all of a group in which none does.

    A candidate passes with a word error rate that is small or not known, a duration near its group's median and one
    that is plausible for its text.
    """
    # one row a group, saved, so that Spark knows its size and a hot group is not brought together
    rows = rows.join(saved(quantiles(rows, group, "dur", {"_mid": 0.5}), rows.sparkSession), group)
    near = (F.col("dur") / F.greatest(F.col("_mid"), F.lit(0.01))).between(low, high)
    passed = F.coalesce(F.col("wer") <= most_wer, F.lit(True)) & near & plausible_duration(F.col("text"), F.col("dur"))
    rows = rows.withColumn("passed", F.coalesce(passed, F.lit(False)))
    some = saved(rows.groupBy(group).agg(F.max("passed").alias("_any")), rows.sparkSession)
    return rows.join(some, group).filter("passed OR NOT _any").drop("_any", "_mid")


def resolved(rows: DataFrame, needs: tuple[str, ...], fallback: str, require: bool = False) -> DataFrame:
    """``variant`` of rows (variant, ref): one that needs a reference and has none falls back; ``ref`` goes where not needed.

    With ``require`` only rows with a variant that needs a reference, and one to use, stay.
    """
    needed = F.col("variant").isin(*needs)
    if require:
        return rows.filter(needed & F.col("ref").isNotNull())
    variant = F.when(needed & F.col("ref").isNull(), fallback).otherwise(F.col("variant"))
    return rows.withColumn("ref", F.when(needed, F.col("ref"))).withColumn("variant", variant)


def parsed_mix(spec: Column, names: dict[str, str]) -> Column:
    """map<variant, share> of ``name=number,…``: names by their aliases, shares of the sum, zeros left out.

    An unknown name, or a sum that is not positive, is an error.
    """
    pairs = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    alias = F.create_map(*[F.lit(x) for k, v in {**{v: v for v in names.values()}, **names}.items() for x in (k, v)])
    read = F.transform(pairs, lambda p: F.struct(F.element_at(alias, F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.split_part(p, F.lit("="), F.lit(2))).cast("double").alias("v")))
    kinds = sorted(set(names.values()))
    total = F.aggregate(read, F.lit(0.0), lambda s, p: s + p["v"])
    of = lambda kind: F.aggregate(F.filter(read, lambda p: p["k"] == kind), F.lit(0.0), lambda s, p: s + p["v"])
    shares = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), (of(k) / total).alias("v")) for k in kinds]), lambda p: p["v"] > 0)
    wrong = F.when(F.exists(read, lambda p: p["k"].isNull()), F.raise_error(F.lit("unknown variant"))).when(total <= 0, F.raise_error(F.lit("empty mix")))
    return F.when(F.exists(read, lambda p: p["k"].isNull()) | (total <= 0), wrong.cast("map<string,double>")).otherwise(F.map_from_entries(shares))


def voice_changed(rows: DataFrame, label: str, halves: str, threshold: float, gap: float = 0.15) -> DataFrame:
    """``changed``: halves that are unlike, below ``threshold``, in a label whose median is far above or low as well."""
    middle = saved(quantiles(rows, label, halves, {"_mid": 0.5}), rows.sparkSession)
    low = (F.col(halves) < threshold) & ((F.col(halves) < F.col("_mid") - gap) | (F.col("_mid") < threshold))
    return rows.join(middle, label, "left").withColumn("changed", F.coalesce(low, F.lit(False))).drop("_mid")


def status_of(checks: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The first status whose condition holds."""
    return F.coalesce(*[F.when(condition, name) for name, condition in checks], F.lit(otherwise))


def length_buckets(rows: DataFrame, length: str, ratio: float = 2.0) -> DataFrame:
    """``bucket``: rows in order of length, a new bucket where a length is more than ``ratio`` times the bucket's least.

    A bucket's least length is a minimum over the different lengths beyond the bucket before, so there are as many passes
    over these as the lengths' range has powers of ``ratio``.
    """
    lengths = saved(rows.select(F.col(length).cast("double").alias("x")).filter("x IS NOT NULL").distinct(), rows.sparkSession)
    found: list[float] = []
    while (least := lengths.filter(F.col("x") > found[-1] * ratio if found else F.lit(True)).agg(F.min("x")).first()[0]) is not None:
        found.append(least)
    return rows.withColumn("bucket", F.size(F.filter(F.lit(found).cast("array<double>"), lambda s: s <= F.col(length))) - 1)


def incomplete(rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Keys that are not in ``parts`` exactly once: (key, times), and keys of ``parts`` that no row has."""
    times = parts.groupBy(key).agg(F.count("*").alias("times"))
    known = rows.select(key).distinct().withColumn("_known", F.lit(True))
    joined = known.join(times, key, "full_outer").withColumn("times", F.coalesce("times", F.lit(0)))
    return joined.filter(F.col("_known").isNull() | (F.col("times") != 1)).select(key, "times")
