"""Mixing sources to target weights, with DataFrame expressions only.

Tokens are summed per source, a water-filled target and a repetition rate follow for each source, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) with 52 random bits, the same on every run and in every engine that has SHA-1."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha1(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target, rate from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. Solved in closed form: with
    sources ordered by cap per weight, the first k are full and the rest get ``level * weight``.
    There is one row per source here, so the windows run over the list of sources and not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), k + 1)
    per = per.withColumn("weight", weight)
    ratio = (most * F.col("source_size")) / F.col("weight")
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_before", F.sum(most * F.col("source_size")).over(upto) - most * F.col("source_size"))
        .withColumn("weight_before", F.sum("weight").over(upto) - F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("fits", F.col("ratio") >= F.col("level"))
        # the first source whose cap holds its share fixes the level for all after it
        .withColumn("final", F.min_by("level", F.when(F.col("fits"), F.struct("ratio", F.col("source").isNull(), "source"))).over(everything))
    )
    target = F.when(F.col("ratio") < F.col("final"), (most * F.col("source_size")).cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select(
        "source", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"),
    )


def with_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` in a struct ``row`` with size, source, source_size, target and copies.

    A null text has size 0; null is a source like any other; equal ids (and a null id) draw alike; sources without
    words get target 0 and rate 0; an empty table gives an empty result. Extra columns stay inside ``row``, so
    their names cannot clash.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    sized = rows.select("row", words_in(F.col(f"row.{text_col}")).alias("size"), F.col(f"row.{source_col}").alias("source"))
    # written once: the planner then knows that this side is one small row per source and can choose its join
    targets = saved(source_targets(sized.select("source", "size"), weights, most), spark)
    joined = sized.join(targets.withColumnRenamed("source", "_target_source"), F.col("source").eqNullSafe(F.col("_target_source")), "left")
    whole = F.floor("rate")
    extra = uniform(F.col(f"row.{id_col}"), seed=seed) < F.col("rate") - whole
    return joined.select("row", "size", "source", "source_size", "target", (whole + extra.cast("long")).alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    taken = with_copies(spark, docs, **options)
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
