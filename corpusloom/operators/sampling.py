"""Deterministic sampling: draws, conditions, reference clips, mass-capped weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.keys import assigned, draw
from corpusloom.operators.asof import next_at_or_above
from corpusloom.session import saved


def draw_variant(u: Column, mix: dict[str, float]) -> Column:
    """The variant, by name order, whose cumulative share first exceeds ``u``; the last one beyond."""
    names = sorted(k for k, v in mix.items() if v > 0)
    total, upto, out = sum(mix[k] for k in names), 0.0, None
    for name in names[:-1]:
        upto += mix[name] / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def conditions(clips: DataFrame, mix: dict[str, float], epoch: int, seed: int = 42) -> DataFrame:
    return clips.withColumn("variant", draw_variant(draw(seed, epoch, F.col("idx"), "variant"), mix))


def augmented(idx: Column, variants: list[int], p: float, salt: int, seed: int = 42) -> Column:
    """With probability ``p`` one of ``variants``, each alike, else null."""
    k = (F.floor(draw("augk", seed, salt, idx) * len(variants)) % len(variants)).cast("int")
    return F.when(draw("aug", seed, salt, idx) < p, F.element_at(F.array(*map(F.lit, variants)), k + 1))


def cyclic_successor(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """``name``: the next key of the group in order, the first one after the last."""
    by = Window.partitionBy(group).orderBy(key)
    return rows.withColumn(name, F.coalesce(F.lead(key).over(by), F.first(key).over(by)))


def pick_reference(clips: DataFrame, epoch: int, seed: int = 42, low: float = 2.5, high: float = 10.2) -> DataFrame:
    """For each clip another clip of its speaker, by hash, never itself; ``ref`` is null where there is none.

    The pool of a speaker is its clips of reference length in idx order. A pick is a position, so the pool is joined
    on (speaker, position) and never gathered in an array.
    """
    fits = assigned(F.col("speaker")) & F.coalesce("dur", F.lit(0.0)).between(low, high)
    pool = clips.filter(fits).select("speaker", "idx")
    pool = pool.withColumn("pos", F.row_number().over(Window.partitionBy("speaker").orderBy("idx")) - 1)
    sizes = pool.groupBy("speaker").agg(F.count("*").alias("n"))
    own = pool.select(F.col("idx"), F.col("pos").alias("own"))
    rows = clips.join(sizes, "speaker", "left").join(own, "idx", "left")
    others = F.col("n") - F.when(F.col("own").isNotNull(), 1).otherwise(0)
    j = F.when(others > 0, F.floor(draw(seed, epoch, F.col("idx"), "ref") * others) % others)
    rows = rows.withColumn("pos", (j + F.when(F.col("own").isNotNull() & (j >= F.col("own")), 1).otherwise(0)).cast("int"))
    picked = pool.select("speaker", "pos", F.col("idx").alias("ref"))
    return rows.join(picked, ["speaker", "pos"], "left").select(*clips.columns, "ref")


def multinomial(rows: DataFrame, key: str, u: Column) -> DataFrame:
    """(key, token): one token of each key by its softmax probability: the first whose cumulative share exceeds ``u``."""
    whole = Window.partitionBy(key)
    odds = rows.withColumn("_w", F.exp(F.col("score") - F.max("score").over(whole)))
    upto = F.sum("_w").over(whole.orderBy("token")) / F.sum("_w").over(whole)
    odds = odds.withColumn("_upto", upto).withColumn("_last", F.max("token").over(whole))
    return odds.filter((F.col("_upto") > u) | (F.col("token") == F.col("_last"))).groupBy(key).agg(F.min("token").alias("token"))


def mass_weights(clips: DataFrame, share: dict[str, float], beta: float = 0.5, cap_voice: float = 0.01, cap_group: float = 0.02, rounds: int = 500, samples: int = 0, most_repeats: float = 0.0) -> DataFrame:
    """(corpus, speaker, grp, n_clips, mass, weight): sampling mass of each voice, and of each of its clips.

    Masses start from the corpus shares and n^beta within a corpus. A round cuts them to a cap per group and per voice and
    deals what is lacking to the voices with room; it is two sums by group and one over all, and the voices stay a table.
    Caps that cannot hold a mass of 1 are relaxed. With ``samples`` and ``most_repeats`` a voice's cap is also what
    gives each of its clips ``most_repeats`` of the samples. Where caps leave a rest after ``rounds``, masses are scaled to 1.
    """
    spark = clips.sparkSession
    voices = clips.groupBy("corpus", "speaker").agg(F.count("*").alias("n_clips"), F.min("grp").alias("grp"))
    voices = saved(voices.withColumn("_p", F.pow("n_clips", F.lit(beta))), spark)
    corpora = voices.groupBy("corpus").agg(F.sum("_p").alias("_all"))
    wanted = F.lit(1.0)
    for name, value in share.items():
        wanted = F.when(F.col("corpus") == name, float(value)).otherwise(wanted)
    corpora = corpora.withColumn("_wanted", wanted)
    whole = corpora.agg(F.sum("_wanted")).first()[0]
    sizes = voices.agg(F.count("*").alias("voices"), F.count_distinct("grp").alias("groups")).first()
    if not sizes["voices"]:
        return voices.select("corpus", "speaker", "grp", "n_clips", F.lit(0.0).alias("mass"), F.lit(0.0).alias("weight"))
    cap = F.lit(cap_voice)
    if samples and most_repeats:
        cap = F.least(cap, F.col("n_clips") * (most_repeats / samples))
    held = voices.agg(F.sum(cap)).first()[0]
    most_voice = cap * (1.0001 / held) if held < 1 else cap
    most_group = max(cap_group, 1.0001 / sizes["groups"] if cap_group * sizes["groups"] < 1 else 0)
    now = voices.join(corpora, "corpus").select("corpus", "speaker", "grp", "n_clips", (F.col("_wanted") / whole * F.col("_p") / F.col("_all")).alias("mass"))
    for _ in range(rounds):
        held = now.groupBy("grp").agg(F.sum("mass").alias("_held"))
        cut = F.least(F.col("mass") * F.least(F.lit(1.0), most_group / F.greatest("_held", F.lit(1e-300))), most_voice)
        now = now.join(held, "grp").withColumn("mass", cut).drop("_held")
        held = now.groupBy("grp").agg(F.sum("mass").alias("_held"))
        room = F.greatest(F.least(most_voice - F.col("mass"), most_group - F.col("_held")), F.lit(0.0))
        now = now.join(held, "grp").withColumn("_room", room).withColumn("_share", F.when(F.col("_room") > 1e-12, F.col("mass")).otherwise(0.0)).drop("_held")
        now = saved(now, spark)
        total = now.agg(F.sum("mass").alias("mass"), F.sum("_share").alias("share")).first()
        lacking = 1 - total["mass"]
        if lacking < 1e-10 or total["share"] <= 0:
            break
        now = now.withColumn("mass", F.col("mass") + F.least("_room", lacking * F.col("_share") / total["share"])).drop("_room", "_share")
    whole = now.agg(F.sum("mass")).first()[0]
    now = now.withColumn("mass", F.col("mass") / whole)
    return now.select("corpus", "speaker", "grp", "n_clips", "mass", (F.col("mass") / F.col("n_clips")).alias("weight"))


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, ``key``): ``n`` draws with replacement, each row as likely as its whole-number ``weight``.

    The rows lie along a line in the order of their keys, each as long as its weight, and draw i is the row at a point
    that its hash gives. Sums go over sorted parts with the weight of the parts before; points meet rows by an as-of join
    on the rows' ends, so a heavy row is one row and no task has more than its part. Places are doubles, as the points
    are: whole numbers up to 2^53. Rows of a weight that is null or below 1 are never drawn; without any row there is no
    draw. A repeated key is as many rows.
    """
    spark = rows.sparkSession
    line = rows.select(key, F.col(weight).cast("decimal(38,0)").alias("_w")).filter("_w > 0").repartitionByRange(key)
    line = saved(line.withColumn("_part", F.spark_partition_id()), spark)
    sums = line.groupBy("_part").agg(F.sum("_w").cast("decimal(38,0)").alias("_s"))  # one row a part
    upto = F.sum("_s").over(Window.orderBy("_part")).cast("decimal(38,0)")
    sums = sums.select("_part", (upto - F.col("_s")).alias("_before"), upto.alias("_upto"))
    total = sums.agg(F.max("_upto")).first()[0]
    if not total or n < 1:
        return rows.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum("_w").over(own) + F.col("_before")).cast("decimal(38,0)")
    ends = line.join(sums, "_part").select(F.lit(0).alias("_line"), key, (end - 1).alias("_to"))
    at = F.least(F.floor(draw(seed, "weighted", F.col("id")) * F.lit(float(total))).cast("decimal(38,0)"), F.lit(int(total) - 1).cast("decimal(38,0)"))
    points = spark.range(n).select(F.col("id").alias("draw"), F.lit(0).alias("_line"), at.alias("_at"))
    return next_at_or_above(points, ends, ["_line"], "_at", "_to", [key], "_drawn").select("draw", F.col("_drawn")[key].alias(key))
