"""Verdicts on labels: how cohesive a label's vectors are and how many fall outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.vectors import dot, unit, vector_sum
from corpusloom.operators.similarity import cohesion, label_sums, near_labels, nearest_label, outliers
from corpusloom.session import saved

# fixed values: the statuses and their thresholds
FEW, BAD, SUSPECT, FINE = "POUCOS", "RUIM", "SUSPEITO", "OK"
LEAST_CLIPS, INTRA_WARN, INTRA_BAD, SHARE_WARN, SHARE_BAD = 4, 0.55, 0.45, 0.10, 0.25
LEAST_SIDE, LEAST_SIDE_SHARE, MOST_BETWEEN, LEAST_MARGIN, SAME_VOICE = 3, 0.20, 0.55, 0.12, 0.85
LEAST_REFINED, LEAST_REFINED_INTRA = 8, 0.55


def label_verdicts(rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """(label, n, intra, outlier_share, status) of unit vectors."""
    share = outliers(rows, size, label).groupBy(label).agg(F.avg(F.col("outlier").cast("int")).alias("outlier_share"))
    out = cohesion(rows, size, label).join(share, label, "left")
    bad = (F.col("intra") < INTRA_BAD) | (F.col("outlier_share") >= SHARE_BAD)
    warn = (F.col("intra") < INTRA_WARN) | (F.col("outlier_share") >= SHARE_WARN)
    return out.withColumn("status", F.when(F.col("n") < LEAST_CLIPS, FEW).when(bad, BAD).when(warn, SUSPECT).otherwise(FINE))


def group_summary(verdicts: DataFrame, group: str) -> DataFrame:
    """Per group, labels without a verdict left out: labels, vectors, median and tenth percentile of intra, counts by status."""
    some = verdicts.filter(F.col("status") != FEW)
    return some.groupBy(group).agg(
        F.count("*").alias("labels"), F.sum("n").alias("clips"), F.median("intra").alias("median_intra"), F.percentile("intra", 0.1).alias("p10_intra"),
        F.count_if(F.col("status") == FINE).alias("ok"), F.count_if(F.col("status") == SUSPECT).alias("suspect"), F.count_if(F.col("status") == BAD).alias("bad"),
    )


def two_means(rows: DataFrame, size: int, key: str, label: str = "label", rounds: int = 20) -> DataFrame:
    """(key, label, e, side): each label's unit vectors in two groups by spherical 2-means; side is 0 or 1.

    It starts from the vector least like the label's centroid and the one least like that, ties to the smaller key, which
    takes two linear passes where the least similar pair would take all pairs. Vectors are summed by label and side on
    the map side, so only two centres a label are kept; a side without vectors keeps its centre, and a vector as near
    to both goes to side 0. A label of one vector has side 0 only.
    """
    spark = rows.sparkSession
    own = saved(rows.select(key, label, "e"), spark)
    first = F.struct(-F.round(dot(F.col("e"), F.col("c")), 9), -F.col(key))
    start = label_sums(own, size, label).select(label, unit(F.col("total")).alias("c"))
    found = []
    for _ in range(2):
        start = saved(own.join(start, label).groupBy(label).agg(F.max_by("e", first).alias("c")), spark)
        found.append(start)
    now = found[0].withColumnRenamed("c", "c0").join(found[1].withColumnRenamed("c", "c1"), label)
    sided = None
    for _ in range(rounds):
        sided = own.join(now, label).withColumn("side", (dot(F.col("e"), F.col("c1")) > dot(F.col("e"), F.col("c0"))).cast("int"))
        sums = sided.groupBy(label, "side").agg(vector_sum(F.col("e"), size).alias("t"))
        sums = sums.groupBy(label).agg(*[F.max(F.when(F.col("side") == k, unit(F.col("t")))).alias(f"n{k}") for k in (0, 1)])
        moved = now.join(sums, label).select(label, "c0", "c1", *[F.coalesce(f"n{k}", f"c{k}").alias(f"n{k}") for k in (0, 1)])
        moved = saved(moved, spark)
        still = (dot(F.col("c0"), F.col("n0")) > 1 - 1e-12) & (dot(F.col("c1"), F.col("n1")) > 1 - 1e-12)
        done = not moved.filter(~still).limit(1).count()
        now = moved.select(label, F.col("n0").alias("c0"), F.col("n1").alias("c1"))
        if done:
            break
    return sided.select(key, label, "e", "side")


def two_voices(sided: DataFrame, size: int, label: str = "label") -> DataFrame:
    """(label, n0, n1, inter, intra0, intra1, across, two_voices) of the sides of :func:`two_means`.

    Cosines within and across sides come from the sums of their vectors. Two voices are two sides of some size, unlike
    each other and more alike within than across.
    """
    side = lambda k: F.when(F.col("side") == k, 1)
    part = lambda k: [F.count(side(k)).alias(f"n{k}"), F.transform(vector_sum(F.when(F.col("side") == k, F.col("e")), size), lambda x: F.coalesce(x, F.lit(0.0))).alias(f"t{k}")]
    sums = sided.groupBy(label).agg(*part(0), *part(1))
    within = lambda k: F.when(F.col(f"n{k}") > 1, (dot(F.col(f"t{k}"), F.col(f"t{k}")) - F.col(f"n{k}")) / (F.col(f"n{k}") * (F.col(f"n{k}") - 1)))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    out = sums.select(
        label, "n0", "n1", F.when(both, dot(unit(F.col("t0")), unit(F.col("t1")))).alias("inter"), within(0).alias("intra0"), within(1).alias("intra1"),
        F.when(both, dot(F.col("t0"), F.col("t1")) / (F.col("n0") * F.col("n1"))).alias("across"),
    )
    small = F.least("n0", "n1")
    two = (small >= LEAST_SIDE) & (small / (F.col("n0") + F.col("n1")) >= LEAST_SIDE_SHARE) & (F.col("inter") < MOST_BETWEEN) & (F.least("intra0", "intra1") - F.col("across") >= LEAST_MARGIN)
    return out.withColumn("two_voices", F.coalesce(two, F.lit(False)))


def voice_verdicts(verdicts: DataFrame, voices: DataFrame, label: str = "label") -> DataFrame:
    """``verdicts`` of :func:`label_verdicts` with the test of two voices: status and ``reasons``, an array of words."""
    out = verdicts.drop("status").join(voices.select(label, "two_voices"), label, "left").withColumn("two_voices", F.coalesce("two_voices", F.lit(False)))
    few = F.col("n") < LEAST_CLIPS
    intra, share = F.col("intra"), F.col("outlier_share")
    bad = F.coalesce((intra < INTRA_BAD) | (share >= SHARE_BAD), F.lit(False)) | F.col("two_voices")
    warn = F.coalesce((intra < INTRA_WARN) | (share >= SHARE_WARN), F.lit(False))
    why = [F.when(intra < INTRA_WARN, "intra"), F.when(share >= SHARE_WARN, "outliers"), F.when(F.col("two_voices"), "two voices")]
    status = F.when(few, FEW).when(bad, BAD).when(warn, SUSPECT).otherwise(FINE)
    return out.withColumn("status", status).withColumn("reasons", F.when(few, F.array(F.lit("few"))).otherwise(F.array_compact(F.array(*why))))


def doubled_labels(rows: DataFrame, size: int, label: str = "label", least: float = SAME_VOICE) -> DataFrame:
    """Pairs of labels (a, b, cosine) that seem one voice, by centroids without outliers; of all vectors where all are."""
    judged = outliers(rows, size, label)
    clean = judged.filter("NOT outlier").select(label, "e")
    bare = rows.join(clean.select(label).distinct(), label, "left_anti").select(label, "e")
    return near_labels(saved(clean.unionByName(bare), rows.sparkSession), size, least, label)


def refined_labels(rows: DataFrame, size: int, key: str, label: str = "label") -> DataFrame:
    """(key, label, refined, why): vectors without intruders, and labels of two voices as ``label#a`` and ``label#b``.

    ``refined`` is null where a vector is dropped, and ``why`` says so: ``outlier``, or ``small side`` where a side has
    too few vectors left or is not alike enough. A side is cleaned against itself. A label of one vector stays.
    """
    sided = two_means(rows, size, key, label)
    voices = two_voices(sided, size, label)
    named = F.when(F.col("two_voices"), F.concat(F.col(label).cast("string"), F.when(F.col("side") == 0, "#a").otherwise("#b"))).otherwise(F.col(label).cast("string"))
    named = saved(sided.join(voices.select(label, "two_voices"), label).withColumn("_name", named), rows.sparkSession)
    judged = outliers(named.select(key, "_name", "e"), size, "_name").select(key, "_name", "outlier")
    parts = cohesion(named, size, "_name").select("_name", "intra")
    left = judged.groupBy("_name").agg(F.count_if(~F.col("outlier")).alias("_left"))
    out = named.join(judged, [key, "_name"], "left").join(parts, "_name").join(left, "_name", "left")
    outlier = F.coalesce("outlier", F.lit(False))
    small: Column = F.col("two_voices") & ~F.coalesce((F.col("_left") >= LEAST_REFINED) & (F.col("intra") >= LEAST_REFINED_INTRA), F.lit(False))
    why = F.when(outlier, "outlier").when(small, "small side")
    return out.select(key, label, F.when(why.isNull(), F.col("_name")).alias("refined"), why.alias("why"))


def purity_run(rows: DataFrame, size: int, key: str, label: str = "label", split: str | None = None, same: float = SAME_VOICE) -> tuple[DataFrame, DataFrame]:
    """(verdicts, pairs) of unit vectors ``e``: what a whole run over labels finds.

    Verdicts are those of :func:`voice_verdicts` with ``nearest`` and ``nearest_cosine``, the most alike other label.
    Pairs (a, b, cosine, cross_split) are labels that seem one voice; either of them is at least suspect, and its reasons
    say which one it equals, and that they leak where their splits differ. ``split`` is a column of one value a label; an
    empty or null one differs from none.
    """
    spark = rows.sparkSession
    own = saved(rows, spark)
    verdicts = voice_verdicts(label_verdicts(own, size, label), two_voices(two_means(own, size, key, label), size, label), label)
    near = nearest_label(own, size, label).select(F.col("a").alias(label), "nearest", F.col("cosine").alias("nearest_cosine"))
    pairs = doubled_labels(own, size, label, same)
    if split:
        of = own.groupBy(label).agg(F.nullif(F.min(split), F.lit("")).alias("_split"))
        side = lambda name: of.select(F.col(label).alias(name), F.col("_split").alias(f"_{name}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cross_split", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))).drop("_a", "_b")
    else:
        pairs = pairs.withColumn("cross_split", F.lit(False))
    pairs = saved(pairs, spark)
    told = lambda a, b: pairs.select(F.col(a).alias(label), F.struct((-F.col("cosine")).alias("by"), F.concat(F.lit("same voice as "), F.col(b).cast("string"), F.when(F.col("cross_split"), ", other split").otherwise("")).alias("why")).alias("w"))
    # a label has as many reasons as others that equal it
    why = told("a", "b").unionByName(told("b", "a")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["why"]).alias("_why"))
    out = verdicts.join(near, label, "left").join(why, label, "left")
    reasons = F.concat("reasons", F.coalesce("_why", F.array().cast("array<string>")))
    return out.withColumn("reasons", reasons).withColumn("status", F.when((F.col("status") == FINE) & F.col("_why").isNotNull(), SUSPECT).otherwise(F.col("status"))).drop("_why"), pairs
