"""Who speaks in a clip: stages that drop clips, link labels of episodes into persons, and check the persons again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.keys import order_key
from corpusloom.functions.vectors import dot
from corpusloom.operators.gates import voice_changed
from corpusloom.operators.graph import components, numbered
from corpusloom.operators.linkage import complete_linkage
from corpusloom.operators.partners import near_pairs
from corpusloom.operators.purity import BAD, label_verdicts, refined_labels, two_means, two_voices, voice_verdicts
from corpusloom.operators.ranks import quantiles, ranked
from corpusloom.operators.similarity import near_labels, numbered_centres
from corpusloom.session import saved

# fixed values: the statuses of a clip, the bucket of those without a person, and the thresholds
FAILED, BLEEDS, MIXED, SPLIT, OUTLIER, SMALL, IMPURE, KEPT = "drop_fail", "drop_bleed", "drop_mixed", "drop_split", "drop_outlier", "drop_small", "drop_impure", "kept"
NOBODY = "podcast:99"
LEAST_CLIPS, LINK_FLOOR, LINK_MARGIN, HALF_GAP = 8, 0.75, 0.03, 0.15


def person_ids(rows: DataFrame, person: str, mass: str, prefix: str) -> DataFrame:
    """``rows`` with ``id``: ``prefix`` and the rank by ``mass``, greatest first, three digits at least; ties to the smaller person."""
    placed = ranked(rows.withColumn("_one", F.lit(1)), "_one", [F.desc(mass), F.asc(person)], "_at")
    number = (F.col("_at") + 1).cast("string")
    return placed.withColumn("id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0"))).drop("_one", "_at", "_size")


def link_threshold(rows: DataFrame, size: int, label: str = "label", most: int = 60, floor: float = LINK_FLOOR, margin: float = LINK_MARGIN) -> float:
    """The cosine from which two centroids are one person: above what different labels reach, and ``floor`` at least.

    The centroids of ``most`` labels, first by hash, are compared with each other: a bounded sample of known persons.
    """
    some = rows.select(label).distinct().orderBy(order_key(F.col(label)), label).limit(most)
    centres = numbered_centres(rows.join(some, label, "left_semi"), size, label)
    found = quantiles(near_pairs(centres, -2.0), "grp", "cosine", {"p": 0.999}).first()
    return floor if found is None else max(floor, found["p"] + margin)


def episode_groups(members: DataFrame) -> DataFrame:
    """(tag, grp) of (tag, person): episodes that share a person, directly or by others, are one group G001, G002, ..."""
    first = members.groupBy("person").agg(F.min("tag").alias("u"))
    found = components(members.sparkSession, members.join(first, "person").select("u", F.col("tag").alias("v")))
    tags = members.select("tag").distinct().join(found.withColumnRenamed("node", "tag"), "tag", "left")
    every = saved(tags.select(F.col("tag").alias("node"), F.coalesce("component", "tag").alias("component")), members.sparkSession)
    return numbered(every).select(F.col("node").alias("tag"), "grp")


def clip_identities(clips: DataFrame, size: int, link: float = LINK_FLOOR, half: float = 0.3, least_clips: int = LEAST_CLIPS, keep_impure: bool = False) -> DataFrame:
    """(idx, tag, label, sub, speaker, grp, status, half_sim) of every clip; each stage sees what those before it kept.

    ``clips`` are (idx, tag, label, seconds, e, h1, h2, bleeds): a clip's number, episode, label within the episode, unit
    vectors of the whole and of its halves (null where there is none), and whether another voice bleeds into its edges.

    1. no vector: ``drop_fail``; bleeding edges: ``drop_bleed``;
    2. halves that are unlike, against ``half`` and their label: ``drop_mixed``;
    3. labels are refined: intruders ``drop_outlier``, sides that are of no use ``drop_split``, what is left of a label with
       fewer than ``least_clips`` clips ``drop_small``;
    4. refined labels are linked into persons where all their centroids reach ``link``; persons are numbered by seconds, and
       episodes that share persons are one group;
    5. persons are judged again, and those that are bad go with their clips: ``drop_impure``.
    """
    spark = clips.sparkSession
    own = saved(clips.select("idx", "tag", "label", "seconds", "e", "h1", "h2", F.when(F.col("e").isNull(), FAILED).when(F.coalesce("bleeds", F.lit(False)), BLEEDS).alias("first")), spark)
    halves = own.filter("first IS NULL AND h1 IS NOT NULL AND h2 IS NOT NULL").select("idx", "label", dot(F.col("h1"), F.col("h2")).alias("half_sim"))
    judged = saved(voice_changed(halves, "label", "half_sim", half, HALF_GAP).select("idx", "half_sim", "changed"), spark)
    left = saved(own.filter("first IS NULL").join(judged.filter("changed").select("idx"), "idx", "left_anti").select("idx", "label", "e"), spark)
    refined = saved(refined_labels(left, size, "idx").select("idx", "refined", F.when(F.col("why") == "outlier", OUTLIER).when(F.col("why").isNotNull(), SPLIT).alias("third")), spark)
    large = refined.filter("refined IS NOT NULL").groupBy("refined").count().filter(F.col("count") >= least_clips).select("refined")
    subs = saved(left.join(refined.filter("refined IS NOT NULL"), "idx").join(large, "refined", "left_semi").select("idx", F.col("refined").alias("sub"), "e"), spark)
    linked = complete_linkage(subs.select("sub"), near_labels(subs, size, link, "sub"), "sub")
    persons = subs.select("idx", "sub").join(own.select("idx", "tag", "seconds"), "idx").join(linked, "sub")
    persons = saved(persons.select("idx", "sub", "tag", "seconds", "cluster"), spark)
    named = person_ids(persons.groupBy("cluster").agg(F.round(F.sum("seconds"), 6).alias("seconds")), "cluster", "seconds", "podcast:P").select("cluster", F.col("id").alias("person"))
    persons = saved(persons.join(named, "cluster").select("idx", "sub", "tag", "person"), spark)
    groups = episode_groups(persons.select("tag", "person").distinct())
    voices = saved(persons.select("idx", "person").join(left.select("idx", "e"), "idx"), spark)
    verdicts = voice_verdicts(label_verdicts(voices, size, "person"), two_voices(two_means(voices, size, "idx", "person"), size, "person"), "person")
    impure = verdicts.filter(F.col("status") == BAD).select("person", F.lit(not keep_impure).alias("impure"))
    out = own.select("idx", "tag", "label", "first").join(judged, "idx", "left").join(refined, "idx", "left").join(persons.select("idx", "sub", "person"), "idx", "left").join(impure, "person", "left").join(groups, "tag", "left")
    status = F.coalesce("first", F.when(F.col("changed"), MIXED), "third", F.when(F.col("person").isNull(), SMALL), F.when(F.col("impure"), IMPURE), F.lit(KEPT))
    out = out.withColumn("status", status)
    return out.select("idx", "tag", "label", "sub", F.when(F.col("status") == KEPT, F.col("person")).otherwise(NOBODY).alias("speaker"), F.coalesce("grp", F.concat(F.lit("E_"), "tag")).alias("grp"), "status", "half_sim")
