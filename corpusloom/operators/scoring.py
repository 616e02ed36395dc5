"""Scoring plans: which voice says which phrase, what is still to be done, and what the measures come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# fixed values: the groups of voices in a plan
UNSEEN, USER = "val", "user"


def plan_voices(unseen: DataFrame, users: DataFrame) -> DataFrame:
    """(name, grp, prompt_audio, prompt_text, heldout, self_heldout) of the voices of a plan.

    ``unseen`` and ``users`` are (name, audio, text, heldout): heldout is an array of other recordings, and a user's
    voice without any is held against its own prompt. A name that two voices have is an error.
    """
    some = F.filter(F.coalesce("heldout", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    own = users.withColumn("heldout", some)
    bare = F.size("heldout") == 0
    columns = ["name", F.col("audio").alias("prompt_audio"), F.col("text").alias("prompt_text")]
    kept = unseen.select(F.lit(UNSEEN).alias("grp"), *columns, F.coalesce("heldout", F.array().cast("array<string>")).alias("heldout"), F.lit(False).alias("self_heldout"))
    added = own.select(F.lit(USER).alias("grp"), *columns, F.when(bare, F.array("audio")).otherwise(F.col("heldout")).alias("heldout"), bare.alias("self_heldout"))
    every = kept.unionByName(added)
    times = every.groupBy("name").agg(F.count("*").alias("_n"))
    checked = every.join(times, "name")
    return checked.withColumn("name", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a name that voices share: "), "name"))).otherwise(F.col("name"))).select("name", "grp", "prompt_audio", "prompt_text", "heldout", "self_heldout")


def phrase_plan(phrases: DataFrame, unseen: list[int] | None = None) -> DataFrame:
    """(grp, k, phrase): the phrases (k, phrase) of each group; unseen voices say those of ``unseen`` only, if it is given."""
    groups = F.explode(F.array(F.lit(UNSEEN), F.lit(USER)))
    every = phrases.select(groups.alias("grp"), "k", "phrase")
    return every if unseen is None else every.filter((F.col("grp") != UNSEEN) | F.col("k").isin(*unseen) if unseen else F.col("grp") != UNSEEN)


def jobs(voices: DataFrame, phrases: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(key, name, grp, k, phrase, prompt_audio, prompt_text): what is still to be said, by a join on the group.

    ``key`` is ``name__pk``; keys in ``done`` (key) are left out, so that a plan goes on where it stopped.
    """
    both = voices.join(phrases, "grp")
    both = both.withColumn("key", F.concat("name", F.lit("__p"), F.col("k").cast("string"))).select("key", "name", "grp", "k", "phrase", "prompt_audio", "prompt_text")
    return both if done is None else both.join(done.select("key").distinct(), "key", "left_anti")


def scores(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, grp, n, secs, wer, secs_norm) of measures (key, name, grp, secs, wer) and each voice's (name, floor, ceiling).

    ``secs_norm`` is where the mean lies between floor and ceiling; null where the two are next to equal, as they are not
    told apart for voices that are held against themselves.
    """
    means = measured.groupBy("name", "grp").agg(F.count("*").alias("n"), F.avg("secs").alias("secs"), F.avg("wer").alias("wer"))
    wide = F.col("ceiling") - F.col("floor")
    return means.join(bounds, "name", "left").select("name", "grp", "n", "secs", "wer", F.when(wide > 1e-6, (F.col("secs") - F.col("floor")) / wide).alias("secs_norm"))
