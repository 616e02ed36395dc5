"""Selection of clips and voices. Clips have idx, corpus, speaker, dur, text and may have gender and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.keys import assigned, order_key
from corpusloom.functions.text import strip
from corpusloom.operators.ranks import ranked


def usable(clips: DataFrame, low: float = 2.5, high: float = 10.2, least_chars: int = 8, without: tuple[str, ...] = ()) -> DataFrame:
    """Clips of a named speaker with a duration in range and a text long enough."""
    kept = assigned(F.col("speaker")) & F.col("dur").between(low, high) & (F.length(strip(F.col("text"))) >= least_chars)
    return clips.filter(kept & ~F.col("corpus").isin(*without) if without else kept)


def cap_per_speaker(clips: DataFrame, most: int, least: int = 0, seed: int = 42) -> DataFrame:
    """The first ``most`` clips of each speaker by hash; speakers with fewer than ``least`` clips go."""
    voice = Window.partitionBy("corpus", "speaker")
    ranked = clips.withColumn("_n", F.count("*").over(voice)).withColumn("_r", F.row_number().over(voice.orderBy(order_key(seed, F.col("idx")))))
    return ranked.filter((F.col("_n") >= least) & (F.col("_r") <= most)).drop("_n", "_r")


def voices(clips: DataFrame) -> DataFrame:
    return clips.groupBy("corpus", "speaker").agg(F.count("*").alias("n_clips"), F.sum("dur").alias("seconds"), F.min("gender").alias("gender"))


def top_voices_by_gender(clips: DataFrame, most: int, least: int, seed: int = 42) -> DataFrame:
    """The first ``most`` voices of each gender by hash, of voices of a known gender with ``least`` clips."""
    some = voices(clips).filter(F.col("gender").isNotNull() & (F.col("n_clips") >= least))
    rank = F.row_number().over(Window.partitionBy("gender").orderBy(order_key(seed, "v", F.col("corpus"), F.col("speaker"))))
    return some.withColumn("rank", rank).filter(F.col("rank") <= most)


def balance_gender(clips: DataFrame, corpora: tuple[str, ...], seed: int = 42) -> DataFrame:
    """In each of ``corpora`` as many voices of either gender as the rarer has; unknown ones go; others stay whole."""
    rank = F.row_number().over(Window.partitionBy("corpus", "gender").orderBy(order_key(seed, "gen", F.col("corpus"), F.col("speaker"))))
    both = Window.partitionBy("corpus")
    least = F.least(*[F.count_if(F.col("gender") == g).over(both) for g in "FM"])
    some = voices(clips.filter(F.col("corpus").isin(*corpora))).filter("gender IS NOT NULL")
    some = some.withColumn("_rank", rank).withColumn("_least", least).filter("_rank <= _least").select("corpus", "speaker")
    return clips.filter(F.col("corpus").isin(*corpora)).join(some, ["corpus", "speaker"], "left_semi").unionByName(clips.filter(~F.col("corpus").isin(*corpora)))


def round_robin_budget(items: DataFrame, key: str, group: str, size: str, budget: float) -> DataFrame:
    """Items taken one per group and round, groups in order, until ``budget`` is reached; the one that reaches it stays.

    Only one row per round is summed in order, and then the rows of the one round in which the budget is reached, so no
    task orders all items.
    """
    ranked = items.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order_key(F.col(key)), key, size)))
    rounds = ranked.groupBy("turn").agg(F.sum(size).alias("_all"))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0.0))).filter(F.col("_before") < budget)
    rows = ranked.join(rounds.select("turn", "_before", "_all"), "turn")
    # in whole rounds every row is below the budget; the last one is decided row by row
    whole = rows.filter(F.col("_before") + F.col("_all") < budget)
    edge = rows.filter(F.col("_before") + F.col("_all") >= budget)
    inside = Window.partitionBy("turn").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0.0))).filter(F.col("_before") + F.col("_in") < budget).drop("_in")
    return whole.unionByName(edge).drop("_before", "_all")


def systematic_sample(items: DataFrame, group: str, order: list[Column], n: int, least: int = 1) -> DataFrame:
    """From each group k items at even steps of its order; k follows the square root of the group's size."""
    sizes = items.groupBy(group).agg(F.count("*").alias("_n"))
    roots = sizes.withColumn("_root", F.sum(F.sqrt("_n")).over(Window.partitionBy(F.lit(1))))
    quota = F.least(F.col("_n"), F.greatest(F.lit(least), F.bround(n * F.sqrt("_n") / F.col("_root")).cast("int")))
    placed = ranked(items, group, order, "_at")
    picks = roots.withColumn("_k", quota).select(group, "_n", "_k", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("pick"))
    at = F.floor(F.col("pick") * F.col("_n") / F.col("_k")).cast("int")
    return picks.select(group, "pick", at.alias("_at")).join(placed.drop("_size"), [group, "_at"]).drop("_at")


def evaluation_voices(clips: DataFrame, corpora: list[str], n: int, prompt: tuple[float, float] = (4.0, 9.0)) -> DataFrame:
    """One voice per corpus in turn, in the given order, until ``n``; with its first clip of prompt length."""
    ready = clips.filter(F.col("dur").between(*prompt))
    some = ready.groupBy("corpus", "speaker").agg(F.min("idx").alias("prompt"))
    place = F.create_map(*[x for i, c in enumerate(corpora) for x in (F.lit(c), F.lit(i))])
    some = some.withColumn("place", F.element_at(place, F.col("corpus"))).filter("place IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("corpus").orderBy("speaker"))
    return some.withColumn("turn", turn).orderBy("turn", "place").limit(n).select("corpus", "speaker", "prompt", "turn")


def middle_pick(clips: DataFrame, order: list[str]) -> DataFrame:
    """The middle clip of each corpus in the given order of columns."""
    return ranked(clips, "corpus", [F.col(c) for c in order], "_at").filter(F.col("_at") == F.floor(F.col("_size") / 2)).drop("_at", "_size")


def heldout_refs(clips: DataFrame, prompts: DataFrame, k: int = 3) -> DataFrame:
    """Per prompt (speaker, target, prompt): up to ``k`` other clips of the speaker, at even steps of their order by idx.

    A place among the clips without target and prompt is a place among all, moved on by those before it; so the clips
    are joined by (speaker, place) and never gathered.
    """
    placed = ranked(clips.select("speaker", "idx"), "speaker", [F.col("idx")], "_at")
    sizes = clips.groupBy("speaker").agg(F.count("*").alias("_size"))
    rows = prompts.join(sizes, "speaker")
    for name in ("target", "prompt"):
        rows = rows.join(placed.select("speaker", F.col("idx").alias(name), F.col("_at").alias(f"_{name}")), ["speaker", name], "left")
    same = F.col("target").eqNullSafe(F.col("prompt"))
    first = F.least("_target", F.when(~same, F.col("_prompt")))
    second = F.when(same, None).otherwise(F.when(F.col("_target").isNotNull() & F.col("_prompt").isNotNull(), F.greatest("_target", "_prompt")))
    left = F.col("_size") - F.when(F.col("_target").isNotNull(), 1).otherwise(0) - F.when(F.col("_prompt").isNotNull() & ~same, 1).otherwise(0)
    rows = rows.withColumn("_first", first).withColumn("_second", second).withColumn("_left", left).filter("_left > 0")
    rows = rows.withColumn("pick", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_left")).cast("int") - 1)))
    at = F.when(F.col("_left") <= k, F.col("pick")).otherwise(F.floor(F.col("pick") * (F.col("_left") / k))).cast("long")
    at = at + F.when(at >= F.coalesce("_first", F.col("_size")), 1).otherwise(0)
    at = at + F.when(at >= F.coalesce("_second", F.col("_size") + 1), 1).otherwise(0)
    rows = rows.withColumn("_at", at)
    return rows.join(placed.select("speaker", "_at", F.col("idx").alias("ref")), ["speaker", "_at"]).select("speaker", "target", "prompt", "pick", "ref")


def without_matches(rows: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose name holds none of the patterns; all rows without patterns."""
    return rows.filter(~F.coalesce(F.col(name).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))) if patterns else rows


def worst_first(rows: DataFrame, status: str, order: tuple[str, ...], value: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by status in the given order, then the smaller value, one without a value last, then key."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), F.coalesce(F.col(value), F.lit(float("inf"))), key).limit(n)


def candidates_by_gender(clips: DataFrame, most_voices: int, most_clips: int, least: int, order: str, seed: int = 42) -> DataFrame:
    """Clips of the first voices of each gender by hash: ``most_voices`` a gender, ``most_clips`` clips a voice.

    Only clips of a known gender count; a voice has the gender of its first clip in ``order``, and ``least`` clips or more.
    """
    known = clips.filter(F.col("gender").isNotNull())
    some = known.groupBy("corpus", "speaker").agg(F.count("*").alias("_n"), F.min_by("gender", order).alias("_g")).filter(F.col("_n") >= least)
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(order_key(seed, "v", F.col("corpus"), F.col("speaker"))))
    chosen = some.withColumn("_rank", rank).filter(F.col("_rank") <= most_voices).select("corpus", "speaker")
    return cap_per_speaker(known.join(chosen, ["corpus", "speaker"], "left_semi"), most_clips, 0, seed)


def heldout_clips(clips: DataFrame, voices: DataFrame, least: float = 3.0, most: int = 5) -> DataFrame:
    """(corpus, speaker, idx, at): clips of :func:`evaluation_voices` to hold their samples against.

    Of a voice's other clips of ``least`` seconds and more, in order, every ``n // most``-th, ``most`` at most.
    """
    own = clips.join(voices.select("corpus", "speaker", "prompt"), ["corpus", "speaker"]).filter((F.col("idx") != F.col("prompt")) & (F.col("dur") >= least))
    placed = ranked(own.withColumn("_voice", F.struct("corpus", "speaker")), "_voice", [F.col("idx")], "_at")
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / most))
    return placed.filter((F.col("_at") % step == 0) & (F.col("_at") < step * most)).select("corpus", "speaker", "idx", (F.col("_at") / step).cast("int").alias("at"))
