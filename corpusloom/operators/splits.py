"""Leak-free splits by group, and what is reported about them."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.keys import group_key, order_key, voice_key
from corpusloom.operators.ranks import ranked
from corpusloom.session import saved

SPLITS = ("train", "val", "test")


def with_groups(clips: DataFrame) -> DataFrame:
    group = F.col("group") if "group" in clips.columns else None
    return clips.withColumn("grp", group_key(F.col("corpus"), F.col("speaker"), group, F.col("idx").cast("string")))


def holdout_split(clips: DataFrame, n_val: int, n_test: int, least: int = 15, seed: int = 42) -> DataFrame:
    """``split`` of each clip: whole groups, by hash, of those with ``least`` clips go to val and test in each corpus."""
    rows = with_groups(clips)
    sizes = rows.groupBy("corpus", "grp").agg(F.count("*").alias("n"))
    order = Window.partitionBy("corpus").orderBy(order_key(seed, "hold", F.col("grp")))
    some = sizes.filter(F.col("n") >= least).withColumn("rank", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("corpus")))
    val = F.greatest(F.lit(0), F.least(F.lit(n_val), F.col("all") - 1))
    test = F.greatest(F.lit(0), F.least(F.lit(n_test), F.col("all") - val - 1))
    split = F.when(F.col("rank") <= val, "val").when(F.col("rank") <= val + test, "test").otherwise("train")
    return rows.join(some.select("corpus", "grp", split.alias("_split")), ["corpus", "grp"], "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def heldout_cap(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """In val and test only the first ``most`` clips of each voice by hash; the rest is in no split."""
    rank = F.row_number().over(Window.partitionBy("split", "corpus", "speaker").orderBy(order_key(seed, "cap", F.col("idx"))))
    return rows.withColumn("_r", rank).filter((F.col("split") == "train") | (F.col("_r") <= most)).drop("_r")


def split_summary(rows: DataFrame) -> DataFrame:
    """Per split and corpus, and per split over all (corpus _total): clips, hours, voices, groups.

    The total's hours are the sum of the corpora's rounded hours.
    """
    voice = voice_key(F.col("corpus"), F.col("speaker"), F.col("idx"))
    per = rows.groupBy("split", "corpus").agg(
        F.count("*").alias("clips"), F.bround(F.sum("dur") / 3600, 2).alias("hours"), F.count_distinct(voice).alias("voices"), F.count_distinct("grp").alias("groups")
    )
    total = per.groupBy("split").agg(F.sum("clips").alias("clips"), F.bround(F.sum("hours"), 2).alias("hours"), F.sum("voices").alias("voices"), F.sum("groups").alias("groups"))
    return per.unionByName(total.withColumn("corpus", F.lit("_total")))


def voice_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "corpus", "grp", "speaker").agg(F.count("*").alias("n_clips"), F.bround(F.sum("dur") / 3600, 4).alias("hours"))


def leak_audit(rows: DataFrame) -> DataFrame:
    """Groups and speakers that stand in more than one split."""
    parts = [
        rows.groupBy(F.concat_ws("/", *keys).alias("key")).agg(F.count_distinct("split").alias("splits"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("which")).filter("splits > 1").withColumn("kind", F.lit(kind))
        for kind, keys in (("group", ["grp"]), ("speaker", ["corpus", "speaker"]))
    ]
    return parts[0].unionByName(parts[1])


Stripe = tuple[int, int, int, tuple[int, ...]]


def _turn(have: list[int], n: int, goal: list[float], most: list[float]) -> tuple[int, ...]:
    """The splits that the next groups of size ``n`` go to, until one would come again."""
    have, turn = list(have), ()
    while True:
        room = [s for s in range(3) if have[s] + n <= most[s]]
        # the first of equals: train, then val, then test; train too where no split has room
        split = max(room, key=lambda s: (goal[s] - have[s], -s)) if room else 0
        if split in turn:
            return turn
        turn += (split,)
        have[split] += n


def _stripes(runs: list[tuple[int, int]], shares: tuple[float, float, float], tolerance: float) -> list[Stripe]:
    """(size, first, last, turn) of groups in order: ``runs`` are (size, number of groups of that size), largest first.

    Only the sizes decide, so groups of one size are told apart by their places alone. After a turn all its splits lack
    one group less, so the same turn follows until one has no room or another split lacks more, which never ends again:
    bisection finds how often it is repeated. A stripe is a turn and the places over which it repeats, and a size has a few
    of them however many groups it has.
    """
    total = sum(n * m for n, m in runs)
    goal = [share * total for share in shares]
    most = [g * (1 + tolerance) for g in goal]
    have, out = [0, 0, 0], []
    for n, m in runs:
        place = 0
        while place < m:
            turn = _turn(have, n, goal, most)[: m - place]
            times = (m - place) // len(turn)
            after = lambda k: [x + k * n * (s in turn) for s, x in enumerate(have)]  # noqa: B023, E731
            if times > 1:
                # the first k after which the turn is another one
                times = 1 + bisect.bisect_left(range(1, times), True, key=lambda k: _turn(after(k), n, goal, most) != turn)  # noqa: B023
            have = after(times)
            out.append((n, place, place + times * len(turn) - 1, turn))
            place += times * len(turn)
    for split in (1, 2):
        trained = sorted((n, first + turn.index(0), first, last, turn) for n, first, last, turn in out if 0 in turn)
        groups = sum((last - place) // len(turn) + 1 for _, place, _, last, turn in trained)
        if sum(m for _, m in runs) >= 3 and groups > 1 and all(split not in turn for *_, turn in out):
            n, place, first, last, turn = trained[0]
            out.remove((n, first, last, turn))
            cut = place - first
            parts = [(n, first, place - 1, turn[:cut]), (n, place, place, (split,)), (n, place + 1, last, (turn[cut + 1 :] + turn[: cut + 1])[: last - place])]
            out += [x for x in parts if x[1] <= x[2]]
    return out


def deficit_split(clips: DataFrame, shares: tuple[float, float, float] = (0.9, 0.05, 0.05), tolerance: float = 0.5, seed: int = 42) -> DataFrame:
    """(corpus, grp, n, split): largest groups first, each to the split that lacks most among those with room.

    Each choice depends on the sizes before it alone. So a task folds the counts of a corpus's group sizes, which are
    at most the root of twice its clips, in a few steps a size whatever the number of groups, and the groups find their
    split by size and place among equals, which Spark ranks. A corpus of three groups or more has no empty split: its smallest train groups fill val and test.
    """
    sizes = with_groups(clips).groupBy("corpus", "grp").agg(F.count("*").alias("n")).withColumn("tie", order_key(seed, F.col("grp")))
    sizes = saved(sizes.withColumn("kind", F.struct("corpus", "n")), clips.sparkSession)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ascending=False)
        found = _stripes(list(zip(part["n"].tolist(), part["m"].tolist(), strict=True)), shares, tolerance)
        return pd.DataFrame([(part["corpus"].iloc[0], n, a, z, [SPLITS[s] for s in turn]) for n, a, z, turn in found], columns=["corpus", "n", "a", "z", "turn"])

    stripes = sizes.groupBy("corpus", "n").agg(F.count("*").alias("m")).groupBy("corpus").applyInPandas(fold, "corpus string, n long, a long, z long, turn array<string>")
    placed = ranked(sizes, "kind", [F.col("tie")], "place")
    split = F.get("turn", ((F.col("place") - F.col("a")) % F.size("turn")).cast("int"))
    return placed.join(stripes, ["corpus", "n"]).filter(F.col("place").between(F.col("a"), F.col("z"))).select("corpus", "grp", "n", split.alias("split"))


def paired_holdout(clips: DataFrame, n_val: int, n_test: int, paired: tuple[str, ...], least: int = 15, seed: int = 42) -> DataFrame:
    """:func:`holdout_split` in which the corpora of ``paired`` hold out as many female as male groups.

    Their groups stand in the order F, M, F, M, ... by hash as far as both go, the others after them; a group's gender is
    that of its first clip. Ranks are taken over groups, a row each.
    """
    rows = with_groups(clips)
    sizes = rows.groupBy("corpus", "grp").agg(F.count("*").alias("n"), F.min_by("gender", "idx").alias("_g")).filter(F.col("n") >= least)
    hashed = order_key(seed, "hold", F.col("grp"))
    own = F.row_number().over(Window.partitionBy("corpus", "_g").orderBy(hashed))
    both = F.least(*[F.count_if(F.col("_g") == g).over(Window.partitionBy("corpus")) for g in "FM"])
    turn = F.when(F.col("corpus").isin(*paired) & F.col("_g").isin("F", "M") & (F.col("_own") <= F.col("_both")), F.col("_own"))
    some = sizes.withColumn("_own", own).withColumn("_both", both).withColumn("_turn", turn)
    order = Window.partitionBy("corpus").orderBy(F.col("_turn").asc_nulls_last(), F.when(F.col("_turn").isNotNull(), F.col("_g")), hashed)
    some = some.withColumn("_rank", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("corpus")))
    val = F.least(F.lit(n_val), F.greatest(F.lit(0), F.col("_all") - 1))
    test = F.least(F.lit(n_test), F.greatest(F.lit(0), F.col("_all") - val - 1))
    split = F.when(F.col("_rank") <= val, "val").when(F.col("_rank") <= val + test, "test").otherwise("train")
    return rows.join(some.select("corpus", "grp", split.alias("_split")), ["corpus", "grp"], "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def listed_stats(listed: DataFrame, clips: DataFrame) -> DataFrame:
    """(split, corpus, n, hours, groups) of a list (split, idx) of clips: per corpus, and ``_total``, whose ``n`` is the list's.

    A name in the list that no clip has counts in the total's ``n`` only.
    """
    rows = listed.join(with_groups(clips), "idx", "left")
    figures = [F.bround(F.coalesce(F.sum("dur"), F.lit(0.0)) / 3600, 3).alias("hours"), F.count_distinct("grp").alias("groups")]
    per = rows.filter("corpus IS NOT NULL").groupBy("split", "corpus").agg(F.count("*").alias("n"), *figures)
    total = rows.groupBy("split").agg(F.count("*").alias("n"), *figures)
    return per.unionByName(total.withColumn("corpus", F.lit("_total")))
