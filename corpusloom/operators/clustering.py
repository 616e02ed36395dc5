"""Clusterings of voices within an episode: average linkage, and the two passes of a diarisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.vectors import norm, unit
from corpusloom.operators.partners import ROOM, best_matches, blocked, near_lists, pivots, placed, runs_of
from corpusloom.operators.ranks import ranked
from corpusloom.session import saved

# fixed values: cosines and seconds of the clusterings
LINK, KEEP, LINK_SPANS = 0.70, 0.45, 0.55
LONG_SPAN, LEAST_SPEECH = 2.0, 60.0
#: Clusters of a group that a task may hold with all their cosines (128 MB); rows of a block, steps of a cosine.
MOST, WIDE, STEPS = 4_096, 16_384, 65_536
#: Centroids in the list of a span that may go to another cluster, at first.
LIST = 16


def _linked(key: np.ndarray, total: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Place of the cluster that each of some clusters, by ``key``, becomes part of; ``total`` and ``n`` are added up in place."""
    v = total / n[:, None]
    alive = np.isfinite(v).all(1)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    score[~alive] = -np.inf
    score[:, ~alive] = -np.inf
    best, value, to = score.argmax(1), score.max(1), np.arange(len(key))
    while True:
        i = np.flatnonzero(alive & (value >= least))
        a = i[(best[best[i]] == i) & (i < best[i])]
        if not len(a):
            break
        b = best[a]
        total[a] += total[b]
        n[a] += n[b]
        v[a] = total[a] / n[a, None]
        to[b], alive[b] = a, False
        score[b] = -np.inf
        score[:, b] = -np.inf
        new = v[a] @ v.T
        new[:, ~alive] = -np.inf
        # both halves alike, so that of two best pairs one is always each other's best
        both = np.maximum(new[:, a], new[:, a].T)
        np.fill_diagonal(both, -np.inf)
        new[:, a] = both
        score[a], score[:, a] = new, new.T
        moved = np.zeros(len(key), bool)
        moved[a] = moved[b] = True
        again = np.flatnonzero(alive & (value >= least) & (moved | moved[best]))
        best[again] = score[again].argmax(1)
        value[again] = score[again, best[again]]
    while (to[to] != to).any():
        to = to[to]
    return to


def linked_sets(sets: DataFrame) -> DataFrame:
    """(grp, key, to, sum, n, block) of clusters (grp, level, key, sum, n, block): those of a group joined down to its level.

    A cluster that became part of another has its key in ``to``; one that stayed has its own. A group is one task's work.
    """
    spark = sets.sparkSession
    kind = dict(sets.dtypes)["grp"]
    rows = sets.filter("grp IS NOT NULL").select("grp", "level", "key", "sum", "n", "block").repartition(4 * spark.sparkContext.defaultParallelism, "grp").sortWithinPartitions("grp", "key")

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        of = pa.Table.from_batches(held).combine_chunks()
        key, n = of.column(2).to_numpy(), of.column(4).to_numpy().copy()
        total = np.array(of.column(3).combine_chunks().flatten(), np.float64).reshape(len(key), -1)
        to = _linked(key, total, n, of.column(1)[0].as_py())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([of.column(0).combine_chunks(), pa.array(key), pa.array(key[to]), sums, pa.array(n), of.column(5).combine_chunks()], names=["grp", "key", "to", "sum", "n", "block"])

    return rows.mapInArrow(lambda batches: runs_of(batches, 1, one), f"grp {kind}, key long, to long, sum array<double>, n long, block int")


def levels(best: DataFrame, least: float, most: int) -> DataFrame:
    """(grp, step, level, whole): the clusters of a group whose best cosine is in ``step`` or above are ``most`` at most.

    All other clusters reach less than ``level`` with any, and so does what they or these become. ``whole``: they are all.
    """
    steps = best.groupBy("grp", F.floor(F.col("cosine") * STEPS).alias("step")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("grp")
    steps = steps.withColumn("_sum", F.sum("_n").over(by.orderBy(F.desc("step")))).withColumn("_all", F.sum("_n").over(by))
    out = steps.filter(F.col("_sum") <= most).groupBy("grp").agg(F.min("step").alias("step"), (F.max("_sum") == F.first("_all")).alias("whole"))
    return out.select("grp", "step", F.when(F.col("whole"), F.lit(least)).otherwise(F.greatest(F.lit(least), F.col("step") / STEPS + ROOM)).alias("level"), "whole")


def copies(rows: DataFrame) -> DataFrame:
    """(grp, v, key, n): the equal unit vectors of a group as one row with the smallest key; other rows as they are."""
    own = F.when(F.col("grp").isNotNull() & (F.abs(norm(F.col("v")) - 1) < 1e-6), F.lit(None)).otherwise(F.col("key"))
    return rows.groupBy("grp", "v", own.alias("_own")).agg(F.min("key").alias("key"), F.count("*").alias("n")).drop("_own")


def average_linkage(rows: DataFrame, least: float = LINK, most: int = 0) -> DataFrame:
    """(grp, key, cluster): unit vectors ``v`` of each group joined while the mean cosine of two clusters reaches ``least``.

    The mean cosine of two clusters is the product of their mean vectors, so a cluster is one row with a sum. In a round
    every two clusters that are each other's best become one. As joining two clusters never brings them nearer to a third
    than the nearer of them was, this gives the clusters that joining one best pair at a time gives. ``cluster`` is its
    smallest key; ties go to the smaller clusters.

    A cluster that reaches no other one never will and is left out of later rounds. In a round only what was joined, and
    what had a joined one as its best, is compared again: for the others no new cluster is nearer than its nearer part was.

    ``most`` is the number of clusters of a group that one task may hold. In each round the clusters with the greatest
    best cosines, as many as that at most, are joined in a task down to the level that no other cluster reaches; a group
    of so few clusters is done then. Else a crowd of near copies, whose middle is the best partner of all, takes a round
    for every few joins. Equal vectors are one row from the start, unless ``least`` is above their cosine.
    """
    spark = rows.sparkSession
    held = saved(rows.select("grp", F.col("key").cast("long").alias("key"), "v"), spark)
    alike = saved(copies(held) if least <= 1 else held.withColumn("n", F.lit(1).cast("long")), spark)
    rounds = []
    same = alike.filter("n > 1").select("grp", "v", F.col("key").alias("cluster"))
    if same.limit(1).count():
        rounds.append(saved(held.join(same, ["grp", "v"]).filter("key != cluster").select("grp", F.col("cluster").alias("key"), F.col("key").alias("partner")), spark))
    now = alike.withColumn("sum", F.transform("v", lambda x: x * F.col("n")))
    if most:
        # groups of few clusters need no partners
        few = now.groupBy("grp").agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select("grp")
        done = linked_sets(now.join(few, "grp").withColumn("level", F.lit(float(least))).withColumn("block", F.lit(0)))
        rounds.append(saved(done.filter("key != to").select("grp", F.col("to").alias("key"), F.col("key").alias("partner")), spark))
        now = saved(now.join(few, "grp", "left_anti"), spark)
    if not most or now.limit(1).count():
        rounds += _rounds(now, least, most)
    if not rounds:
        return held.select("grp", "key", F.col("key").alias("cluster"))
    # what a cluster became part of, over one, two, four, ... rounds
    up = saved(reduce(DataFrame.unionByName, rounds).select("grp", F.col("partner").alias("key"), F.col("key").alias("cluster")), spark)
    for _ in range(len(rounds).bit_length()):
        above = up.select("grp", F.col("key").alias("cluster"), F.col("cluster").alias("_to"))
        up = saved(up.join(above, ["grp", "cluster"], "left").select("grp", "key", F.coalesce("_to", "cluster").alias("cluster")), spark)
    return held.select("grp", "key").join(up, ["grp", "key"], "left").select("grp", "key", F.coalesce("cluster", "key").alias("cluster"))


def _rounds(now: DataFrame, least: float, most: int) -> list[DataFrame]:
    """(grp, key, partner) of each round: ``partner`` became part of ``key``."""
    spark = now.sparkSession
    around = saved(pivots(now), spark)
    now = saved(blocked(now, around, WIDE), spark)
    best = saved(best_matches(now, now, least, apart=True), spark)
    rounds = []
    while True:
        # b is a's best and a is b's
        back = best.select("grp", F.col("partner").alias("key"), F.col("key").alias("partner"))
        joined = best.select("grp", "key", "partner").join(back, ["grp", "key", "partner"]).filter("key < partner")
        if most:
            level = saved(levels(best, least, most), spark)
            at = best.join(F.broadcast(level), "grp").filter(F.floor(F.col("cosine") * STEPS) >= F.col("step")).select("grp", "key", "level")
            task = saved(linked_sets(now.join(at, ["grp", "key"])), spark)
            # both of a pair are left to the task, or none
            for side in ("key", "partner"):
                joined = joined.join(task.select("grp", F.col("key").alias(side)), ["grp", side], "left_anti")
            joined = joined.select("grp", "key", "partner").withColumn("_pair", F.lit(True))
            joined = joined.unionByName(task.filter("key != to").select("grp", F.col("to").alias("key"), F.col("key").alias("partner"), F.lit(False).alias("_pair")))
        else:
            joined = joined.withColumn("_pair", F.lit(True))
        joined = saved(joined, spark)
        if not joined.limit(1).count():
            return rounds
        rounds.append(joined.select("grp", "key", "partner"))
        if most:
            done = F.broadcast(level.filter("whole").select("grp"))
            now, best, joined, task = (x.join(done, "grp", "left_anti") for x in (now, best, joined, task))
        into = joined.select("grp", F.explode(F.array("key", "partner")).alias("key"), F.col("key").alias("_to"), "_pair").distinct()
        # two rows at most come together, but for those that a task has added up
        two = now.join(into.filter("_pair"), ["grp", "key"]).groupBy("grp", "_to").agg(F.collect_list("sum").alias("_vs"), F.sum("n").alias("n"), F.min_by("block", "key").alias("block"))
        total = two.select("grp", F.col("_to").alias("key"), F.zip_with(F.get("_vs", F.lit(0)), F.get("_vs", F.lit(1)), lambda a, b: a + b).alias("sum"), "n", "block")
        if most:
            total = total.unionByName(task.join(into.filter("NOT _pair AND key = _to").select("grp", "key"), ["grp", "key"]).select("grp", "key", "sum", "n", "block"))
        merged = placed(total.withColumn("v", F.transform("sum", lambda x: x / F.col("n"))), around)
        alone = now.join(best, ["grp", "key"], "left_semi").join(into, ["grp", "key"], "left_anti")
        now = saved(alone.unionByName(merged), spark)
        kept = best.join(into.select("grp", "key"), ["grp", "key"], "left_anti").join(into.select("grp", F.col("key").alias("partner")), ["grp", "partner"], "left_anti").select("grp", "key", "partner", "cosine")
        again = now.join(kept, ["grp", "key"], "left_anti")
        best = saved(kept.unionByName(best_matches(again, now, least, apart=True)), spark)


def named_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``speaker``: ``tag:<grp>:<number>``, ``:99`` where a cluster has one clip, ``:00`` where its group has.

    Numbers go on over all groups, by group and smallest key, three digits at least.
    """
    sizes = clusters.groupBy("grp", "cluster").agg(F.count("*").alias("_n"))
    real = ranked(sizes.filter("_n > 1").withColumn("_one", F.lit(1)), "_one", [F.col("grp"), F.col("cluster")], "_at")
    number = F.col("_at").cast("string")
    named = real.select("grp", "cluster", F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0").alias("_number"))
    alone = sizes.groupBy("grp").agg((F.sum("_n") == 1).alias("_alone"))
    out = clusters.join(alone, "grp").join(named, ["grp", "cluster"], "left")
    last = F.when(F.col("_alone"), "00").otherwise(F.coalesce("_number", F.lit("99")))
    return out.select("grp", "key", "cluster", F.concat(F.lit("tag:"), F.col("grp").cast("string"), F.lit(":"), last).alias("speaker"))


def _ticks() -> Column:
    """Seconds in whole 10^-9, so that sums depend on no order."""
    return F.round(F.col("seconds") * 1e9).cast("long")


def _seconds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("grp", "cluster").agg(F.sum(_ticks()).alias("total"))


def _moves(rows: DataFrame) -> DataFrame:
    """(grp, key, goal, time, host, ticks, ends) of spans (grp, key, ticks, cluster, time, goals): where each one goes.

    A cluster is dissolved at (its time, itself), never if the time is null. A span goes to the first of its goals that is
    there. A row with ``ends`` says where it stays (null: nowhere). The others say when, with the time and the cluster
    it leaves, it goes to a goal, or would if that goal were still there.
    """

    def one(cluster, time, goals):
        found, host, done = [], cluster, 0
        while time is not None:
            at = next((i for i, (goal, end) in enumerate(goals) if end is None or (end, goal) > (time, host)), len(goals))
            found += [(goal, time, host) for goal, _ in goals[done : at + 1] if goal != cluster]
            done = max(done, at + 1)
            if at == len(goals):
                return found, None
            host, time = goals[at]
        return found, host

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ends = [], []
            for i, (cluster, time, goals) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                found, host = one(cluster, time, [(g["goal"], g["end"]) for g in goals])
                out += [(i, *x, False) for x in found] + [(i, host, None, None, True)]
            at = pa.array([x[0] for x in out], pa.int64())
            grp, key, ticks = (batch.column(c).take(at) for c in range(3))
            goal, time, host = (pa.array([x[c] for x in out], pa.int64()) for c in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([grp, key, goal, time, host, ticks, pa.array([x[4] for x in out], pa.bool_())], names=["grp", "key", "goal", "time", "host", "ticks", "ends"])

    return rows.select("grp", "key", "ticks", "cluster", "time", "goals").mapInArrow(run, f"grp {dict(rows.dtypes)['grp']}, key long, goal long, time long, host long, ticks long, ends boolean")


def _times(moves: DataFrame, small: DataFrame, bound: int) -> DataFrame:
    """(grp, cluster, time) of the clusters (grp, cluster, base, alone): when each one is dissolved, if others are when ``moves`` says.

    That is as soon as its seconds are less than the next time at which it gets some. A null time is never.
    """
    got = moves.filter("NOT ends").groupBy("grp", F.col("goal").alias("cluster"), "time", "host").agg(F.sum("ticks").alias("_t"))
    by = Window.partitionBy("grp", "cluster").orderBy("time", "host").rowsBetween(Window.unboundedPreceding, -1)
    got = got.join(small, ["grp", "cluster"]).withColumn("_before", F.col("base") + F.coalesce(F.sum("_t").over(by), F.lit(0)))
    stop = (F.col("time") > F.col("_before")) | ((F.col("time") == F.col("_before")) & (F.col("host") > F.col("cluster")))
    ends = got.groupBy("grp", "cluster").agg(F.coalesce(F.min(F.when(stop, F.col("_before"))), F.first("base") + F.sum("_t")).alias("_end"))
    out = small.join(ends, ["grp", "cluster"], "left").withColumn("_end", F.coalesce("_end", "base"))
    out = out.withColumn("time", F.when(F.col("_end") < bound, F.col("_end"))).select("grp", "cluster", "time", "alone")
    # the last cluster of a group stays
    last = out.filter("alone").groupBy("grp").agg(F.max(F.struct("time", "cluster"))["cluster"].alias("_last"), F.count_if(F.col("time").isNull()).alias("_stay")).filter("_stay = 0")
    out = out.join(last.select("grp", "_last"), "grp", "left")
    return out.select("grp", "cluster", F.when(F.col("_last").isNull() | (F.col("_last") != F.col("cluster")), F.col("time")).alias("time"))


def dissolved(spans: DataFrame, centroids: DataFrame, keep: float = KEEP, least_speech: float = LEAST_SPEECH, most: int = LIST) -> DataFrame:
    """``spans`` (grp, key, v, seconds, cluster) after clusters of too little speech are dissolved, the smallest first.

    A span of a dissolved cluster goes to the nearest centroid that is left, if its cosine reaches ``keep``, else its
    ``cluster`` becomes null. The last cluster of a group stays. ``centroids`` (grp, cluster, v) do not move. Ties go to
    the smaller cluster. Seconds count in whole 10^-9.

    Spans of small clusters are compared with the centroids once, for lists of the ``most`` nearest; where a span needs
    more, lists get longer. A cluster is dissolved at the seconds that it has then, so what it gets later counts for
    nothing. Rounds find these times from those of the round before until none changes. The earliest time not yet right
    gets right in each round, and many others do at once; so times that do not change are those of one at a time.
    """
    spark = spans.sparkSession
    now = saved(spans.select("grp", "key", "v", "seconds", "cluster"), spark)
    bound = round(least_speech * 1e9)
    total = saved(_seconds(now.filter("cluster IS NOT NULL")), spark)
    large = total.filter(F.col("total") >= bound)
    small = total.filter(F.col("total") < bound).select("grp", "cluster", F.col("total").alias("base"))
    small = saved(small.join(large.select("grp").distinct().withColumn("_large", F.lit(True)), "grp", "left").withColumn("alone", F.col("_large").isNull()).drop("_large"), spark)
    if not small.limit(1).count():
        return now
    own = saved(now.join(small.select("grp", "cluster"), ["grp", "cluster"]).select("grp", F.col("key").cast("long").alias("key"), "v", _ticks().alias("ticks"), F.col("cluster").cast("long").alias("cluster")), spark)
    goals = centroids.join(total.select("grp", "cluster"), ["grp", "cluster"]).select("grp", F.col("cluster").alias("key"), "v")
    known = large.select("grp", F.col("cluster").alias("goal"), F.lit(True).alias("_large"))
    while True:
        # no list goes on after a cluster that always stays
        lists = near_lists(own, goals, keep, most).select("grp", "key", (F.size("partners") == most).alias("open"), F.posexplode("partners").alias("place", "goal"))
        lists = lists.join(known, ["grp", "goal"], "left").withColumn("_end", F.min(F.when(F.col("_large"), F.col("place"))).over(Window.partitionBy("grp", "key")))
        lists = lists.filter(F.col("_end").isNull() | (F.col("place") <= F.col("_end"))).withColumn("open", F.col("open") & F.col("_end").isNull())
        steps = saved(own.drop("v").join(lists.select("grp", "key", "open", "place", "goal"), ["grp", "key"], "left"), spark)
        times = small.select("grp", "cluster", F.col("base").alias("time"))
        while True:
            end = times.select("grp", F.col("cluster").alias("goal"), F.col("time").alias("end"))
            each = steps.join(times, ["grp", "cluster"]).join(end, ["grp", "goal"], "left")
            goal = F.collect_list(F.when(F.col("goal").isNotNull(), F.struct("place", "goal", "end")))
            rows = each.groupBy("grp", "key", "ticks", "cluster", "time").agg(F.sort_array(goal).alias("goals"))
            moves = saved(_moves(rows), spark)
            after = saved(_times(moves, small, bound), spark)
            if not after.join(times.withColumnRenamed("time", "_was"), ["grp", "cluster"]).filter(~F.col("time").eqNullSafe(F.col("_was"))).limit(1).count():
                break
            times = after
        stays = moves.filter("ends").select("grp", "key", F.col("goal").alias("_to"))
        short = steps.filter("open").select("grp", "key").join(stays.filter("_to IS NULL"), ["grp", "key"])
        if not short.limit(1).count():
            break
        most *= 8
    moved = now.join(stays.withColumn("_own", F.lit(True)), ["grp", "key"], "left")
    return moved.select("grp", "key", "v", "seconds", F.when(F.col("_own"), F.col("_to")).otherwise(F.col("cluster")).alias("cluster"))


def centroids(spans: DataFrame, size: int) -> DataFrame:
    """(grp, cluster, v): the mean direction of each cluster, summed on the map side."""
    total = F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(size)])
    return spans.groupBy("grp", "cluster").agg(total.alias("_t")).select("grp", "cluster", unit(F.col("_t")).alias("v"))


def nearest_centroid(spans: DataFrame, centres: DataFrame, keep: float = KEEP) -> DataFrame:
    """(grp, key, cluster, cosine) of the spans whose nearest centroid reaches ``keep``."""
    found = best_matches(spans.select("grp", "key", "v"), centres.select("grp", F.col("cluster").alias("key"), "v"), keep)
    return found.select("grp", "key", F.col("partner").alias("cluster"), "cosine")


def two_pass(spans: DataFrame, size: int, link: float = LINK_SPANS, keep: float = KEEP, long: float = LONG_SPAN, least_speech: float = LEAST_SPEECH) -> DataFrame:
    """(grp, key, cluster, speaker) of spans (grp, key, v, seconds): who speaks in each span of an episode.

    Spans of ``long`` seconds and more are clustered by average linkage, clusters of under ``least_speech`` seconds are
    dissolved into the nearest one, and shorter spans then go to the nearest centroid. Spans that are near to none have
    no row, nor has a group without a long span. Speakers are SPEAKER_00, ... by their long spans' time, longest first,
    ties to the smaller cluster.
    """
    spark = spans.sparkSession
    own = saved(spans.select("grp", F.col("key").cast("long").alias("key"), "v", "seconds"), spark)
    first = own.filter(F.col("seconds") >= long)
    linked = first.join(average_linkage(first, link, MOST), ["grp", "key"])
    centres = saved(centroids(linked, size), spark)
    kept = dissolved(linked, centres, keep, least_speech).filter("cluster IS NOT NULL")
    order = _seconds(kept).withColumn("_at", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("total"), "cluster")) - 1)
    number = F.col("_at").cast("string")
    names = saved(order.select("grp", "cluster", F.concat(F.lit("SPEAKER_"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), "0")).alias("speaker")), spark)
    short = nearest_centroid(own.filter(F.col("seconds") < long), centres.join(names, ["grp", "cluster"]), keep)
    return kept.select("grp", "key", "cluster").unionByName(short.select("grp", "key", "cluster")).join(names, ["grp", "cluster"]).select("grp", "key", "cluster", "speaker")
