"""Windows over scored tokens (key, token, score) and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_k(rows: DataFrame, key: str, k: int, ties: bool = True) -> DataFrame:
    """Tokens of the k best scores of each key; with ``ties`` also those equal to the last of them."""
    by = Window.partitionBy(key).orderBy(F.desc("score"))
    rank = F.rank().over(by) if ties else F.row_number().over(by.orderBy(F.desc("score"), "token"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def nucleus(rows: DataFrame, key: str, p: float) -> DataFrame:
    """Tokens, best first, while the probability before them is at most p."""
    whole = Window.partitionBy(key)
    odds = rows.withColumn("_e", F.exp(F.col("score") - F.max("score").over(whole)))
    odds = odds.withColumn("prob", F.col("_e") / F.sum("_e").over(whole)).drop("_e")
    before = F.coalesce(F.sum("prob").over(whole.orderBy(F.desc("score"), "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return odds.withColumn("before", before).filter(F.col("before") <= p)


def penalise(rows: DataFrame, history: DataFrame, key: str, penalty: float) -> DataFrame:
    """Scores of tokens seen in the history are divided by the penalty if positive, else multiplied."""
    seen = history.select(key, "token").distinct().withColumn("_seen", F.lit(True))
    joined = rows.join(seen, [key, "token"], "left")
    return joined.withColumn("score", F.when(F.col("_seen"), F.when(F.col("score") > 0, F.col("score") / penalty).otherwise(F.col("score") * penalty)).otherwise(F.col("score"))).drop("_seen")


def guided(conditioned: DataFrame, plain: DataFrame, key: str, scale: float) -> DataFrame:
    """plain + scale * (conditioned - plain) for each token of both."""
    other = plain.select(key, "token", F.col("score").alias("_u"))
    return conditioned.join(other, [key, "token"]).withColumn("score", F.col("_u") + scale * (F.col("score") - F.col("_u"))).drop("_u")


def smallest_fitting(lengths: DataFrame, buckets: list[int]) -> DataFrame:
    """``bucket``: the smallest bucket that holds ``length``, or null."""
    fits = None
    for b in sorted(buckets):
        fits = F.when(F.col("length") <= b, b) if fits is None else fits.when(F.col("length") <= b, b)
    return lengths.withColumn("bucket", fits)


def left_padded(rows: DataFrame, group: str, tokens: str, pad: int) -> DataFrame:
    """Token arrays padded on the left to the longest of their group."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(group))
    return rows.withColumn("padded", F.concat(F.array_repeat(F.lit(pad), longest - F.size(tokens)), F.col(tokens)))


def closed_blocks(rows: DataFrame, key: str, order: list[str], kind: str, body: str, end: str) -> DataFrame:
    """(key, block, n): rows of kind ``body`` counted up to each ``end``; a block without an end is not given."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("block", F.coalesce(F.sum((F.col(kind) == end).cast("int")).over(by), F.lit(0)))
    counted = marked.groupBy(key, "block").agg(F.count_if(F.col(kind) == body).alias("n"), F.max((F.col(kind) == end).cast("int")).alias("closed"))
    return counted.filter("closed = 1").drop("closed")


# fixed values: labels of what is not learned, and of a frame of which only the first codebook is
IGNORED, FIRST_ONLY = -100, -101


def frame_labels(rows: DataFrame, key: str, order: list[str], kind: str, frame: str, end: str, policies: Column, codes: tuple[int, int]) -> DataFrame:
    """``rows`` with ``target``, what each position is to be learned as.

    ``policies`` is an array of ``train`` or ``first`` for the blocks of frames, each of which goes up to an ``end``;
    ``codes`` are the labels of a frame and of an end. Other positions are not learned. A frame outside the blocks that
    have a policy is an error.
    """
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.sum((F.col(kind) == end).cast("int")).over(by), F.lit(0)).cast("int")
    marked = rows.withColumn("_policy", F.get(policies, block))
    learned = F.when(F.col("_policy") == "train", codes[0]).when(F.col("_policy") == "first", FIRST_ONLY).otherwise(F.raise_error(F.lit("a block without a policy")).cast("int"))
    return marked.withColumn("target", F.when(F.col(kind) == frame, learned).when(F.col(kind) == end, codes[1]).otherwise(IGNORED)).drop("_policy")


def dual_guided(plain: DataFrame, reference: DataFrame, instructed: DataFrame, key: str, ref_scale: float, ins_scale: float) -> DataFrame:
    """plain + r * (reference - plain) + i * (instructed - plain) for each token of all three."""
    other = lambda rows, name: rows.select(key, "token", F.col("score").alias(name))
    rows = plain.join(other(reference, "_r"), [key, "token"]).join(other(instructed, "_i"), [key, "token"])
    u = F.col("score")
    return rows.withColumn("score", u + ref_scale * (F.col("_r") - u) + ins_scale * (F.col("_i") - u)).drop("_r", "_i")


# fixed value: the label of places that no loss counts
IGNORED = -100


def collated(rows: DataFrame, batch: str, tokens: str, labels: str, pad: int = 0) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` of one length a batch, filled on the left.

    The longest length of a batch is summed up by batch and joined, so no batch is gathered.
    """
    longest = rows.groupBy(batch).agg(F.max(F.size(tokens)).alias("_most"))
    out = rows.join(longest, batch)
    fill = lambda value: F.array_repeat(F.lit(value), F.col("_most") - F.size(tokens))
    seen = F.transform(F.col(tokens), lambda _: F.lit(1))
    filled = {"input_ids": F.concat(fill(pad), F.col(tokens)), "attention_mask": F.concat(fill(0), seen), "labels": F.concat(fill(IGNORED), F.col(labels))}
    return out.withColumns(filled).drop("_most")
