"""Properties of order-dependent operators on small inputs, against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from corpusloom.functions.keys import draw, gender, group_key
from corpusloom.functions.text import collapse, repetition_ratio
from corpusloom.operators import decoding, intervals, sampling, selection, splits
from corpusloom.operators.graph import components
from corpusloom.streaming.chunks import stream_chunks


def clips(spark, n_speakers=12, per=7, corpus=("a", "b")):
    rows = [Row(idx=f"{c}{s}-{i}", corpus=c, speaker=f"{c}:s{s}", dur=3.0 + i % 5, text="some spoken words", gender="FM"[s % 2]) for c in corpus for s in range(n_speakers) for i in range(per + s % 3)]
    return spark.createDataFrame(rows)


def test_split_has_no_leak_and_covers_all(spark):
    rows = splits.holdout_split(clips(spark), 2, 2, least=3)
    assert splits.leak_audit(rows).count() == 0
    assert rows.select("idx").distinct().count() == clips(spark).count()
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}


def test_deficit_split_matches_shares(spark):
    got = splits.deficit_split(clips(spark, 40))
    per = {(r["corpus"], r["split"]): r["n"] for r in got.groupBy("corpus", "split").agg(F.sum("n").alias("n")).collect()}
    for c in "ab":
        total = sum(n for (k, _), n in per.items() if k == c)
        assert per[c, "train"] / total > 0.8
        assert per[c, "val"] and per[c, "test"]


def test_reference_is_never_the_clip_itself(spark):
    for epoch in range(3):
        rows = sampling.pick_reference(clips(spark), epoch).collect()
        assert all(r["ref"] != r["idx"] and r["ref"].split("-")[0] == r["idx"].split("-")[0] for r in rows)


def test_single_clip_speaker_has_no_reference(spark):
    one = spark.createDataFrame([Row(idx="x", speaker="s", dur=3.0), Row(idx="y", speaker="t:99", dur=3.0), Row(idx="z", speaker="t:99", dur=3.0)])
    assert {r["ref"] for r in sampling.pick_reference(one, 1).collect()} == {None}


def test_mass_weights_sum_to_one_under_caps(spark):
    rows = splits.with_groups(clips(spark, 150, 3))
    got = sampling.mass_weights(rows, {"a": 3.0, "b": 1.0}, cap_voice=0.01, cap_group=0.02).collect()
    assert sum(r["mass"] for r in got) == pytest.approx(1)
    assert max(r["mass"] for r in got) <= 0.01 + 1e-9


def test_mix_follows_shares(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("idx"))
    got = {r["variant"]: r["count"] for r in sampling.conditions(rows, {"a": 0.75, "b": 0.25}, 0).groupBy("variant").count().collect()}
    assert got["a"] / 4000 == pytest.approx(0.75, abs=0.03)


def test_draw_is_uniform_and_stable(spark):
    u = [r[0] for r in spark.range(2000).select(draw(1, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and np.mean(u) == pytest.approx(0.5, abs=0.03)


def test_keys(spark):
    rows = spark.createDataFrame([("tagarela", "show:3", None), ("podcast", "x", "G1"), ("other", "a:b", "")], "corpus string, speaker string, grp string")
    got = [r[0] for r in rows.select(group_key(F.col("corpus"), F.col("speaker"), F.col("grp"))).collect()]
    assert got == ["tagarela/show", "podcast/G1", "other/a:b"]
    sexes = spark.createDataFrame([(" Female_feminine",), ("m",), ("x",), (None,)], "g string").select(gender(F.col("g"))).collect()
    assert [r[0] for r in sexes] == ["F", "M", None, None]


def test_round_robin_budget_equals_the_plain_loop(spark):
    rng = random.Random(3)
    items = [(f"i{k}", f"g{rng.randrange(6)}", float(rng.randrange(1, 9))) for k in range(120)]
    import hashlib

    for budget in (0.0, 1.0, 77.0, 10_000.0):
        groups = {}
        for key, group, size in sorted(items, key=lambda x: (hashlib.sha1(x[0].encode()).hexdigest(), x[0])):
            groups.setdefault(group, []).append((key, size))
        taken, total, turn = set(), 0.0, 0
        while total < budget and any(len(v) > turn for v in groups.values()):
            for g in sorted(groups):
                if total < budget and len(groups[g]) > turn:
                    taken.add(groups[g][turn][0])
                    total += groups[g][turn][1]
            turn += 1
        df = spark.createDataFrame(items, "key string, grp string, size double")
        assert {r["key"] for r in selection.round_robin_budget(df, "key", "grp", "size", budget).collect()} == taken


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randrange(4), i, s := rng.uniform(0, 500), s + rng.uniform(0, 90)) for i in range(n)]
    a, b = make(80), make(80)
    schema = "key int, id int, start double, stop double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumnRenamed("id", "other")
    got = {(r["id"], r["other"]) for r in intervals.overlap_join(left, right, "key", 5.0, width=40.0).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) - max(x[2], y[2]) >= 5.0}


def test_bounded_sessions(spark):
    rng = random.Random(8)
    rows = []
    for key in range(5):
        t = 0.0
        for _ in range(30):
            t += rng.uniform(0, 1.0)
            rows.append((key, t, t + rng.uniform(0.1, 2.0)))
    expected = []
    for key in range(5):
        own, last = [], None
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if own and s - last < 0.5 and e - own[-1][0] <= 5:
                own[-1][1], own[-1][2] = e, own[-1][2] + 1
            else:
                own.append([s, e, 1])
            last = e
        expected += [(key, *x) for x in own]
    got = intervals.bounded_sessions(spark.createDataFrame(rows, "key int, start double, stop double"), "key", 0.5, 5.0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_bounded_sessions_of_a_hot_key_over_many_parts(spark):
    """One long stretch, ties, nulls, ids beyond 2^53 and a key of nulls."""
    kinds = "key long, start double, stop double"
    hot = [(2**60 + 1, float(i // 2), i // 2 + 1.0) for i in range(4000)]
    odd = [(None, 0.0, 1.0), (None, 1.0, 2.0), (2**60, None, 1.0), (2**60, 1.0, None), (2**60, 1.5, 2.0), (2**60, 2.0, 3.0)]
    got = intervals.bounded_sessions(spark.createDataFrame(hot + odd, kinds).repartition(16), "key", 0.5, 100.0).collect()
    by_key = {k: [tuple(r)[1:] for r in got if r["key"] == k] for k in (None, 2**60, 2**60 + 1)}
    assert sorted(by_key[2**60 + 1]) == [(100.0 * i, 100.0 * i + 100, 200) for i in range(20)]
    assert by_key[None] == [(0.0, 2.0, 2)]
    assert set(by_key[2**60]) == {(None, 1.0, 1), (1.0, None, 1), (1.5, 3.0, 2)}
    assert intervals.bounded_sessions(spark.createDataFrame([], kinds), "key", 0.5, 5.0).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (40, 60), (1, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_long_chain_and_star(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1000, 1400).select(F.lit(999).cast("long").alias("u"), F.col("id").alias("v"))
    got = components(spark, chain.union(star)).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 301), (999, 401)]


def test_top_k_ties_and_nucleus(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([3.0, 2.0, 2.0, 1.0])], "k string, token int, score double")
    assert {r["token"] for r in decoding.top_k(rows, "k", 2).collect()} == {0, 1, 2}
    assert {r["token"] for r in decoding.top_k(rows, "k", 2, ties=False).collect()} == {0, 1}
    assert {r["token"] for r in decoding.nucleus(rows, "k", 0.0).collect()} == {0}


def test_text(spark):
    rows = spark.createDataFrame([("a b  c\n",), ("x y z x y z x",), (None,), ("",)], "t string")
    got = rows.select(collapse(F.col("t")).alias("c"), repetition_ratio(F.col("t")).alias("r")).collect()
    assert got[0]["c"] == "a b c"
    assert got[1]["r"] == pytest.approx(1 - 3 / 5)
    assert got[2]["r"] == got[3]["r"] == 0


def test_stream_gives_full_chunks(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("k")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    q = stream_chunks(stream, "k", 2, quiet=None).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted(map(tuple, spark.sql("SELECT k, chunk, frames FROM chunks").collect()))
    assert got == [(k, c, 2) for k in (0, 1) for c in (0, 1)]
