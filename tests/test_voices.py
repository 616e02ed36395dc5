"""Two voices under one label, refinement, linkage and draws against plain models."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import decoding, purity, sampling
from corpusloom.operators.linkage import complete_linkage

DIM = 16


def cloud(rng, centre, n, noise=0.15):
    x = centre + noise * rng.normal(size=(n, DIM))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def labelled(spark):
    """Label 1 is one voice of 20, label 2 two of 12 and 10, label 3 one of 19 with an intruder, label 4 a single vector, label 5 two of 9 and 3."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    parts = [(1, cloud(rng, axes[0], 20)), (2, cloud(rng, axes[1], 12)), (2, cloud(rng, axes[2], 10)), (3, cloud(rng, axes[3], 19)), (3, cloud(rng, axes[4], 1)), (4, cloud(rng, axes[5], 1)), (5, cloud(rng, axes[6], 9)), (5, cloud(rng, axes[7], 3))]
    rows, i = [], 0
    for label, x in parts:
        for v in x:
            rows.append((i, label, [float(a) for a in v]))
            i += 1
    return rows, spark.createDataFrame(rows, "id long, label int, e array<double>")


def test_two_voices(spark):
    rows, df = labelled(spark)
    sided = purity.two_means(df, DIM, "id").collect()
    assert len(sided) == len(rows)
    side = {r["id"]: r["side"] for r in sided}
    two = [r[0] for r in rows if r[1] == 2]
    assert len({side[i] for i in two[:12]}) == len({side[i] for i in two[12:]}) == 1 and side[two[0]] != side[two[-1]]
    voices = purity.two_voices(purity.two_means(df, DIM, "id"), DIM)
    got = {r["label"]: r for r in voices.collect()}
    assert {k for k, r in got.items() if r["two_voices"]} == {2, 5}
    for label, r in got.items():
        a, b = (np.array([v for i, k, v in rows if k == label and side[i] == s]) for s in (0, 1))
        assert (r["n0"], r["n1"]) == (len(a), len(b))
        if len(a) and len(b):
            assert r["across"] == pytest.approx((a @ b.T).mean())
            assert r["inter"] == pytest.approx(float(a.sum(0) @ b.sum(0) / np.linalg.norm(a.sum(0)) / np.linalg.norm(b.sum(0))))
        if len(a) > 1:
            assert r["intra0"] == pytest.approx(((a @ a.T).sum() - len(a)) / (len(a) * (len(a) - 1)))
    verdicts = {r["label"]: r for r in purity.voice_verdicts(purity.label_verdicts(df, DIM), voices).collect()}
    assert (verdicts[1]["status"], verdicts[2]["status"], verdicts[4]["status"]) == ("OK", "RUIM", "POUCOS")
    assert "two voices" in verdicts[2]["reasons"] and verdicts[1]["reasons"] == [] and verdicts[4]["reasons"] == ["few"]


def test_refined_labels(spark):
    rows, df = labelled(spark)
    got = {r["id"]: (r["refined"], r["why"]) for r in purity.refined_labels(df, DIM, "id").collect()}
    assert len(got) == len(rows)
    by = {k: Counter(got[i] for i, label, _ in rows if label == k) for k in range(1, 6)}
    assert by[1] == {("1", None): 20}
    assert sorted(by[2].values()) == [10, 12] and {x for x, _ in by[2]} == {"2#a", "2#b"}
    assert by[3] == {("3", None): 19, (None, "outlier"): 1}
    assert by[4] == {("4", None): 1}
    assert by[5][None, "small side"] == 3 and sum(n for (x, _), n in by[5].items() if x) == 9
    assert purity.refined_labels(df.limit(0), DIM, "id").count() == 0


def test_doubled_labels(spark):
    rows, df = labelled(spark)
    again = df.filter("label = 1").withColumn("label", F.lit(9))
    assert [(r["a"], r["b"]) for r in purity.doubled_labels(df.unionByName(again), DIM).collect()] == [(1, 9)]


def greedy(n, sims, least):
    groups = {i: [i] for i in range(n)}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    s = min(sims.get((min(i, j), max(i, j)), -1) for i in groups[a] for j in groups[b])
                    if s >= least and (best is None or s > best[0]):
                        best = s, a, b
        if not best:
            return {i: min(g) for g in groups.values() for i in g}
        groups[best[1]] += groups.pop(best[2])


def test_complete_linkage(spark):
    rng = random.Random(8)
    for n, share in ((24, 0.5), (24, 0.9), (6, 0.0)):
        sims = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < share}
        pairs = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items() if s >= 0.2], "a int, b int, cosine double")
        got = {r["node"]: r["cluster"] for r in complete_linkage(spark.createDataFrame([(i,) for i in range(n)], "node int"), pairs, "node").collect()}
        assert got == greedy(n, sims, 0.2)


def test_weighted_draws(spark):
    weights = {"a": 0, "b": 1, "c": 700, "d": None, "e": 299, "f": -3}
    df = spark.createDataFrame(list(weights.items()), "k string, w int")
    got = sampling.weighted_draws(df, "k", "w", 2000).collect()
    assert sorted(r["draw"] for r in got) == list(range(2000))
    n = Counter(r["k"] for r in got)
    assert set(n) <= {"b", "c", "e"} and abs(n["c"] / 2000 - 0.7) < 0.05
    assert sampling.weighted_draws(df.limit(0), "k", "w", 5).count() == 0


def test_truncated_words(spark):
    cases = [
        ("one two. three four five six", 0.9, "one two"), ("one two, three four five six", 0.7, "one two"), ("one two, three", 1.0, "one two, three"),
        ("a b c d e f", 0.1, "a b c d"), ("a.b c d e f g h", 0.5, "a.b c d e"), ("end here.", 1.0, "end here"), ("", 0.5, ""), (None, 0.5, ""), ("  \n ", 1.0, ""),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s double")
    got = {r["i"]: r["x"] for r in df.select("i", tx.truncated_words(F.col("t"), F.col("s")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, _, x in cases]


def test_frame_labels(spark):
    kinds = "t t f f e t f e t".split()
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "key int, at int, kind string")
    run = lambda *p: [r["target"] for r in decoding.frame_labels(df, "key", ["at"], "kind", "f", "e", F.array(*map(F.lit, p)), (7, 8)).orderBy("at").collect()]
    assert run("first", "train") == [-100, -100, -101, -101, 8, -100, 7, 8, -100]
    with pytest.raises(Exception, match="without a policy"):
        run("first")
