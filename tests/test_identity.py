"""The chain of clip statuses on planted clips, the whole purity run, and link thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import identity, purity
from corpusloom.operators.similarity import nearest_label


def unit(x):
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


SIZE = 24


def planted():
    """Clips of eight fates: (idx, tag, label, seconds, e, h1, h2, bleeds, fate)."""
    rng = np.random.default_rng(1)
    voice = np.eye(SIZE)
    said = lambda v, spread=0.08: unit(voice[v] + spread * rng.normal(size=SIZE)).tolist()
    rows = []

    def add(tag, label, v, fate, halves=True, bleeds=False, e=True, mixed=False):
        x = said(v)
        rows.append((len(rows), tag, f"{tag}:{label}", 5.0, x if e else None, x if halves and e else None, (said(v + 9) if mixed else said(v)) if halves and e else None, bleeds, fate))

    for tag in ("e1", "e2"):  # one person in two episodes
        for _ in range(14):
            add(tag, "a", 0, "kept")
    for _ in range(10):  # another, in the second episode only
        add("e2", "b", 1, "kept", halves=False)
    for _ in range(3):
        add("e1", "a", 0, "drop_fail", e=False)
        add("e1", "a", 0, "drop_bleed", bleeds=True)
        add("e2", "a", 0, "drop_mixed", mixed=True)
    add("e1", "a", 5, "drop_outlier")
    for _ in range(12):  # two voices under a label: a side of use, and a small one
        add("e3", "c", 2, "kept")
    for _ in range(5):
        add("e3", "c", 3, "drop_split")
    for _ in range(4):  # too few clips
        add("e4", "d", 4, "drop_small")
    for k in range(12):  # a label whose clips are alike, but not enough
        rows.append((len(rows), "e5", "e5:x", 5.0, unit(voice[6] + 1.3 * voice[10 + k]).tolist(), None, None, False, "drop_impure"))
    return rows


def test_clip_identities(spark):
    rows = planted()
    kind = "idx long, tag string, label string, seconds double, e array<double>, h1 array<double>, h2 array<double>, bleeds boolean, fate string"
    got = {r["idx"]: r for r in identity.clip_identities(spark.createDataFrame(rows, kind), SIZE, link=0.75, half=0.3).collect()}
    fates = {r[0]: r[-1] for r in rows}
    assert {i: r["status"] for i, r in got.items()} == fates
    assert set(fates.values()) == {"kept", "drop_fail", "drop_bleed", "drop_mixed", "drop_outlier", "drop_split", "drop_small", "drop_impure"}
    assert {r["speaker"] for i, r in got.items() if fates[i] != "kept"} == {"podcast:99"}
    who = {(r["tag"], r["label"][3:]): r["speaker"] for i, r in got.items() if fates[i] == "kept"}
    assert who == {("e1", "a"): "podcast:P001", ("e2", "a"): "podcast:P001", ("e3", "c"): "podcast:P002", ("e2", "b"): "podcast:P004"}
    assert {r["tag"]: r["grp"] for r in got.values()} == {"e1": "G001", "e2": "G001", "e3": "G002", "e4": "E_e4", "e5": "G003"}
    kept = identity.clip_identities(spark.createDataFrame(rows, kind), SIZE, link=0.75, half=0.3, keep_impure=True).filter("status = 'kept'")
    assert kept.count() == sum(f in ("kept", "drop_impure") for f in fates.values())


def test_purity_run_with_doubles(spark):
    rng = np.random.default_rng(2)
    voice = np.eye(SIZE)
    rows = []
    for label, v, split in (("a", 0, "train"), ("b", 0, "val"), ("c", 1, "train"), ("d", 2, ""), ("e", 2, "test"), ("f", 3, "train")):
        rows += [(len(rows) + i, label, split, unit(voice[v] + 0.05 * rng.normal(size=SIZE)).tolist()) for i in range(10)]
    verdicts, pairs = purity.purity_run(spark.createDataFrame(rows, "key long, label string, split string, e array<double>"), SIZE, "key", split="split")
    assert {(r["a"], r["b"]): r["cross_split"] for r in pairs.collect()} == {("a", "b"): True, ("d", "e"): False}
    got = {r["label"]: r for r in verdicts.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "SUSPEITO", "b": "SUSPEITO", "c": "OK", "d": "SUSPEITO", "e": "SUSPEITO", "f": "OK"}
    assert got["a"]["reasons"] == ["same voice as b, other split"]
    assert got["e"]["reasons"] == ["same voice as d"]
    assert (got["a"]["nearest"], got["d"]["nearest"]) == ("b", "e")
    assert got["c"]["reasons"] == [] and got["c"]["nearest_cosine"] < 0.5


def test_link_threshold_and_nearest(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(12, SIZE)) + 1.2)
    rows = [(k * 100 + i, f"l{k:02d}", unit(c + 0.05 * rng.normal(size=SIZE)).tolist()) for k, c in enumerate(centres) for i in range(6)]
    df = spark.createDataFrame(rows, "key long, label string, e array<double>").withColumn("x", F.lit(1))
    means = unit(np.array([np.mean([r[2] for r in rows if r[1] == f"l{k:02d}"], 0) for k in range(12)]))
    score = (means @ means.T)[np.triu_indices(12, 1)]
    assert identity.link_threshold(df, SIZE, floor=0.1) == pytest.approx(np.percentile(score, 99.9) + 0.03)
    assert identity.link_threshold(df, SIZE, floor=0.99) == 0.99
    assert identity.link_threshold(df.filter("label = 'l00'"), SIZE) == 0.75
    near = means @ means.T - 3 * np.eye(12)
    assert {r["a"]: r["nearest"] for r in nearest_label(df, SIZE).collect()} == {f"l{k:02d}": f"l{near[k].argmax():02d}" for k in range(12)}


def test_person_ids_beyond_a_thousand(spark):
    got = identity.person_ids(spark.range(1_200).select("id", (-F.col("id") % 7).cast("double").alias("m")).withColumnRenamed("id", "p"), "p", "m", "P").collect()
    assert sorted(r["id"] for r in got) == sorted(f"P{i:03d}" for i in range(1, 1_201))
