"""Best partners, average linkage and the two passes against plain models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clustering, partners


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "grp string, key long, v array<double>" + extra)


def unit(x):
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def clouds(rng, groups, n, dims, heads, spread):
    out = []
    for g in range(groups):
        centres = unit(rng.normal(size=(heads, dims)))
        v = unit(centres[rng.integers(heads, size=n)] + spread * rng.normal(size=(n, dims)))
        out += [(f"g{g}", 1_000 * g + i, x.tolist()) for i, x in enumerate(v)]
    return out


@pytest.mark.parametrize(("dims", "spread", "least"), [(3, 0.05, 0.99), (8, 0.3, 0.7), (16, 2.0, 0.3)])
def test_best_partners(spark, dims, spread, least):
    rows = clouds(np.random.default_rng(dims), 3, 120, dims, 6, spread) + [("one", 9_999, [1.0] * dims), ("z", 9_005, [0.0] * dims), ("z", 9_006, [1.0] * dims)]
    rows += [("g0", 7_000 + i, rows[0][2]) for i in range(3)]  # ties
    seen = []
    got = {r["key"]: (r["partner"], r["cosine"]) for r in partners.best_matches(frame(spark, rows), frame(spark, rows), least, apart=True, block=16, report=lambda *x: seen.append(x)).collect()}
    for g, k, v in rows:
        score = sorted((-round(float(np.dot(v, w)), 12), j) for h, j, w in rows if h == g and j != k)
        if score and -score[0][0] >= least:
            assert got[k][0] == score[0][1]
            assert got[k][1] == pytest.approx(-score[0][0])
        else:
            assert k not in got
    if dims == 3:
        # blocks far apart are never compared
        assert seen[0][1] < 0.7 * seen[0][0]


def test_best_partners_of_two_tables_with_places(spark):
    rng = np.random.default_rng(2)
    left = [(g, k, v, int(rng.integers(5))) for g, k, v in clouds(rng, 2, 40, 5, 3, 0.5)]
    right = [(g, k, v, int(rng.integers(8))) for g, k, v in clouds(rng, 2, 30, 5, 3, 0.5)]
    got = {r["key"]: r["partner"] for r in partners.best_matches(frame(spark, left, ", above long"), frame(spark, right, ", place long"), 0.2, block=8).collect()}
    for g, k, v, above in left:
        score = sorted((-np.dot(v, w), j) for h, j, w, place in right if h == g and place > above)
        assert got.get(k) == (score[0][1] if score and -score[0][0] >= 0.2 else None)
    assert partners.best_matches(frame(spark, []), frame(spark, []), 0.5).collect() == []


def plain_linkage(v, least):
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best, a, b = max((float(np.mean([np.dot(v[i], v[j]) for i in x for j in y])), -m, -n) for m, x in enumerate(groups) for n, y in enumerate(groups) if m < n)
        if best < least:
            break
        groups[-a] = sorted(groups[-a] + groups[-b])
        del groups[-b]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize(("spread", "least"), [(0.3, 0.7), (1.5, 0.3)])
def test_average_linkage(spark, spread, least):
    rows = clouds(np.random.default_rng(4), 2, 70, 6, 5, spread) + [("alone", 90_000, [1.0] + [0.0] * 5)]
    got = clustering.average_linkage(frame(spark, rows), least).collect()
    for g in {r[0] for r in rows}:
        keys, v = [r[1] for r in rows if r[0] == g], [np.array(r[2]) for r in rows if r[0] == g]
        found = {}
        for r in got:
            if r["grp"] == g:
                found.setdefault(r["cluster"], set()).add(r["key"])
        assert {frozenset(x) for x in found.values()} == {frozenset(keys[i] for i in x) for x in plain_linkage(v, least)}
        assert all(min(x) == c for c, x in found.items())


def test_names_of_clusters(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("b", 4, 4), ("c", 5, 5), ("c", 6, 5), ("c", 7, 7), ("c", 8, 7)]
    got = clustering.named_clusters(spark.createDataFrame(rows, "grp string, key long, cluster long")).collect()
    assert {r["key"]: r["speaker"] for r in got} == {1: "tag:a:000", 2: "tag:a:000", 3: "tag:a:99", 4: "tag:b:00", 5: "tag:c:001", 6: "tag:c:001", 7: "tag:c:002", 8: "tag:c:002"}


def plain_dissolved(spans, centres, keep, least):
    """One cluster at a time; spans are (key, v, seconds, cluster)."""
    own = {k: c for k, _, _, c in spans}
    alive = sorted({c for c in own.values()})
    while True:
        total = {c: sum(s for k, _, s, _ in spans if own[k] == c) for c in alive}
        small = [c for c in alive if total[c] < least]
        if not small or len(alive) <= 1:
            return own
        gone = min(small, key=lambda c: (total[c], c))
        alive.remove(gone)
        for k, v, _, _ in spans:
            if own[k] == gone:
                best = min((-np.dot(v, centres[c]), c) for c in alive)
                own[k] = best[1] if -best[0] >= keep else None


@pytest.mark.parametrize("seed", range(3))
def test_dissolving_is_as_one_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    rows, expected, heads = [], {}, []
    for g in ("x", "y"):
        centres = {c: unit(rng.normal(size=4)) for c in range(12)}
        spans = []
        for k in range(80):
            c = int(rng.integers(12)) if rng.random() < 0.7 else int(rng.integers(3))
            spans.append((len(rows) + k, unit(centres[c] + 0.6 * rng.normal(size=4)), float(rng.integers(20, 60)) / 10, c))
        expected |= plain_dissolved(spans, centres, 0.45, 30.0)
        rows += [(g, k, v.tolist(), s, c) for k, v, s, c in spans]
        heads += [(g, c, v.tolist()) for c, v in centres.items()]
    got = clustering.dissolved(frame(spark, rows, ", seconds double, cluster long"), spark.createDataFrame(heads, "grp string, cluster long, v array<double>"), 0.45, 30.0).collect()
    assert {r["key"]: r["cluster"] for r in got} == expected
    assert None in expected.values()


def test_two_passes(spark):
    e = np.eye(6)
    near = lambda i, j, w: unit(e[i] + w * e[j]).tolist()
    rows = [("ep", k, near(0, 1, 0.1 * (k % 3)), 10.0) for k in range(8)]  # 80 s of one voice
    rows += [("ep", 20 + k, near(2, 3, 0.1 * k), 30.0) for k in range(3)]  # 90 s of another
    rows += [("ep", 40, near(0, 4, 0.9), 5.0)]  # too little speech, near the first voice
    rows += [("ep", 41, e[5].tolist(), 5.0)]  # too little, near none: dropped
    rows += [("ep", 50, near(2, 0, 0.3), 1.0), ("ep", 51, e[5].tolist(), 1.0)]  # short: one inherits, one is near none
    rows += [("few", 60, e[0].tolist(), 3.0), ("few", 61, e[1].tolist(), 4.0), ("none", 70, e[0].tolist(), 1.0)]
    got = {r["key"]: r["speaker"] for r in clustering.two_pass(frame(spark, rows, ", seconds double"), 6).collect()}
    expected = {**{k: "SPEAKER_01" for k in range(8)}, **{20 + k: "SPEAKER_00" for k in range(3)}, 40: "SPEAKER_01", 50: "SPEAKER_00", 61: "SPEAKER_00"}
    assert got == expected
    assert clustering.two_pass(frame(spark, [], ", seconds double"), 6).collect() == []
    assert clustering.centroids(frame(spark, rows, ", seconds double").withColumn("cluster", F.lit(1)), 6).count() == 3


def test_average_linkage_compares_again_only_what_was_joined(spark, monkeypatch):
    rows = clouds(np.random.default_rng(4), 2, 70, 6, 5, 1.5)
    sizes, best = [], clustering.best_matches

    def counted(left, right, *args, **kwargs):
        sizes.append((left.count(), right.count()))
        return best(left, right, *args, **kwargs)

    monkeypatch.setattr(clustering, "best_matches", counted)
    clustering.average_linkage(frame(spark, rows), 0.3).collect()
    # later rounds leave out clusters that reach none, and do not compare those whose best one stayed
    assert len(sizes) > 3 and sum(a for a, _ in sizes[1:]) < sum(b for _, b in sizes[1:]) and sizes[-1][1] < 140


def test_average_linkage_keeps_rows_without_length_or_group(spark):
    rows = frame(spark, [("z", 1, [0.0, 0.0]), ("z", 2, [0.0, 0.0]), (None, 3, [1.0, 0.0]), ("a", 4, [1.0, 0.0]), ("a", 6, [1.0, 0.0]), ("a", 5, [1.0, 0.0])])
    assert sorted((r["key"], r["cluster"]) for r in clustering.average_linkage(rows, 0.5).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 4)]


def calls(monkeypatch):
    seen, best = [], clustering.best_matches
    monkeypatch.setattr(clustering, "best_matches", lambda *args, **kwargs: seen.append(1) or best(*args, **kwargs))
    return seen


def test_average_linkage_takes_equal_vectors_as_one(spark, monkeypatch):
    seen = calls(monkeypatch)
    v = unit(np.random.default_rng(1).normal(size=(3, 4)))
    rows = [("g", 10 * i + j, v[i].tolist()) for i in range(3) for j in range(9)] + [("h", 100, [0.0] * 4), ("h", 101, [0.0] * 4), (None, 102, v[0].tolist()), (None, 103, v[0].tolist())]
    got = {r["key"]: r["cluster"] for r in clustering.average_linkage(frame(spark, rows), 0.99).collect()}
    assert got == {k: (k // 10 * 10 if g == "g" else k) for g, k, _ in rows}
    assert len(seen) == 1


@pytest.mark.parametrize("most", [24, 4_096])
def test_average_linkage_of_a_crowd_takes_few_rounds(spark, monkeypatch, most):
    seen = calls(monkeypatch)
    rng = np.random.default_rng(3)
    middle = unit(rng.normal(size=8))
    v = np.concatenate([unit(middle + 0.03 * rng.normal(size=(70, 8))), unit(rng.normal(size=(30, 8)))])
    rows = [("crowd", i, x.tolist()) for i, x in enumerate(v)] + [("few", 200 + i, x.tolist()) for i, x in enumerate(v[60:80])]
    got = clustering.average_linkage(frame(spark, rows), 0.4, most).collect()
    for g, base in (("crowd", 0), ("few", 200)):
        own = np.array([x for h, _, x in rows if h == g])
        found = {}
        for r in got:
            if r["grp"] == g:
                found.setdefault(r["cluster"], set()).add(r["key"])
        assert {frozenset(x) for x in found.values()} == {frozenset(base + i for i in x) for x in plain_linkage(own, 0.4)}
        assert all(min(x) == c for c, x in found.items())
    # joining only each other's best takes 23 rounds
    assert len(seen) <= (0 if most > 100 else 9)


@pytest.mark.parametrize("most", [1, 16])
def test_dissolving_compares_spans_once_and_sums_exactly(spark, monkeypatch, most):
    seen, tiles = [], partners._tiles
    monkeypatch.setattr(partners, "_tiles", lambda *args: seen.append(1) or tiles(*args))
    rng = np.random.default_rng(5)
    centres = {c: unit(rng.normal(size=4)) for c in range(25)}
    spans = [(k, unit(centres[k % 25] + 0.6 * rng.normal(size=4)), float(rng.integers(20, 60)), k % 25) for k in range(150)]
    expected = plain_dissolved(spans, centres, 0.45, 320.0)
    # ten tenths are a second; a group whose last cluster stays, whatever it says
    spans += [(200 + k, centres[0], 0.1, 0) for k in range(10)] + [(300, centres[1], 0.1, 1), (301, centres[2], 0.2, 2), (302, -centres[2], 0.1, 1)]
    grp = lambda k: "ten" if 200 <= k < 300 else "last" if k >= 300 else "g"
    rows = [(grp(k), k, v.tolist(), s if k >= 200 else s / 320, c) for k, v, s, c in spans]
    heads = [(g, c, v.tolist()) for g in ("g", "ten", "last") for c, v in centres.items()]
    heads = spark.createDataFrame(heads, "grp string, cluster long, v array<double>")
    got = clustering.dissolved(frame(spark, rows, ", seconds double, cluster long"), heads, 0.45, 1.0, **({"most": most} if most != 16 else {})).collect()
    expected |= {200 + k: 0 for k in range(10)} | {300: 2 if np.dot(centres[1], centres[2]) >= 0.45 else None, 301: 2, 302: None}
    assert {r["key"]: r["cluster"] for r in got} == expected
    assert len({c for c in expected.values()}) > 2
    assert len(seen) == 1 if most == 16 else len(seen) < 4
