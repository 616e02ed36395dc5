"""What SQL cannot say, against plain models: edits, blocks, ranks, splits, masses, components."""

import hashlib
import html
import random
import statistics
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import signals, text as tx
from corpusloom.operators import evaluation, gates, sampling, splits
from corpusloom.operators.ranks import quantiles, ranked
from corpusloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def pairs(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "dd", "ée", "漢"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(9))), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(150)]
    rows += [("", ""), ("a", ""), ("", "b c"), ("x  y\tz", "x y z"), ("a b", "b a")]
    return rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ref string, hyp string")


def test_edit_operations_and_distances(spark):
    rows, df = pairs(spark)
    df = df.select("i", tx.edit_operations("ref", "hyp").alias("e"), tx.word_distance(F.col("ref"), F.col("hyp")).alias("d"), tx.character_error_rate(F.col("ref"), F.col("hyp")).alias("cer"))
    for r in df.collect():
        a, b = (x.split() for x in rows[r["i"]])
        e = r["e"]
        assert e["substitutions"] + e["deletions"] + e["insertions"] == r["d"] == distance(a, b)
        assert len(a) - e["deletions"] + e["insertions"] == len(b)
        x, y = (t.replace(" ", "") for t in rows[r["i"]])
        assert r["cer"] == pytest.approx(distance(x, y) / max(1, len(x)))
    swap = df.filter("i = 154").first()["e"]
    assert (swap["substitutions"], swap["deletions"], swap["insertions"]) == (2, 0, 0)


def test_sentences(spark):
    cases = {
        "One. Two! Three? ": ["One.", "Two!", "Three?"], "Sr. Silva saiu. Fim": ["Sr. Silva saiu.", "Fim"], "J. K. L. Prado veio… ok": ["J. K. L. Prado veio…", "ok"],
        "pág. 3; fim": ["pág. 3;", "fim"], "são. Sim": ["são.", "Sim"], "": [], "  ": [], "abc.def ghi": ["abc.def ghi"],
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.sentences(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_blocks():
    words = lambda n, mark="w": [f"{mark}{i}" for i in range(n)]
    assert tx.packed([], 10) == []
    assert tx.packed([words(6), words(5)], 10) == [words(6) + words(5)]
    assert tx.packed([words(8), words(6)], 10) == [words(8), words(6)]
    # short ones join the next block, the last one the block before
    assert tx.packed([words(2), words(11)], 10) == [words(2) + words(11)]
    assert tx.packed([words(10), words(3)], 10) == [words(10) + words(3)]
    # a long sentence is cut at commas, then by words
    long = [*words(6)[:-1], "w5,", *words(25, "x")]
    assert tx.packed([long], 10) == [[*words(5), "w5,"], words(25, "x")[:10], words(25, "x")[10:20], words(25, "x")[20:]]
    rng = random.Random(3)
    for _ in range(200):
        told = [[f"{k}.{i}" for i in range(rng.randrange(1, 40))] for k in range(rng.randrange(8))]
        blocks = tx.packed(told, 12)
        assert [w for b in blocks for w in b] == [w for s in told for w in s]
        assert all(len(b) >= 5 for b in blocks[1:])


def test_text_functions(spark):
    t = spark.createDataFrame([("a &amp; b\n&lt;c&gt;", "Olá, mundo-novo_x!  2"), (None, None)], "h string, t string")
    got = t.select(tx.html_unescaped("h").alias("h"), tx.comparable(F.col("t")).alias("c"), tx.episode_tag(F.lit("x [abc].wav")).alias("a"), tx.episode_tag(F.lit("a b-c.wav")).alias("b")).collect()
    assert got[0] == ("a & b\n<c>", "olá mundo novo x 2", "abc", "a_b_c_wav")
    assert got[1][:2] == (None, None)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in catalog.QUERIES["unescaped_pages"](spark, DATA).collect()}
    assert got == {i: " ".join(html.unescape(x).split()) for i, x in pages.items()}


def test_ranks_and_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    whole = defaultdict(list)
    for g, x in rows:
        whole[g].append(x)
    got = defaultdict(dict)
    for r in ranked(df, "g", [F.col("x")], "at").collect():
        assert r["_size"] == len(whole[r["g"]])
        got[r["g"]][r["at"]] = r["x"]
    assert {g: [v[i] for i in range(len(v))] for g, v in got.items()} == {g: sorted(v) for g, v in whole.items()}
    for r in quantiles(df, "g", "x", {"m": 0.5, "p": 0.999, "q": 0.01}).collect():
        v = whole[r["g"]]
        cuts = statistics.quantiles(v, n=1000, method="inclusive")
        assert (r["m"], r["p"], r["q"]) == pytest.approx((statistics.median(v), cuts[998], cuts[9]))
    assert ranked(df.limit(0), "g", [F.col("x")], "at").count() == 0
    assert evaluation.summary(df.limit(0), ["g"], "x").count() == 0


def test_signs_are_one_character_each(spark):
    n = tx.MOST_SIGNS
    got = spark.range(n).select(tx.sign(F.col("id")).alias("s")).agg(F.count_distinct("s"), F.min(F.length("s")), F.max(F.length("s"))).first()
    assert tuple(got) == (n, 1, 1)
    far = spark.range(1).select(F.levenshtein(F.concat(*[tx.sign(F.lit(i)) for i in (0, 54_999, 55_000, 60_000, n - 1)]), F.concat(*[tx.sign(F.lit(i)) for i in (0, 55_000, 60_001, n - 1)])))
    assert far.first()[0] == 2
    long = " ".join(f"w{i}" for i in range(3000))
    pair = spark.createDataFrame([(long, long.replace("w7 ", "").replace("w2000", "x"))], "a string, b string")
    assert pair.select(tx.word_distance(F.col("a"), F.col("b"))).first()[0] == 2


def plain_split(sizes, shares=(0.9, 0.05, 0.05), tolerance=0.5):
    """The rule group by group: (n, tie) -> split."""
    names, order = ("train", "val", "test"), sorted(sizes, key=lambda g: (-g[0], g[1]))
    total, have, out = sum(n for n, _ in order), Counter(), {}
    for g in order:
        best = None
        for name, share in zip(names, shares):
            if have[name] + g[0] <= share * total * (1 + tolerance) and (best is None or share * total - have[name] > best[0]):
                best = share * total - have[name], name
        out[g] = best[1] if best else "train"
        have[out[g]] += g[0]
    for name in names[1:]:
        own = sorted(g for g in order if out[g] == "train")
        if len(order) >= 3 and name not in out.values() and len(own) > 1:
            out[own[0]] = name
    return out


def test_stripes_equal_the_rule():
    rng = random.Random(4)
    shares = [(0.9, 0.05, 0.05), (0.8, 0.1, 0.1), (0.5, 0.3, 0.2), (0.98, 0.01, 0.01)]
    for case in range(1500):
        share, tolerance = shares[case % 4], (0.5, 0.0, 0.1)[case % 3]
        kinds, groups = rng.choice([1, 2, 5, 60]), rng.choice([1, 2, 3, 7, 40, 150])
        sizes = [rng.randrange(1, kinds + 1) * rng.choice([1, 1, 1, 7]) for _ in range(groups)]
        runs = sorted(Counter(sizes).items(), reverse=True)
        got, names = {}, ("train", "val", "test")
        for n, first, last, turn in splits._stripes(runs, share, tolerance):
            for place in range(first, last + 1):
                assert (n, place) not in got
                got[n, place] = names[turn[(place - first) % len(turn)]]
        assert got == plain_split([(n, i) for n, m in runs for i in range(m)], share, tolerance), (runs, share, tolerance)
    many = splits._stripes([(3, 10**9), (2, 10**10), (1, 10**9)], shares[0], 0.5)
    assert len(many) < 30 and sum(last - first + 1 for _, first, last, _ in many) == 12 * 10**9


@pytest.mark.parametrize("kinds", [3, 40, 2])
def test_deficit_split_equals_the_rule(spark, kinds):
    rng = random.Random(kinds)
    rows, corpora = [], {"a": 70, "b": 3, "c": 1}
    for corpus, groups in corpora.items():
        for g in range(groups):
            rows += [(f"{corpus}{g}-{i}", corpus, f"s{g}") for i in range(rng.randrange(1, kinds + 1))]
    got = splits.deficit_split(spark.createDataFrame(rows, "idx string, corpus string, speaker string")).collect()
    sizes = Counter(f"{c}/{s}" for _, c, s in rows)
    for corpus in corpora:
        own = {(n, hashlib.sha1(f"42|{g}".encode()).hexdigest()): g for g, n in sizes.items() if g.startswith(corpus + "/")}
        expected = {own[k]: s for k, s in plain_split(list(own)).items()}
        assert {r["grp"]: r["split"] for r in got if r["corpus"] == corpus} == expected


def test_mass_weights_equal_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(f"{c}{v}-{i}", c, f"v{v}", f"{c}/g{v % 7}") for c, n in (("a", 30), ("b", 12)) for v in range(n) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "idx string, corpus string, speaker string, grp string")
    got = {(r["corpus"], r["speaker"]): r["mass"] for r in sampling.mass_weights(df, {"a": 3.0}, cap_voice=0.05, cap_group=0.12).collect()}
    n = Counter((c, s) for _, c, s, _ in rows)
    group = {(c, s): g for _, c, s, g in rows}
    mass = {k: (3 if k[0] == "a" else 1) / 4 * m**0.5 / sum(x**0.5 for j, x in n.items() if j[0] == k[0]) for k, m in n.items()}
    for _ in range(500):
        held = Counter()
        for k, m in mass.items():
            held[group[k]] += m
        mass = {k: min(0.05, m * min(1, 0.12 / held[group[k]])) for k, m in mass.items()}
        lacking, held = 1 - sum(mass.values()), Counter()
        if lacking < 1e-10:
            break
        for k, m in mass.items():
            held[group[k]] += m
        room = {k: max(0, min(0.05 - m, 0.12 - held[group[k]])) for k, m in mass.items()}
        base = sum(m for k, m in mass.items() if room[k] > 1e-12)
        if not base:
            break
        mass = {k: m + (min(room[k], lacking * m / base) if room[k] > 1e-12 else 0) for k, m in mass.items()}
    whole = sum(mass.values())
    assert got == pytest.approx({k: m / whole for k, m in mass.items()}, rel=1e-6)


def test_event_components_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT DISTINCT 'u' || user_id, 'h' || (epoch_us(ts) // 600000000) FROM '{DATA}/events.parquet'").fetchall()
    up = {x: x for r in rows for x in r}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in rows:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in catalog.QUERIES["event_components"](spark, DATA).collect()}
    assert got == {x: root(x) for x in up}


def test_micro_error_rate_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) FROM '{DATA}/conversations.parquet'").fetchall()
    errors, units = Counter(), Counter()
    for c, a, b in rows:
        if b is not None:
            errors[c % 10] += distance((a or "").split(), b.split())
            units[c % 10] += len((a or "").split())
    got = {r["part"]: r["micro"] for r in catalog.QUERIES["micro_error_rate"](spark, DATA).collect()}
    assert got == pytest.approx({k: errors[k] / max(1, units[k]) for k in units})


def test_gates_on_awkward_rows(spark):
    mix = spark.createDataFrame([("ref_edit=0.75, plain=0.25",), ("ref_edit=1,ref_edit_auto=1",)], "s string")
    names = {"ref_edit": "ref_edit_tata", "ref_edit_auto": "ref_edit_tata", "plain": "tts_plain"}
    got = [r["m"] for r in mix.select(gates.parsed_mix(F.col("s"), names).alias("m")).collect()]
    assert got == [{"ref_edit_tata": 0.75, "tts_plain": 0.25}, {"ref_edit_tata": 1.0}]
    for bad in ("other=1", "plain=0"):
        with pytest.raises(Exception, match="variant|mix"):
            spark.createDataFrame([(bad,)], "s string").select(gates.parsed_mix(F.col("s"), names)).collect()
    rows = spark.createDataFrame([("a", "r"), ("a", None), ("b", "r")], "variant string, ref string")
    assert gates.resolved(rows, ("a",), "c").orderBy("variant").collect() == [("a", "r"), ("b", None), ("c", None)]
    assert gates.resolved(rows, ("a",), "c", require=True).collect() == [("a", "r")]
    lengths = spark.createDataFrame([(x,) for x in (3, 6, 7, 1, 2, 15, None)], "n int")
    assert sorted((r["n"], r["bucket"]) for r in gates.length_buckets(lengths, "n").filter("n IS NOT NULL").collect()) == [(1, 0), (2, 0), (3, 1), (6, 1), (7, 2), (15, 3)]
    assert gates.length_buckets(lengths.limit(0), "n").count() == 0
    frames = spark.createDataFrame([([[1] * 16],), ([[1] * 15],), ([[2051] * 16],), ([],)], "f array<array<int>>")
    assert [r[0] for r in frames.select(signals.valid_codes(F.col("f"))).collect()] == [True, False, False, True]


def test_groups_of_clips_without_a_speaker(spark):
    rows = spark.createDataFrame([("i1", "c", None), ("i2", "c", ""), ("i3", "c", "s"), ("i4", "c", "s")], "idx string, corpus string, speaker string")
    assert sorted(r["grp"] for r in splits.with_groups(rows).collect()) == ["c/i1", "c/i2", "c/s", "c/s"]
