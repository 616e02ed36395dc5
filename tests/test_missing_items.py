"""Archives, containment, profiles, plans, silence, ledgers and as-of joins against plain models."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import profiles, signals, spoken, text as tx
from corpusloom.operators import asof, containment, scoring
from corpusloom.sources import archives
from corpusloom.streaming import ledger

# archives


def tarred(path, members, mode):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


MEMBERS = [
    ("s1/a.txt", "olá".encode()), ("s1/a.wav", b"A" * 3_000), ("s1/._b.txt", b"x"), ("s1/b.json", b'{"text": "bom dia"}'), ("s1/b.wav", b"B" * 5_000),
    ("s1/c.wav", b"C" * 10), ("s1/d.txt", b"alone"), ("s1/e.json", b"no json"), ("s1/e.wav", b"E" * 4_000), ("s1/readme.md", b"?"), ("s1/f.txt", b"one"), ("s1/f.txt", b"two"), ("s1/f.wav", b"F"), ("s1/._f.wav", b"x"),
]
PAIRS = {"s1/a": ("olá", 3_000, "paired"), "s1/b": ("bom dia", 5_000, "paired"), "s1/c": (None, 10, "no text"), "s1/d": ("alone", None, "no sound"), "s1/e": ("no json", 4_000, "paired"), "s1/f": ("two", 1, "paired")}


@pytest.mark.parametrize(("name", "mode"), [("x.tar", "w"), ("x.tar.gz", "w:gz"), ("x.tgz", "w:gz")])
def test_archive_source(spark, tmp_path, name, mode):
    tarred(tmp_path / name, MEMBERS, mode)
    spark.dataSource.register(archives.ArchiveSource)
    df = spark.read.format("paired_tar").option("partition_bytes", 4_000).load(str(tmp_path / name))
    got = {r["stem"]: (r["text"], r["sound"] and len(r["sound"]), r["status"]) for r in df.collect()}
    assert got == PAIRS
    assert df.rdd.getNumPartitions() == (3 if name == "x.tar" else 1)
    if name == "x.tar":
        assert sorted(len(p) for p in df.select("stem").rdd.glom().collect()) != [0, 0, 6]


def test_archive_folders_and_patterns(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    tarred(tmp_path / "one.tar", MEMBERS[:2], "w")
    tarred(tmp_path / "deep" / "two.tar.gz", MEMBERS[3:5], "w:gz")
    (tmp_path / "note.txt").write_text("x")
    spark.dataSource.register(archives.ArchiveSource)
    read = lambda p: sorted(r["stem"] for r in spark.read.format("paired_tar").load(p).collect())
    assert read(str(tmp_path)) == ["s1/a", "s1/b"]
    assert read(f"{tmp_path}/o*.tar") == ["s1/a"]
    assert read(f"file://{tmp_path}/one.tar") == ["s1/a"]
    (tmp_path / "empty").mkdir()
    assert read(str(tmp_path / "empty")) == []


# containment


def test_first_containing(spark):
    names = ["banana", "bandana", "ana", "cab", "a", "é_ana", "", "xyz", "aaa", "%_", None, "banana"]
    parts = ["ana", "ban", "an", "b", "", "anab", "dan", "zzz", "aaaa", "é", "%", "_a", None, "ana"]
    df = containment.first_containing(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(n,) for n in names], "name string"), "part", "name")
    expected = {p: min((n for n in names if n is not None and p in n), default=None) for p in parts if p is not None}
    assert {r["part"]: r["name"] for r in df.collect()} == {p: n for p, n in expected.items() if n is not None}
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    empty = containment.first_containing(spark.createDataFrame([("",)], "part string"), spark.createDataFrame([], "name string"), "part", "name")
    assert empty.collect() == []


# profiles


def sound_profile():
    return {
        "schema_version": 1, "name": "fast", "service": {"concurrency": 1, "cfg_scales": [1.0, 2.5]},
        "stages": {
            "text_encoder": {"graphs": [{"batch_size": 1, "token_length": 64}, {"batch_size": 2, "token_length": "128"}]},
            "backbone_prefill": {"graphs": [{"branch_batch_size": 1, "sequence_length": 96}, {"branch_batch_size": 2, "sequence_length": 32}]},
            "backbone_decode": {"graphs": [{"branch_batch_size": 2}, {"branch_batch_size": 1}]},
            "depth_decoder": {"graphs": [{"batch_size": 1}, {"batch_size": 2}, {"batch_size": 2}]}, "codec": {"graphs": [{"num_lanes": 1, "chunk_frames": 4}]},
        },
        "warmup_request": {"template": "tts", "text": "hello"},
    }


def changed(path, value):
    doc = sound_profile()
    at = doc
    for step in path[:-1]:
        at = at[step]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


CASES = [
    (("schema_version",), 2, ["$.schema_version must be 1"]), (("schema_version",), None, ["$.schema_version must be 1"]), (("name",), "  ", ["$.name must not be empty"]),
    (("service",), [1], ["$.service must be an object"]), (("service", "concurrency"), 0, ["$.service.concurrency must be > 0"]), (("service", "concurrency"), 3, ["$.service.concurrency must be 1"]),
    (("service", "cfg_scales"), [], ["$.service.cfg_scales must be a non-empty list"]), (("service", "cfg_scales"), "x", ["$.service.cfg_scales must be a non-empty list"]),
    (("service", "cfg_scales"), [0.5, 1.0, 2.0], ["$.service.cfg_scales must be >= 1"]), (("stages",), 5, ["$.stages must be an object"]),
    (("stages", "codec"), None, ["$.stages.codec must be an object"]), (("stages", "text_encoder", "graphs"), [], ["$.stages.text_encoder.graphs must be a non-empty list"]),
    (("stages", "text_encoder", "graphs", 1), 7, ["$.stages.text_encoder.graphs[1] must be an object"]), (("stages", "text_encoder", "graphs", 0, "batch_size"), -1, ["$.stages.text_encoder.graphs[0].batch_size must be > 0"]),
    (("stages", "text_encoder", "graphs", 1, "token_length"), 33, ["$.stages.text_encoder.graphs[1].token_length must be a multiple of 32"]),
    (("stages", "backbone_prefill", "graphs", 0, "sequence_length"), None, ["$.stages.backbone_prefill.graphs[0].sequence_length must be > 0"]),
    (("stages", "backbone_prefill", "graphs", 0, "branch_batch_size"), 2, ["$.stages.backbone_prefill.graphs must match backbone_decode"]),
    (("stages", "backbone_decode", "graphs", 1, "branch_batch_size"), 2, ["$.stages.backbone_decode.graphs must match cfg_scales", "$.stages.backbone_prefill.graphs must match backbone_decode"]),
    (("stages", "depth_decoder", "graphs", 0, "batch_size"), 4, ["$.stages.depth_decoder.graphs must match cfg_scales"]),
    (("stages", "codec", "graphs", 0, "num_lanes"), 2, ["$.stages.codec.graphs[0].num_lanes must be 1"]), (("stages", "codec", "graphs"), [{"num_lanes": 1, "chunk_frames": 4}] * 2, ["$.stages.codec.graphs must hold one graph"]),
    (("warmup_request",), None, ["$.warmup_request must be an object"]), (("warmup_request", "text"), " ", ["$.warmup_request.text must not be empty"]), (("warmup_request", "template"), None, ["$.warmup_request.template must not be empty"]),
    (("service", "cfg_scales"), [2.0], ["$.stages.backbone_decode.graphs must match cfg_scales", "$.stages.depth_decoder.graphs must match cfg_scales"]),
]


def test_profile_faults(spark):
    docs = [json.dumps(sound_profile()), None, "{", "[]", *[json.dumps(changed(path, value)) for path, value, _ in CASES]]
    two = sound_profile()
    two["name"], two["warmup_request"]["text"] = "", ""
    docs.append(json.dumps(two))
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string").select("i", profiles.profile_faults(F.col("doc")).alias("f"))
    got = {r["i"]: [f"{f['path']} {f['reason']}" for f in r["f"]] for r in df.collect()}
    assert got[0] == []
    assert got[1] == got[2] == ["$ must be JSON"]
    assert "$.service must be an object" in got[3] and "$.stages must be an object" in got[3]
    for i, (path, value, expected) in enumerate(CASES, 4):
        assert got[i] == expected, (path, value)
    assert got[len(docs) - 1] == ["$.name must not be empty", "$.warmup_request.text must not be empty"]
    assert np.all([len(x) for x in got.values()][1:])


# plans


def test_scoring_plan(spark):
    kind = "name string, audio string, text string, heldout array<string>"
    unseen = spark.createDataFrame([("v1", "v1.wav", "um", ["h1"]), ("v2", "v2.wav", "dois", None)], kind)
    users = spark.createDataFrame([("u1", "u1.wav", "x", None), ("u2", "u2.wav", "y", [" ", "k"])], kind)
    voices = scoring.plan_voices(unseen, users)
    got = {r["name"]: (r["grp"], r["heldout"], r["self_heldout"]) for r in voices.collect()}
    assert got == {"v1": ("val", ["h1"], False), "v2": ("val", [], False), "u1": ("user", ["u1.wav"], True), "u2": ("user", ["k"], False)}
    phrases = spark.createDataFrame([(0, "p0"), (1, "p1")], "k int, phrase string")
    every = {r["key"] for r in scoring.jobs(voices, scoring.phrase_plan(phrases)).collect()}
    assert every == {f"{v}__p{k}" for v in got for k in (0, 1)}
    few = scoring.jobs(voices, scoring.phrase_plan(phrases, [1]))
    assert {r["key"] for r in few.collect()} == {"v1__p1", "v2__p1", "u1__p0", "u1__p1", "u2__p0", "u2__p1"}
    done = spark.createDataFrame([("u1__p0",), ("v2__p1",), ("v2__p1",)], "key string")
    assert {r["key"] for r in scoring.jobs(voices, scoring.phrase_plan(phrases, [1]), done).collect()} == {"v1__p1", "u1__p1", "u2__p0", "u2__p1"}
    assert {r["key"][:2] for r in scoring.jobs(voices, scoring.phrase_plan(phrases, [])).collect()} == {"u1", "u2"}
    assert "CartesianProduct" not in few._jdf.queryExecution().toString() and "NestedLoop" not in few._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="voices share"):
        scoring.plan_voices(unseen, unseen).collect()
    measured = spark.createDataFrame([("v1__p0", "v1", "val", 0.5, 0.1), ("v1__p1", "v1", "val", 0.7, 0.3), ("u1__p0", "u1", "user", 0.4, 0.0)], "key string, name string, grp string, secs double, wer double")
    bounds = spark.createDataFrame([("v1", 0.2, 1.0), ("u1", 0.5, 0.5)], "name string, floor double, ceiling double")
    out = {r["name"]: r for r in scoring.scores(measured, bounds).collect()}
    assert out["v1"]["secs_norm"] == pytest.approx(0.5) and out["u1"]["secs_norm"] is None


# silence


def plain_ends(y, frame, hop, top_db):
    padded = np.concatenate([np.zeros(frame // 2), y, np.zeros(frame // 2)])
    power = np.array([np.mean(padded[t * hop : t * hop + frame] ** 2) for t in range(1 + len(y) // hop)])
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10))
    loud = db > -top_db
    return [min((t + 1) * hop, len(y)) for t in range(len(loud)) if loud[t] and (t + 1 == len(loud) or not loud[t + 1])]


def test_sound_ends_and_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        y = rng.normal(size=int(rng.integers(1, 200))) * (rng.random() < 0.9)
        for _ in range(int(rng.integers(4))):
            at = int(rng.integers(len(y)))
            y[at : at + int(rng.integers(40))] *= 1e-4
        rows.append((i, y.tolist(), " ".join(f"w{k}{',' if k % 5 == 4 else ''}" for k in range(int(rng.integers(30))))))
    df = spark.createDataFrame(rows, "i int, y array<double>, t string")
    got = {r["i"]: r for r in df.select("i", signals.sound_ends(F.col("y"), 16, 4, 30.0).alias("e"), signals.truncated_pair(F.col("y"), F.col("t"), 10.0, 8.0, 16, 4, 30.0).alias("p")).collect()}
    for i, y, text in rows:
        ends = plain_ends(np.array(y), 16, 4, 30.0)
        assert got[i]["e"] == ends
        kept = min(max([e for e in ends if e <= 80], default=80), len(y))
        assert (got[i]["p"]["kept"], got[i]["p"]["share"]) == (kept, pytest.approx(kept / len(y)))
        words = text.split()[: max(4, round(len(text.split()) * kept / len(y)))]
        assert " ".join(words).startswith(got[i]["p"]["text"])
    assert spark.range(1).select(signals.sound_ends(F.array().cast("array<double>")).alias("e")).first()["e"] == []


# ledgers


def test_stream_ledger_survives_a_crash(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("in", "ledger", "mark"))
    read = lambda: spark.readStream.schema("idx long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    put = lambda a, b: spark.range(a, b).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("v")).coalesce(1).write.mode("append").parquet(source)
    put(0, 10)
    put(5, 15)
    ledger.run_ledger(read(), path, mark, "idx").awaitTermination()
    assert sorted(r["idx"] for r in ledger.read_ledger(spark, path).collect()) == list(range(15))
    put(10, 20)
    write = ledger.once(path, "idx")

    def crash(batch, number):
        write(batch, number)
        raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        read().writeStream.foreachBatch(crash).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert ledger.read_ledger(spark, path).count() == 20
    put(18, 25)
    ledger.run_ledger(read(), path, mark, "idx", lambda rows: rows.withColumn("v", F.col("v") + 0)).awaitTermination()
    rows = ledger.read_ledger(spark, path).collect()
    assert sorted(r["idx"] for r in rows) == list(range(25))
    assert all(r["v"] == 2 * r["idx"] for r in rows)


# as-of joins


def test_next_at_or_above(spark):
    rng = np.random.default_rng(6)
    table = [(int(b), float(x), f"n{k}") for k, (b, x) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60), strict=True))] + [(0, None, "none"), (None, 5.0, "nokey")]
    rows = [(i, int(b), float(x)) for i, (b, x) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 60, 500), strict=True))] + [(900, 0, None), (901, None, 1.0), (902, 1, 1.0), (902, 1, 1.0)]
    got = asof.next_at_or_above(spark.createDataFrame(rows, "i int, batch int, length double"), spark.createDataFrame(table, "batch int, size double, name string"), ["batch"], "length", "size", ["size", "name"]).collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [(size, name) for b, size, name in table if r["batch"] is not None and r["length"] is not None and b == r["batch"] and size is not None and size >= r["length"]]
        assert (tuple(r["fit"]) if r["fit"] else None) == (min(fits) if fits else None)


# texts


def test_blocks_of_a_short_sentence_before_a_long_one():
    short, long = [f"a{i}" for i in range(5)] + ["a5."], [f"b{i}" for i in range(3)] + ["b3,"] + [f"c{i}" for i in range(20)]
    blocks = [" ".join(b) for b in tx.packed([short, long], 10)]
    assert blocks[0] == "a0 a1 a2 a3 a4 a5."
    assert " ".join(blocks) == " ".join(short + long)


def test_comparable_texts(spark):
    cases = {"d'água, guarda-chuva! a.b": "d água guarda chuva a b", "A_b  C": "a b c", "": "", "caf\u0065\u0301": "café"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.comparable(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == cases
    rows = spark.createDataFrame([("Custa 12 reais.", "pt"), ("It costs 12.", "en"), (None, "pt-BR")], "t string, lang string")
    assert {r["t"]: r["c"] for r in spoken.comparable_spoken(rows, "t", "c", "lang").collect()} == {"Custa 12 reais.": "custa doze reais", "It costs 12.": "it costs 12", None: ""}


def test_corpus_texts(spark):
    rows = [("Olá…  mundo – 12 @ vezes #", 5.0), ("- ab -", 1.0), ("x" * 10, 100.0), ("sempre em 1999 e 12345, a7 7", 5.0), (None, 1.0), ("ação\u0301 é boa!", 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d double")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", spoken.corpus_text(F.col("t"), F.col("d")).alias("a"), spoken.corpus_text(F.col("t"), F.col("d"), read=False).alias("b")).collect()}
    assert got[0] == ("Olá... mundo - doze vezes", "Olá... mundo - 12 vezes.")
    assert got[1] == (None, None) and got[2] == (None, None) and got[4] == (None, None)
    assert got[3][0] == "sempre em mil novecentos e noventa e nove e 12345, a7 sete"
    assert got[5][1].startswith("Aç") and got[5][1].endswith(" é boa!")


def test_capital_of_a_sentence_is_one_character(spark):
    cases = {"ßheit ab": "ẞheit ab.", "ação!": "Ação!", "ﬁm": "ﬁm.", "7 a": "7 a."}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.as_sentence(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_composed_texts_are_held_some_at_a_time():
    import pyarrow as pa
    import tracemalloc

    texts = pa.array(["e\u0301", None, "", "\u00e9"] + ["\u00e9" * 100_000] * 400)
    assert tx.composed(texts).to_pylist()[:4] == ["\u00e9", None, "", "\u00e9"] and tx.composed(texts.slice(0, 0)).to_pylist() == []
    tracemalloc.start()
    tx.composed(texts)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_gated_rows_are_not_brought_together_by_group(spark):
    from corpusloom.operators import gates

    rows = spark.createDataFrame([(i, "one", "uma frase de teste", 2.0 + i % 3 / 10, None) for i in range(50)], "i int, g string, text string, dur double, wer double")
    plan = gates.gated(rows, "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_long_steps_are_dealt_over_all_cores(spark):
    import __spark_entry__ as entry

    for name in ("profile_faults", "spoken_orders"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
