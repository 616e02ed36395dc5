"""Readers and writers on small files, written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, writers


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("wavs/1.wav==a &amp;  b\nbad line\nwavs/2.wav==\nwavs/2.wav==late\nwavs/1.wav==again\nwavs/3.wav==x\n")
    path = f"file://{tmp_path}/a.txt"
    assert rows(readers.read_pairs(spark, path, "c")) == [("c", "wavs/1.wav", "a & b"), ("c", "wavs/3.wav", "x")]
    there = spark.createDataFrame([("wavs/3.wav",)], "rel string")
    assert rows(readers.read_pairs(spark, path, "c", there)) == [("c", "wavs/3.wav", "x")]
    assert readers.bad_pair_lines(spark, path).first()["bad"] == 1


def test_json_lines_and_names(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1}\n\n  \n{"i": 2}\n')
    assert rows(readers.read_json_lines(spark, f"file://{tmp_path}/a.jsonl", "i int")) == [(1,), (2,)]
    (tmp_path / "n.txt").write_text(" a \n\n\tb\n")
    assert rows(readers.read_names(spark, f"file://{tmp_path}/n.txt")) == [("a",), ("b",)]
    assert readers.read_names(spark, f"file://{tmp_path}/none.txt").collect() == []


def test_votes(spark, tmp_path):
    (tmp_path / "train.tsv").write_text('client_id\tpath\tsentence\tup_votes\tdown_votes\nzz\tclips/1.mp3\tsaid "so\t2\t0\naa\t1\tlater\t2\t0\ncc\t2\tno\t1\t0\n\t3\tx\t\t\ndd\t4\tyes\t\t1\n')
    (tmp_path / "dev.tsv").write_text("path\ttext\tclient_id\n1\tdev\tee\n5\tfive\t12345678901234567890\n")
    paths = [f"file://{tmp_path}/{n}.tsv" for n in ("train", "dev")]
    got = rows(readers.read_votes(spark, paths, "c").select("file", "speaker", "text"))
    assert got == [("1.mp3", "c:zz", 'said "so'), ("4.mp3", "c:dd", "yes"), ("5.mp3", "c:1234567890123456", "five")]
    assert readers.read_validated(spark, paths[0], "c").count() == 3


def test_uids_manifests_and_folders(spark, tmp_path):
    (tmp_path / "t.txt").write_text("10_20_1\thello  there\n10_20\tshort uid\n10_20_2\tno file\n11_2_3\topus\n")
    present = spark.createDataFrame([("10_20_1.opus",), ("10_20_1.flac",), ("11_2_3.opus",)], "name string")
    got = rows(readers.read_uid_texts(spark, f"file://{tmp_path}/t.txt", "m", present))
    assert got == [("m_10_20_1", "m", "m:10", "hello there", "10_20_1.flac"), ("m_11_2_3", "m", "m:11", "opus", "11_2_3.opus")]
    (tmp_path / "m.tsv").write_text("audio\ttext\tspeaker\nx/a.wav\tone\ts\n\tnone\ts\nb.wav\ttwo\tt\n")
    got = rows(readers.read_manifest(spark, f"file://{tmp_path}/m.tsv", "c"))
    assert [r[0] for r in got] == ["c_a_0", "c_b_2"]
    for name in ("s1/x/a.wav", "s2/b.FLAC", "s2/c.txt", "top.wav"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"x")
    got = rows(readers.read_folders(spark, f"{tmp_path}/f").select("idx", "speaker"))
    assert got == [("s1/x/a", "s1"), ("s2/b", "s2")]


def test_any_manifest_and_templates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a|b,c\n1|2,3\n4|5\n")
    (tmp_path / "b.csv").write_text("a\tb\n1\tx,y\n")
    (tmp_path / "c.json").write_text(json.dumps([{"a": "1"}, {"a": "2"}]))
    (tmp_path / "d.json").write_text(json.dumps({"items": [{"a": "1"}]}))
    (tmp_path / "e.jsonl").write_text('{"a": "1"}\n')
    at = lambda n: f"file://{tmp_path}/{n}"
    assert readers.sniffed("a|b|c\n1,2") == "|" and readers.sniffed("a,b\t") == "\t" and readers.sniffed("a,b\n\t") == ","
    assert rows(readers.read_any(spark, at("b.csv"))) == [("1", "x,y")]
    assert [readers.read_any(spark, at(n)).count() for n in ("a.csv", "c.json", "d.json", "e.jsonl")] == [2, 2, 1, 1]
    df = spark.createDataFrame([("t", "s"), (None, "s")], "tag string, speaker string")
    assert rows(readers.templated(df, {"idx": "{tag}:{speaker}!"}).select("idx")) == [(":s!",), ("t:s!",)]
    with pytest.raises(ValueError, match="unknown field"):
        readers.templated(df, {"idx": "{other}"})
    clips = spark.createDataFrame([("1", "s"), ("2", "t")], "idx string, speaker string")
    speakers = spark.createDataFrame([(0, "s", "val"), (1, "s", "train")], "line_no int, speaker string, split string")
    assert rows(readers.with_splits(clips, speakers).select("idx", "split")) == [("1", "train"), ("2", None)]
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a"}, {"name": "b", "enabled": False}, {"name": "c", "enabled": True}]))
    assert rows(readers.read_registry(spark, at("r.json")).select("name")) == [("a",), ("c",)]
    names = spark.createDataFrame([("e1-val3_25",), ("e2-val2_9",), ("e3",)], "name string")
    assert rows(readers.best_checkpoint(names)) == [("e2-val2_9", 2.9)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"', "train"), ("b", "y, z\n2", "val")], "idx string, text string, split string")
    at = lambda n: f"file://{tmp_path}/{n}"
    for _ in range(2):
        writers.append_ledger(df, at("ledger"))
    assert spark.read.json(at("ledger")).count() == 4
    writers.write_manifest(df, at("m"))
    assert rows(spark.read.csv(at("m"), header=True, multiLine=True, quote='"', escape='"')) == rows(df)
    writers.write_manifest(df, at("p"), plain=True)
    assert "say 'x'" in {r["text"] for r in spark.read.csv(at("p"), header=True, multiLine=True).collect()}
    writers.write_splits(df, at("s"))
    assert rows(spark.read.text(at("s/split=val"))) == [("b",)]
    writers.replace_table(spark, df, at("t"))
    writers.replace_table(spark, spark.read.parquet(at("t")).filter("idx = 'a'"), at("t"))
    assert spark.read.parquet(at("t")).count() == 1 and spark.read.parquet(at("t.bak")).count() == 2
    lines = [r["line"] for r in writers.markdown(df.select("idx", "split"), ["idx"], "Clips").orderBy("line_no").collect()]
    assert lines == ["# Clips", "", "| idx | split |", "|-|-|", "| a | train |", "| b | val |"]
    verdicts = spark.createDataFrame([(1, "RUIM"), (2, "OK")], "label int, status string")
    clips = spark.createDataFrame([(10, 1, True), (20, 2, True), (21, 2, False)], "idx int, label int, outlier boolean")
    tables = writers.purity_tables(verdicts, clips, clips.limit(0), "idx")
    writers.write_tables(tables, at("w"))
    assert rows(tables["exclude_clips"]) == [(20,)] and rows(tables["exclude_speakers"]) == [(1,)]
    assert spark.read.csv(at("w/clips"), header=True).count() == 3
    assets = spark.createDataFrame([("a", "x", 1), ("a", "w", 0)], "idx string, source string, priority int")
    chosen, missing = writers.first_sources(assets, df.select("idx"), "idx")
    assert rows(chosen) == [("a", "w")] and rows(missing) == [("b",)]
    assert df.filter(F.col("idx") == "a").count() == 1


# defaults, numbered lines, reports ------------------------------------------------------------------------------------


def test_numbered_lines_of_files_in_parts(spark, tmp_path):
    from corpusloom.sources import readers

    lines = [f"line {i}" if i % 7 else "" for i in range(5_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in readers._numbered(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a.txt", i, x) for i, x in enumerate(lines) if x] + [("b.txt", 0, "x"), ("b.txt", 2, "y")]


def test_defaults_and_corrections(spark):
    from corpusloom.sources import readers

    kind = "idx string, corpus string, speaker string, `group` string, ref_idx string"
    meta = spark.createDataFrame([("a", None, None, None, None), ("b", None, None, None, "r0"), ("c", "cv", "s1", None, "r1"), ("d", None, "s2", "g0", None)], kind)
    chunks = spark.createDataFrame([("a", "ep:S1")], "idx string, speaker string")
    corrections = spark.createDataFrame([("c", "pod", "p1", "g1"), ("d", "pod", "p2", ""), ("z", "pod", "p3", None)], "idx string, corpus string, speaker string, `group` string")
    refs = spark.createDataFrame([("b", ""), ("c", "r9")], "idx string, ref_idx string")
    got = {r["idx"]: (r["corpus"], r["speaker"], r["group"], r["ref_idx"]) for r in readers.with_defaults(meta, chunks, corrections, refs).collect()}
    assert got == {"a": ("podcast", "ep:S1", None, None), "b": ("tata", "tata", None, "r0"), "c": ("cv", "p1", "g1", "r9"), "d": ("pod", "p2", "g0", None)}
    assert len(readers.with_defaults(meta, chunks).collect()) == 4


def test_newest_checkpoint(spark):
    from corpusloom.sources import readers

    names = spark.createDataFrame([("run_step90",), ("run_step_1000",), ("best",), ("run_step200",)], "name string")
    assert tuple(readers.newest_checkpoint(names).first()) == ("run_step_1000", 1000)
    assert readers.newest_checkpoint(names.filter("name = 'best'")).collect() == []


def test_reports_in_html_json_and_csv(spark, tmp_path):
    import json

    from corpusloom.sources import writers

    rows = spark.createDataFrame([(2, "b<&", None), (1, "a", 0.5)], "n int, said string, x double")
    writers.write_report(writers.html_table(rows, ["n"], "T & U"), str(tmp_path / "html"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "html").glob("part-*")))
    assert page.split("\n")[1:-2] == ["<tr><td>1</td><td>a</td><td>0.5</td></tr>", "<tr><td>2</td><td>b&lt;&amp;</td><td></td></tr>"]
    assert page.startswith("<html>") and "T &amp; U" in page and page.endswith("</table></html>\n")
    writers.write_json_report(rows.orderBy("n"), str(tmp_path / "json"))
    said = [json.loads(x) for p in sorted((tmp_path / "json").glob("part-*")) for x in p.read_text().splitlines()]
    assert said == [{"n": 1, "said": "a", "x": 0.5}, {"n": 2, "said": "b<&", "x": None}]
    for _ in range(2):
        writers.append_csv(spark, rows, str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == '"n","said","x"' and len(lines) == 5 and lines.count('"n","said","x"') == 1
    import pytest

    with pytest.raises(ValueError, match="header"):
        writers.append_csv(spark, rows.select("n"), str(tmp_path / "csv"))


def test_mass_weights_with_a_cap_on_repeats(spark):
    from corpusloom.operators import sampling

    rows = [(f"{v}-{i}", "c", f"v{v:02d}", f"g{v % 40}") for v in range(80) for i in range(1 + v)]
    clips = spark.createDataFrame(rows, "idx string, corpus string, speaker string, grp string")
    got = sampling.mass_weights(clips, {"c": 1.0}, beta=0.0, cap_voice=0.05, cap_group=0.1, samples=10_000, most_repeats=6.0).collect()
    assert abs(sum(r["mass"] for r in got) - 1) < 1e-9
    assert all(r["mass"] <= min(0.05, r["n_clips"] * 6.0 / 10_000) + 1e-9 for r in got)
    assert max(r["mass"] for r in got) > 1 / 80


def test_training_folder_registry_and_locators(spark, tmp_path):
    from corpusloom.sources import readers

    (tmp_path / "manifest.csv").write_text("idx,corpus,speaker,wav_rel\na,c1,s1,x\nb,c2,s2,y\nd,c2,s3,z\n")
    bare = {r["idx"]: r["split"] for r in readers.read_training_folder(spark, str(tmp_path)).collect()}
    assert bare == {"a": None, "b": None, "d": None}
    (tmp_path / "speaker_table.csv").write_text("split,corpus,group,speaker\ntrain,c1,g,s1\nval,c2,g,s2\ntest,c2,g,s2\n")
    got = {r["idx"]: (r["speaker"], r["corpus"], r["split"], r["audio"]) for r in readers.read_training_folder(spark, str(tmp_path)).collect()}
    assert got == {i: (s, c, x, f"{tmp_path}/wavs24/{i}.wav") for i, s, c, x in (("a", "s1", "c1", "train"), ("b", "s2", "c2", "test"), ("d", "s3", "c2", None))}
    assert {r["name"] for r in readers.read_registry(spark, str(tmp_path / "none.json")).collect()} == {"tata", "podcast"}
    spark.range(20).select("id", (F_id() * 2).alias("x"), (F_id() * 3).alias("y")).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = readers.read_located(spark, str(tmp_path / "p"), ["id"], 5).collect()
    assert [(r["row"], r["id"]) for r in rows] == [(i, i) for i in range(5)]
    assert readers.read_located(spark, str(tmp_path / "p"), ["id"]).columns == ["file", "row", "id"]


def F_id():
    from pyspark.sql import functions as F

    return F.col("id")
