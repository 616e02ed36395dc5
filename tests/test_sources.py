"""Readers on small files."""

from corpusloom.sources import readers


def test_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wavs/1.wav==hello   there \nbad line\nwavs/2.wav==  \nwavs/1.wav==second\nwavs/3.wav==x==y\n")
    got = sorted(map(tuple, readers.read_pairs(spark, str(tmp_path / "a.csv"), "c").collect()))
    assert got == [("c", "wavs/1.wav", "hello there"), ("c", "wavs/3.wav", "x==y")]


def test_last_wins(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"idx": "a", "n": 1}\n\n{"idx": "b", "n": 2}\n{"idx": "a", "n": 3}\n')
    got = {r["idx"]: r["n"] for r in readers.read_last_wins(spark, str(tmp_path / "m.jsonl"), "idx string, n int").collect()}
    assert got == {"a": 3, "b": 2}


def test_votes(spark, tmp_path):
    head = "client_id\tpath\tsentence\tup_votes\tdown_votes\n"
    (tmp_path / "train.tsv").write_text(head + 'c1\tx\tone "quoted\t2\t0\nc2\ty\ttwo\t1\t0\nc3\tz\tthree\t\t\n')
    (tmp_path / "dev.tsv").write_text(head + "c4\tx\tlater\t5\t0\nc5\tw\tfive\t3\t1\n")
    rows = readers.read_votes(spark, [str(tmp_path / "train.tsv"), str(tmp_path / "dev.tsv")], "cv").collect()
    assert sorted((r["file"], r["speaker"], r["text"]) for r in rows) == [("x.mp3", "cv:c1", 'one "quoted'), ("z.mp3", "cv:c3", "three")]


def test_turns_and_names(spark, tmp_path):
    (tmp_path / "e.rttm").write_text("SPEAKER ep 1 1.5 2.0 <NA> <NA> S0 <NA> <NA>\nSPKR-INFO x\nSPEAKER short 1\n")
    assert [tuple(r) for r in readers.read_turns(spark, str(tmp_path / "e.rttm")).collect()] == [("ep", 1.5, 3.5, "S0")]
    (tmp_path / "l.txt").write_text(" a \n\n\tb\n")
    assert sorted(r["idx"] for r in readers.read_names(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]
