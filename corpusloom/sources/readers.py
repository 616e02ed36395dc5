"""Readers of corpus files into tables."""

from __future__ import annotations

from string import Formatter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.text import collapse, html_unescaped, strip
from corpusloom.operators.relational import one_per_key
from corpusloom.session import saved


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files, numbered from 0 in each file, empty ones counted and left out.

    Files are read in parts, whose lines are numbered in order; the lines of a file's parts before are added, so a file of
    any size is many tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"), "value")
    lines = saved(lines, spark)  # written once, so that numbers stay
    parts = lines.groupBy("file", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    return lines.filter(F.col("value") != "").join(parts, ["file", "_part"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "value")


# fixed value: the form of a pair line
PAIR = r"^(wavs/[^\s]+\.wav)==(.*)$"


def read_pairs(spark: SparkSession, path: str, corpus: str, present: DataFrame | None = None) -> DataFrame:
    """(corpus, rel, text) from lines ``wavs/NAME.wav==text``, HTML entities decoded; bad lines and empty texts go.

    The first line of a name stays, even if its text is empty. With ``present`` (rel) only files that exist stay.
    """
    rows = _numbered(spark, path).filter(F.col("value").rlike(PAIR))
    text = collapse(html_unescaped(F.regexp_extract("value", PAIR, 2)))
    rows = rows.select("file", "line_no", F.lit(corpus).alias("corpus"), F.regexp_extract("value", PAIR, 1).alias("rel"), text.alias("text"))
    rows = one_per_key(rows, ["corpus", "rel"], [F.asc("file"), F.asc("line_no")]).filter("text != ''").select("corpus", "rel", "text")
    return rows if present is None else rows.join(present.select("rel").distinct(), "rel", "left_semi").select("corpus", "rel", "text")


def bad_pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, bad): how many lines of a pair file have another form."""
    return _numbered(spark, path).groupBy("file").agg(F.count_if(~F.col("value").rlike(PAIR)).alias("bad"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema`` from JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"(?U)\S"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_last_wins(spark: SparkSession, path: str, schema: str, key: str = "idx") -> DataFrame:
    """JSON lines of ``schema``; of several lines with one key the last counts."""
    rows = _numbered(spark, path).select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")
    return one_per_key(rows.filter(F.col(key).isNotNull()), [key], [F.desc("file"), F.desc("line_no")]).drop("file", "line_no")


def voted(up: str, down: str, least: int = 2) -> Column:
    """Votes (string columns) are judged only where both are given."""
    given = (F.coalesce(up, F.lit("")) != "") & (F.coalesce(down, F.lit("")) != "")
    return F.when(given, (F.col(up).try_cast("int") >= least) & (F.col(down).try_cast("int") <= 0)).otherwise(True)


def _columns(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """(file, line_no, ``names``) of text tables without quotes; a column that the first line does not name is null."""
    lines = _numbered(spark, path).select("file", "line_no", F.split("value", sep).alias("cells"))
    head = lines.filter("line_no = 0").select("file", F.col("cells").alias("head"))
    cell = lambda name: F.get("cells", F.nullif(F.array_position("head", name), F.lit(0)).cast("int") - 1)
    return lines.filter("line_no > 0").join(head, "file").select("file", "line_no", *[cell(n).alias(n) for n in names])


def _clips_of_votes(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    rows = _columns(spark, path, ["client_id", "path", "sentence", "text", "up_votes", "down_votes"])
    rows = rows.withColumn("said", F.when(F.coalesce("sentence", F.lit("")) != "", F.col("sentence")).otherwise(F.col("text")))
    kept = rows.filter(voted("up_votes", "down_votes")).filter("coalesce(client_id, '') != '' AND coalesce(path, '') != '' AND coalesce(said, '') != ''")
    name = F.substring_index("path", "/", -1)
    name = F.when(F.endswith(name, F.lit(".mp3")), name).otherwise(F.concat(name, F.lit(".mp3")))
    speaker = F.concat(F.lit(f"{corpus}:"), F.substring("client_id", 1, 16))
    return kept.select("line_no", F.lit(corpus).alias("corpus"), speaker.alias("speaker"), collapse(F.col("said")).alias("text"), name.alias("file"))


def read_votes(spark: SparkSession, paths: list[str], corpus: str) -> DataFrame:
    """(corpus, speaker, text, file) from voted tables in the given order; the first line of a clip's file name stays."""
    found = None
    for order, path in enumerate(paths):
        rows = _clips_of_votes(spark, path, corpus).withColumn("_order", F.lit(order))
        found = rows if found is None else found.unionByName(rows)
    kept = one_per_key(found, ["file"], [F.asc("_order"), F.asc("line_no")])
    return kept.select("corpus", "speaker", "text", "file")


def read_validated(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """(corpus, speaker, text, file) of one voted table, repeated file names and all."""
    return _clips_of_votes(spark, path, corpus).select("corpus", "speaker", "text", "file")


def read_uid_texts(spark: SparkSession, path: str, corpus: str, present: DataFrame) -> DataFrame:
    """(idx, corpus, speaker, text, file) from ``uid<TAB>text`` with a uid of three parts or more.

    ``present`` (name) are the files there are; of uid.flac and uid.opus the first that is there is taken, and a uid with
    neither goes.
    """
    cells = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.get(cells, F.lit(0)).alias("uid"), collapse(F.get(cells, F.lit(1))).alias("text"))
    parts = F.split("uid", "_")
    rows = rows.filter((F.size(parts) >= 3) & (F.coalesce("text", F.lit("")) != ""))
    kinds = present.select(F.regexp_extract("name", r"^(.*)\.(?:flac|opus)$", 1).alias("uid"), "name").filter("uid != ''")
    first = kinds.groupBy("uid").agg(F.min_by("name", F.when(F.endswith("name", F.lit(".flac")), 0).otherwise(1)).alias("file"))
    return rows.join(first, "uid").select(F.concat(F.lit(f"{corpus}_"), "uid").alias("idx"), F.lit(corpus).alias("corpus"), F.concat(F.lit(f"{corpus}:"), F.get(parts, F.lit(0))).alias("speaker"), "text", "file")


def read_manifest(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """(idx, corpus, speaker, text, audio) of a table with audio, text, speaker; idx holds the number of the row.

    Rows without audio or text go, but are counted in the numbers.
    """
    rows = _columns(spark, path, ["audio", "text", "speaker"])
    stem = F.regexp_extract(F.substring_index("audio", "/", -1), r"^(.*?)(?:\.[^.]*)?$", 1)
    rows = rows.filter("coalesce(audio, '') != '' AND coalesce(text, '') != ''")
    return rows.select(F.concat_ws("_", F.lit(corpus), stem, F.col("line_no") - 1).alias("idx"), F.lit(corpus).alias("corpus"), "speaker", collapse(F.col("text")).alias("text"), "audio")


def sniffed(head: str) -> str:
    """The delimiter of a table by its first characters: a bar if more of them than commas, a tab if the first line has one."""
    if head.count("|") > head.count(","):
        return "|"
    return "\t" if "\t" in head.split("\n", 1)[0] else ","


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest: JSON lines, a JSON list or an object with ``items``, else a table whose delimiter is guessed."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        rows = spark.read.json(path, multiLine=True)
        return rows.select(F.explode("items").alias("i")).select("i.*") if rows.columns == ["items"] else rows
    head = "\n".join(r[0] for r in spark.read.text(path).select(F.substring("value", 1, 4096)).take(200))[:4096]
    return spark.read.csv(path, sep=sniffed(head), header=True, multiLine=True, escape='"')


def templated(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``rows`` with columns from templates like ``{tag}:{speaker}``; an unknown field is an error."""
    out = {}
    for name, template in fields.items():
        parts = []
        for fixed, field, _, _ in Formatter().parse(template):
            if fixed:
                parts.append(F.lit(fixed))
            if field is not None:
                if field not in rows.columns:
                    raise ValueError(f"unknown field {field!r} in {template!r}")
                parts.append(F.coalesce(F.col(field).cast("string"), F.lit("")))
        out[name] = F.concat(*parts) if parts else F.lit("")
    return rows.withColumns(out)


def read_folders(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("wav", "flac", "mp3", "ogg", "opus")) -> DataFrame:
    """(idx, speaker, path) of the audio files under ``root``/speaker, at any depth; only their names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    files = files.filter(F.lower("path").rlike(rf"\.(?:{'|'.join(kinds)})$"))
    inside = F.split_part("path", F.lit(f"{root.rstrip('/')}/"), F.lit(-1))
    return files.select(F.regexp_replace(inside, r"\.[^./]*$", "").alias("idx"), F.split_part(inside, F.lit("/"), F.lit(1)).alias("speaker"), "path").filter(F.col("idx").contains("/"))


def with_splits(manifest: DataFrame, speakers: DataFrame) -> DataFrame:
    """A training folder's clips with the split of their speaker; of several rows (line_no, speaker, split) the last counts."""
    last = one_per_key(speakers, ["speaker"], [F.desc("line_no")]).select("speaker", "split")
    return manifest.join(last, "speaker", "left")


# fixed values: the corpora (name, root, csv) where there is no registry
LEGACY_CORPORA = (("tata", "TTS-Portuguese-Corpus", "texts.csv"), ("podcast", "podcast", "texts.csv"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The corpora of a JSON registry that are enabled; one that does not say is, and without the file there are the usual two."""
    try:
        rows = spark.read.json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(LEGACY_CORPORA, "name string, root string, csv string")
    return rows.filter(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in rows.columns else rows


def best_checkpoint(names: DataFrame) -> DataFrame:
    """(name, loss) of the checkpoint folder ``…valX_Y…`` with the least loss X.Y, of ``names`` (name); none without one."""
    loss = F.concat(F.regexp_extract("name", r"val(\d+)_(\d+)", 1), F.lit("."), F.regexp_extract("name", r"val(\d+)_(\d+)", 2))
    some = names.filter(F.col("name").rlike(r"val\d+_\d+")).withColumn("loss", loss.cast("double"))
    return some.orderBy("loss", "name").limit(1).select("name", "loss")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """(tag, start, stop, speaker) from RTTM lines with eight fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.size(f) >= 8) & (F.get(f, F.lit(0)) == "SPEAKER"))
    start = F.get(f, F.lit(3)).cast("double")
    return rows.select(F.get(f, F.lit(1)).alias("tag"), start.alias("start"), (start + F.get(f, F.lit(4)).cast("double")).alias("stop"), F.get(f, F.lit(7)).alias("speaker"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(idx) from a list file: stripped, blank lines dropped; a file that is not there is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "idx string")
    return lines.select(strip(F.col("value")).alias("idx")).filter("idx != ''")


def with_defaults(meta: DataFrame, chunks: DataFrame, corrections: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Last-wins rows (idx, corpus, speaker, group, ref_idx, ...) as they are used: old rows filled, corrections laid over.

    A row without a speaker is of the corpus ``podcast`` where ``chunks`` (idx, speaker) know it, else of ``tata``, with
    that speaker. ``corrections`` (idx, corpus, speaker, group) then give speakers, a corpus where there is none and a
    group where they have one; ``refs`` (idx, ref_idx) give references. Of several corrections the one that is last by
    their order of columns counts.
    """
    known = chunks.groupBy("idx").agg(F.max("speaker").alias("_chunk"))
    rows = meta.join(known, "idx", "left")
    old = F.col("speaker").isNull()
    rows = rows.withColumn("corpus", F.when(old, F.when(F.col("_chunk").isNotNull(), "podcast").otherwise("tata")).otherwise(F.col("corpus")))
    rows = rows.withColumn("speaker", F.coalesce("speaker", "_chunk", F.lit("tata"))).drop("_chunk")
    if corrections is not None:
        last = corrections.groupBy("idx").agg(F.max(F.struct("speaker", "corpus", "group")).alias("_c"))
        rows = rows.join(last, "idx", "left")
        group = F.when(F.coalesce(F.col("_c.group"), F.lit("")) != "", F.col("_c.group")).otherwise(F.col("group"))
        rows = rows.withColumns({"speaker": F.coalesce("_c.speaker", "speaker"), "corpus": F.coalesce("corpus", "_c.corpus"), "group": group}).drop("_c")
    if refs is not None:
        last = refs.filter("coalesce(ref_idx, '') != ''").groupBy("idx").agg(F.max("ref_idx").alias("_r"))
        rows = rows.join(last, "idx", "left").withColumn("ref_idx", F.coalesce("_r", "ref_idx")).drop("_r")
    return rows


def newest_checkpoint(names: DataFrame) -> DataFrame:
    """(name, step) of the checkpoint folder ``...stepN...`` with the greatest step; none without one."""
    some = names.withColumn("step", F.regexp_extract("name", r"step_?(\d+)", 1)).filter("step != ''")
    return some.select("name", F.col("step").cast("long").alias("step")).orderBy(F.desc("step"), "name").limit(1)


def read_training_folder(spark: SparkSession, root: str) -> DataFrame:
    """(idx, speaker, corpus, audio, split) of a training folder: its ``manifest.csv`` with the splits of ``speaker_table.csv``.

    Of several rows of a speaker the last counts; without that table every split is null.
    """
    lines = lambda name, columns: _columns(spark, f"{root}/{name}", columns, sep=",")
    clips = lines("manifest.csv", ["idx", "corpus", "speaker"]).select("idx", "speaker", "corpus", F.concat(F.lit(f"{root.rstrip('/')}/wavs24/"), "idx", F.lit(".wav")).alias("audio"))
    try:
        return with_splits(clips, lines("speaker_table.csv", ["speaker", "split"]).select("line_no", "speaker", "split")).select("idx", "speaker", "corpus", "audio", "split")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return clips.withColumn("split", F.lit(None).cast("string"))


def read_located(spark: SparkSession, path: str, columns: list[str], most: int | None = None) -> DataFrame:
    """``columns`` of Parquet files with ``file`` and ``row``, where each row is to be found again; the first ``most`` of them.

    Only the named columns are read; the first rows are those by file and row.
    """
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *columns)
    return rows if most is None else rows.orderBy("file", "row").limit(most)
