"""Line dedup by content-defined chunks, with DataFrame expressions only.

Every line with a word gets a 64-bit hash; a rolling hash runs over windows of two line hashes. A boundary lies where
the rolling hash is 0 modulo ``divisor``, and where it occurs less often in the corpus than either of its two lines. An
insertion or a shift within a document moves no other boundary, and a passage shared by otherwise different documents is
cut out at its own ends: the lines of a chunk occur together or not at all. Chunks that occur again, in another document
or in the same, are compared byte by byte with their first occurrence (smallest id, then position). They are removed where
their lines belong to a run of two or more lines that always come together, or where they stand in a stretch of
``min_words`` words or more; a stretch goes on over two neighbouring chunks only where these two are neighbours in several
places. So a short line that happens to be common stays, beside whatever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import saved

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
DIVISOR = 8


def _lines(text: Column) -> Column:
    """array<struct<i,x>> of the lines with a word and their places among all lines."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), x))
    return F.filter(numbered, lambda e: e["x"].rlike(WORD))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text) and ``lines``: place, words, hash, rolling hash with the line before.

    Rows that repeat id and text are one document from here on.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(_lines(F.col(text_col)), F.array()).alias("lines"))
    counted = F.transform("lines", lambda e: F.struct(e["i"].alias("i"), F.regexp_count(e["x"], F.lit(WORD)).alias("w"), F.xxhash64(e["x"]).alias("h")))
    plain = plain.select("id", "th", counted.alias("a"))
    rolled = F.transform(
        "a",
        lambda e, j: F.struct(
            j.alias("s"), e["i"].alias("i"), e["w"].alias("w"), e["h"].alias("h"),
            F.when(j > 0, F.xxhash64(F.get("a", j - 1)["h"], e["h"])).alias("pair"),
        ),
    )
    return plain.select("id", "th", rolled.alias("lines")).groupBy("id", "th").agg(F.first("lines").alias("lines"))


def repeated_chunks(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, min_words: int, divisor: int) -> DataFrame:
    """(id, th, chunks): the repeated chunks in stretches of ``min_words`` or more, and all first occurrences.

    A chunk is a struct of first line, last line, hash and whether it is the chunk's first occurrence.
    """
    lines = saved(_hashed(docs, id_col, text_col), spark).select("id", "th", F.explode("lines").alias("l")).select("id", "th", "l.*")
    often = lines.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1")
    common = saved(lines.join(often, "h"), spark)
    pairs = common.filter("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("together"))
    within = Window.partitionBy("id", "th")
    # first lines of texts have no line before them: they are no key of the join
    rows = common.filter("pair IS NOT NULL").join(pairs, "pair").unionByName(common.filter("pair IS NULL").withColumn("together", F.lit(None).cast("long")))
    by_line = within.orderBy("s")
    # the line before is common too, and the two always come together
    bound = (F.lag("s").over(by_line) == F.col("s") - 1) & (F.lag("times").over(by_line) == F.col("together")) & (F.col("times") == F.col("together"))
    opens = F.when(F.coalesce(bound, F.lit(False)) & (F.pmod("pair", F.lit(divisor)) != 0), 0).otherwise(1)
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("chunk", F.sum("opens").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    # a run of lines that always come together may be cut by the hash; it is one repeated passage all the same
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(bound, F.lit(False)), 0).otherwise(1)).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy("id", "th", "chunk").agg(
        F.min("s").alias("s"), F.count("*").alias("n"), F.min("i").alias("start"), F.max("i").alias("stop"), F.sum("w").alias("w"), F.min("run").alias("run"),
        F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("s", "h"))), lambda e: e["h"])).alias("ch"),
    )
    by_place = within.orderBy("s")
    beside = F.lag("s").over(by_place) + F.lag("n").over(by_place) == F.col("s")
    chunks = chunks.withColumn("joint", F.when(beside, F.xxhash64(F.lag("ch").over(by_place), "ch")))
    chunks = saved(chunks.withColumn("lines", F.sum("n").over(Window.partitionBy("id", "th", "run"))), spark)
    place = F.struct(F.col("id").isNull(), "id", "th", "s")
    again = chunks.groupBy("ch", "n").agg(F.min(place).alias("least"), F.count("*").alias("places")).filter("places > 1").drop("places")
    joints = chunks.filter("joint IS NOT NULL").groupBy("joint").agg(F.count("*").alias("met")).filter("met > 1").select("joint", F.lit(True).alias("usual"))
    met = chunks.filter("joint IS NOT NULL").join(joints, "joint", "left").unionByName(chunks.filter("joint IS NULL").withColumn("usual", F.lit(None).cast("boolean")))
    twice = met.join(again, ["ch", "n"]).withColumn("first", place.eqNullSafe(F.col("least")))
    # first occurrences stay in, as what the others are compared with, and end a stretch
    goes_on = F.coalesce(F.col("usual") & (F.lag("s").over(by_place) + F.lag("n").over(by_place) == F.col("s")) & ~F.col("first") & ~F.lag("first").over(by_place), F.lit(False))
    stretches = twice.withColumn("gap", F.when(goes_on, 0).otherwise(1)).withColumn("stretch", F.sum("gap").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = stretches.withColumn("long", F.sum("w").over(Window.partitionBy("id", "th", "stretch")))
    stretches = stretches.filter((F.col("lines") > 1) | (F.col("long") >= min_words) | F.col("first"))
    return stretches.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "s", "n", "ch", "first", "w"))).alias("chunks"))


def mark_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, divisor: int = DIVISOR) -> DataFrame:
    """``row`` (struct of the input's columns), ``chunks`` to remove (or null) and ``text`` without them.

    A null text stays null; an empty one has no lines; null ids order last; rows that repeat id and text lose the same
    lines; an empty table gives an empty result. Extra columns stay inside ``row``, so their names cannot clash.
    Lines without a word never begin or end a chunk, and go with the chunk they stand in.
    """
    found = saved(repeated_chunks(spark, docs, id_col, text_col, min_words, divisor), spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("id_", F.col(f"row.{id_col}")).withColumn("th_", F.xxhash64(f"row.{text_col}"))
    same = F.col("id_").eqNullSafe(F.col("id")) & (F.col("th_") == F.col("th"))
    # the one shuffle of the texts; what follows reads this table
    marked = saved(rows.join(found, same, "left").select("row", "id_", "th_", "chunks"), spark)
    text = F.col(f"row.{text_col}")
    parts = marked.filter("chunks IS NOT NULL").select("id_", "th_", "chunks", F.transform(_lines(text), lambda e: e["x"]).alias("lines"))
    told = lambda c: F.struct(c["start"].alias("start"), c["ch"].alias("ch"), c["first"].alias("first"), F.array_join(F.slice("lines", c["s"] + 1, c["n"].cast("int")), "\n").alias("said"))
    parts = parts.select("id_", "th_", F.explode(F.transform("chunks", told)).alias("c")).select("id_", "th_", "c.*")
    model = parts.filter("first").select("ch", F.col("said").alias("model")).dropDuplicates(["ch"])
    differ = parts.filter("NOT first").join(model, "ch").filter("said != model")
    # equal hashes of different bytes: next to none, so the planner sees a tiny table here
    spared = saved(differ.groupBy(F.col("id_").alias("id"), F.col("th_").alias("th")).agg(F.collect_set("start").alias("spared")), spark)
    out = marked.join(spared, F.col("id_").eqNullSafe(F.col("id")) & (F.col("th_") == F.col("th")), "left")
    gone = F.filter("chunks", lambda c: ~c["first"] & ~F.coalesce(F.array_contains("spared", c["start"]), F.lit(False)))
    out = out.select("row", gone.alias("chunks"), F.split(text, "\n").alias("lines"))
    # what is left is a slice before each chunk and one after the last
    ends = F.transform("chunks", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))
    ends = F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"))), ends, F.array(F.struct(F.size("lines").alias("start"), F.lit(0).alias("stop"))))
    out = out.withColumn("ends", F.when(F.size("chunks") > 0, ends))
    rest = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda j: F.slice("lines", F.get("ends", j - 1)["stop"] + 2, F.get("ends", j)["start"] - F.get("ends", j - 1)["stop"] - 1))
    return out.select("row", "chunks", F.when(F.col("ends").isNotNull(), F.array_join(F.flatten(rest), "\n")).otherwise(text).alias("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with the texts left; rows of which nothing is left, though they had a word, are dropped."""
    marked = mark_lines(spark, docs, id_col, text_col, min_words, divisor)
    marked = marked.filter((F.coalesce(F.size("chunks"), F.lit(0)) == 0) | F.col("text").rlike(WORD))
    return marked.select(F.col("row").withField(text_col, F.col("text")).alias("row")).select("row.*")
