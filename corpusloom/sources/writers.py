"""Writers of tables, lists and reports. All write through Spark's committers, so a lost task leaves no half of a file."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.ranks import ranked


def append_ledger(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Add rows to a ledger of JSON lines, tables with headers or Parquet; each job adds its files as a whole or not at all."""
    rows.write.format(kind).options(**({"header": True} if kind == "csv" else {})).mode("append").save(path)


def write_manifest(rows: DataFrame, path: str, sep: str = ",", plain: bool = False) -> None:
    """A table with a header; ``plain`` puts single quotes for double ones, for readers that know no quotes."""
    if plain:
        rows = rows.withColumns({n: F.replace(F.col(n), F.lit('"'), F.lit("'")) for n, kind in rows.dtypes if kind == "string"})
    rows.write.csv(path, sep=sep, header=True, quote='"', escape='"', mode="overwrite")


def write_splits(rows: DataFrame, path: str, key: str = "idx") -> None:
    """A folder a split with its clips' names, a line each."""
    rows.select(F.col(key).cast("string").alias("value"), "split").write.partitionBy("split").mode("overwrite").text(path)


def replace_table(spark: SparkSession, rows: DataFrame, path: str, backup: bool = True) -> None:
    """Write ``rows`` beside ``path`` and put them there when they are whole; the table before goes to ``path.bak``.

    ``rows`` may read the table that is replaced.
    """
    rows.write.parquet(f"{path}.new", mode="overwrite")
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.delete(at(f"{path}.bak"), True)
        files.rename(at(path), at(f"{path}.bak"))
    files.rename(at(f"{path}.new"), at(path))
    if not backup:
        files.delete(at(f"{path}.bak"), True)


def purity_tables(verdicts: DataFrame, clips: DataFrame, pairs: DataFrame, key: str, label: str = "label") -> dict[str, DataFrame]:
    """The tables of a purity run: speakers, clips, duplicates, and the speakers and clips to leave out.

    Clips are left out one by one only where their speaker is not left out as a whole.
    """
    bad = verdicts.filter("status = 'RUIM'").select(label)
    return {
        "speakers": verdicts, "clips": clips, "duplicates": pairs, "exclude_speakers": bad,
        "exclude_clips": clips.filter("outlier").join(bad, label, "left_anti").select(key),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.csv(f"{path}/{name}", header=True, quote='"', escape='"', mode="overwrite")


def markdown(rows: DataFrame, order: list[str], title: str) -> DataFrame:
    """(line_no, line): a report of a small aggregate as a Markdown table, in the given order."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    body = rows.select(F.struct(*order).alias("by"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    lines = body.agg(F.concat(F.array(*map(F.lit, head)), F.transform(F.array_sort(F.collect_list(F.struct("by", "line"))), lambda x: x["line"])).alias("all"))
    return lines.select(F.posexplode("all").alias("line_no", "line"))


def first_sources(assets: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, missing): the asset (``key``, source, priority) of the first source for each wanted key, and keys without."""
    first = assets.groupBy(key).agg(F.min_by("source", F.struct("priority", "source")).alias("source"))
    return wanted.join(first, key), wanted.join(first, key, "left_anti")


def html_table(rows: DataFrame, order: list[str], title: str) -> DataFrame:
    """(line_no, line): a report as an HTML page, a line a row, in the given order; signs of HTML are escaped.

    Lines are numbered by range, so a long report is many tasks.
    """
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in rows.columns])
    body = ranked(rows.select(*order, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("line"), F.lit(1).alias("_one")), "_one", [F.col(c) for c in order], "_at")
    heads = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    start = f"<html><meta charset='utf-8'><h1>{escape(title)}</h1><table><tr>{heads}</tr>"
    edge = lambda no, line: rows.sparkSession.range(1).select(no.alias("line_no"), F.lit(line).alias("line"))
    count = body.agg((F.count("*") + 1).alias("line_no")).select("line_no", F.lit("</table></html>").alias("line"))
    return edge(F.lit(0).cast("long"), start).unionByName(body.select((F.col("_at") + 1).alias("line_no"), "line")).unionByName(count)


def write_report(rows: DataFrame, path: str) -> None:
    """A report's lines (line_no, line) as one text in order: its parts are sorted by range, and read in the order of names."""
    rows.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_json_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, nulls kept."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def append_csv(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add rows to a table whose header stands once, in a file of its own that sorts before all others.

    Read together in the order of names the files are one table with one header. Columns must be those of the header.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    head = hadoop.Path(f"{path}/part-0-header.csv")
    files = head.getFileSystem(spark._jsc.hadoopConfiguration())
    line = ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    if files.exists(head):
        found = spark.read.text(str(head.toString())).first()[0]
        if found != line:
            raise ValueError(f"the table's header is {found}")
    else:
        out = files.create(head, False)
        out.write(bytearray((line + "\n").encode()))
        out.close()
    rows.write.mode("append").csv(path, header=False, quote='"', escape='"')
