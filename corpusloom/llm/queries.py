"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, chat, clusters, embedding_dedup, licenses, line_dedup, minhash, mixing, nearest, quality, runs, secrets, sql_texts, toxicity
from corpusloom.session import prepare, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "path", "line", "start", "stop", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark_lines(spark, table(spark, sf_dir, "documents"))
    gone = F.coalesce("chunks", F.array().cast("array<struct<start:int,stop:int,s:int,n:bigint,ch:bigint,first:boolean,w:bigint>>"))
    lines = F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), lines.cast("long").alias("n_lines"),
        F.aggregate(gone, F.lit(0).cast("long"), lambda n, c: n + c["stop"] - c["start"] + 1).alias("n_removed_lines"),
        F.aggregate(gone, F.lit(0).cast("long"), lambda n, c: n + c["w"]).alias("n_removed_words"),
        F.transform(gone, lambda c: F.struct(c["start"].alias("first_line"), c["stop"].alias("last_line"))).alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(spark, table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda m: m["first"])).cast("long").alias("last_word"),
        "base_labels", "labels", "score",
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cosines=False)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.with_copies(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, * FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_conversations(spark, rows))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"))


def op11_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.drift_clusters(spark, table(spark, sf_dir, "embeddings")).drop("scans")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.period_digests(table(spark, sf_dir, "documents"), plant=runs.planted)


def op13_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {name: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": sql_texts.OP4, "op6_source_mix": sql_texts.OP6, "op7_nn_descent": sql_texts.OP7, "op8_reply_trees": sql_texts.OP8, "op11_drift_clusters": sql_texts.OP11, "op13_block_join": sql_texts.OP13}
