"""Chat formatting of reply trees, with DataFrame expressions only.

A node is a message with a parent. Iterated self-joins double the distance to an ancestor each time, which gives every
node its depth and the score of the path above it after log2(depth) joins; leaves are ranked by that score, and the
nodes of each chosen root-to-leaf path are listed with the same jump tables, bit by bit of their distance.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed per message. In texts, ``<turn`` and ``</turn`` get a backslash
after the ``<``, and one more where backslashes already stand there; taking one away restores any text. Roles are
URL-encoded. The loss mask lists the code-point ranges of the assistant's (escaped) texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import saved

LOSS_ROLE = "assistant"
CLOSE = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def nodes_from_turns(rows: DataFrame) -> DataFrame:
    """conv_id, node, parent, role, text, score: each row answers the row before it, by turn.

    Equal turns stand in the order of role, then text; a null turn comes first; null texts and roles are empty.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    out = rows.select("conv_id", node.alias("node"), "role", "text", F.length("text").cast("double").alias("score"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def jump_tables(spark: SparkSession, nodes: DataFrame, most: int = 40) -> list[DataFrame]:
    """Tables (conv_id, node, far, steps, total): ``far`` is the ancestor 2^k above, null past the root.

    ``steps`` and ``total`` count and score the nodes from ``node`` up to below ``far``. A parent that is not in the
    conversation makes its child a root; a cycle of parents is an error.
    """
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("p"))
    first = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left")
    tables = [saved(first.select("conv_id", "node", F.col("p").alias("far"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), spark)]
    while tables[-1].filter("far IS NOT NULL").limit(1).count():
        if len(tables) > most:
            raise ValueError("the parents form a cycle")
        a = tables[-1]
        b = a.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("far").alias("far2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        both = a.join(b, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("far") == F.col("n")), "left")
        both = both.select("conv_id", "node", F.col("far2").alias("far"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        tables.append(saved(both, spark))
    return tables


def chosen_paths(spark: SparkSession, nodes: DataFrame, top: int = 1, salts: int = 16) -> DataFrame:
    """(conv_id, branch, position, node) of the ``top`` root-to-leaf paths of each conversation by mean score.

    Ties go to the smaller leaf. Leaves are ranked in salted parts first, so that a conversation with very many
    branches is not one task's work.
    """
    tables = jump_tables(spark, nodes)
    parents = nodes.filter("parent IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = tables[-1].join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    order = [F.desc(F.col("total") / F.col("steps")), F.asc("node")]
    leaves = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id", "salt").orderBy(*order))).filter(F.col("branch") <= top)
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).filter(F.col("branch") <= top)
    rows = leaves.select("conv_id", "branch", "steps", F.col("node").alias("at"), F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("up"))
    for k in reversed(range(len(tables) - 1)):
        far = tables[k].select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "far")
        bit = F.shiftright("up", k).bitwiseAND(F.lit(1)) == 1
        rows = rows.join(far, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n")), "left").select("conv_id", "branch", "steps", "up", F.when(bit, F.col("far")).otherwise(F.col("at")).alias("at"))
        # each join is made once, and a lost executor costs one step
        rows = saved(rows, spark)
    return rows.select("conv_id", "branch", (F.col("steps") - 1 - F.col("up")).alias("position"), F.col("at").alias("node"))


def format_paths(paths: DataFrame, nodes: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, branch, formatted, loss array<struct<start,stop>> (code points, stop excluded)."""
    texts = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    rows = paths.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit("<turn "), F.url_encode("role"), F.lit(">"))
    turn = F.struct("position", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("learn"))
    grouped = rows.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        a = state["at"] + F.length(t["head"])
        b = a + F.length(t["body"])
        span = F.struct(a.alias("start"), b.alias("stop"))
        return F.struct((b + len(CLOSE)).alias("at"), F.when(t["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return grouped.select("conv_id", "branch", formatted.alias("formatted"), F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss"))


def format_conversations(spark: SparkSession, rows: DataFrame, top: int = 1) -> DataFrame:
    """The formatted conversations of a table (conv_id, turn, role, text).

    A null conv_id is a conversation like any other; null texts are empty; repeated rows are messages of their own;
    an empty table gives an empty result; other columns are not looked at.
    """
    nodes = saved(nodes_from_turns(rows), spark)
    return format_paths(chosen_paths(spark, nodes, top), nodes)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, branch, roles, texts (all turns) and learned (text under the loss mask), from the output alone."""
    parts = F.split("formatted", CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select(
        "conv_id", "branch", "formatted",
        F.transform(parts, lambda p: F.url_decode(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>", 1))).alias("roles"),
        F.transform(parts, lambda p: unescaped(F.regexp_replace(p, r"(?s)^<turn [^>]*>", ""))).alias("texts"),
        F.array_join(learned, "").alias("learned"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of each formatted conversation, read back from it."""
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
