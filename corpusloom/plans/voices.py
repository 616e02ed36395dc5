"""Registered queries on voices and on what is read aloud: two voices, refined and linked labels, spoken text, draws, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import spoken, text as tx
from corpusloom.operators import decoding, purity, sampling, similarity
from corpusloom.operators.linkage import complete_linkage
from corpusloom.plans.catalog import DIM, LOO, U, query, unit_vectors
from corpusloom.session import dealt, saved, table

AMOUNT = "(CASE WHEN o_totalprice < 0 THEN 0 ELSE round(o_totalprice * 100) END)::BIGINT"


@query(f"""WITH t AS (SELECT o_orderkey, {AMOUNT} // 100 AS whole, {AMOUNT} % 100 AS cents, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
  SELECT o_orderkey, 'Pedido ' || {spoken.spoken_sql('o_orderkey')} || ': ' || {spoken.spoken_sql('whole')} || CASE WHEN whole = 1 THEN ' real' ELSE ' reais' END
    || CASE WHEN cents > 0 THEN ' e ' || {spoken.spoken_sql('cents')} || CASE WHEN cents = 1 THEN ' centavo' ELSE ' centavos' END ELSE '' END
    || ' em ' || CASE WHEN d = 1 THEN 'primeiro' ELSE {spoken.spoken_sql('d')} END || ' de ' || [{', '.join(f"'{m}'" for m in spoken.MONTHS)}][m] || ' de ' || {spoken.spoken_sql('y')} AS said FROM t""")
def spoken_orders(spark, d):
    cents = F.round(F.greatest("o_totalprice", F.lit(0.0)) * 100).cast("long")
    price = F.concat(F.floor(cents / F.lit(100)).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("Pedido "), "o_orderkey", F.lit(": R$ "), price, F.lit(" em "), F.date_format("o_orderdate", "d/M/yyyy"))
    return spoken.spoken(dealt(table(spark, d, "orders").select("o_orderkey", line.alias("line")), spark), "line", "said").select("o_orderkey", "said")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, (30 + doc_id % 6 * 10)::DOUBLE / 100::DOUBLE AS share FROM documents),
  k AS (SELECT doc_id, len(w) AS n, greatest(4, round_even(len(w) * share, 0)::BIGINT) AS kept, w FROM w), s AS (SELECT doc_id, n, kept, array_to_string(w[1:kept], ' ') AS s FROM k)
  SELECT doc_id, CASE WHEN regexp_matches(s || ' ', '[.!?;:]\s') THEN regexp_replace(regexp_extract(s || ' ', '(?s)^(.*)[.!?;:]\s', 1), '^\s+|\s+$', '', 'g')
    WHEN kept < n AND contains(s, ',') THEN regexp_replace(regexp_extract(s, '(?s)^(.*),', 1), '^\s+|\s+$', '', 'g') ELSE s END AS kept FROM s""")
def truncated_texts(spark, d):
    share = (30 + F.col("doc_id") % 6 * 10) / F.lit(100.0)
    return table(spark, d, "documents").select("doc_id", tx.truncated_words(F.col("text"), share).alias("kept"))


@query("""WITH b AS (SELECT event_id, user_id, event_type, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM events)
  SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN block % 2 = 0 THEN -101 ELSE 262144 END WHEN 'purchase' THEN 262145 ELSE -100 END::INT AS target FROM b""")
def frame_labels(spark, d):
    events = table(spark, d, "events")
    blocks = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").cast("int").alias("blocks"))
    policies = F.transform(F.sequence(F.lit(0), F.col("blocks")), lambda i: F.when(i % 2 == 0, "first").otherwise("train"))
    return decoding.frame_labels(events.join(blocks, "user_id"), "user_id", ["event_id"], "event_type", "view", "purchase", policies, (262144, 262145)).select("event_id", "target")


@query(f"""WITH p AS (SELECT p_partkey, p_size::HUGEINT AS w FROM part WHERE p_size > 0), c AS (SELECT p_partkey, sum(w) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - w AS lo, w FROM p),
  t AS (SELECT sum(w) AS total FROM p), i AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS draw FROM orders),
  q AS (SELECT draw, floor({U.format("'42|weighted|' || draw::VARCHAR")} * total::DOUBLE)::HUGEINT AS place FROM i, t) SELECT draw::BIGINT AS draw, p_partkey FROM q JOIN c ON place >= lo AND place < lo + w""")
def weighted_draws(spark, d):
    return sampling.weighted_draws(table(spark, d, "part"), "p_partkey", "p_size", table(spark, d, "orders").count())


def voices(spark, d):
    """Vectors of two labels under one name: labels 2k and 2k + 1 are one voice here."""
    rows = unit_vectors(spark, d)
    return rows.select("vec_id", F.floor(F.col("label") / 2).cast("int").alias("label"), "e")


@query()
def two_voice_labels(spark, d):
    rows = saved(voices(spark, d), spark)
    found = purity.two_voices(purity.two_means(rows, DIM, "vec_id"), DIM)
    return purity.voice_verdicts(purity.label_verdicts(rows, DIM), found).select("label", "n", "two_voices", "status", "reasons")


HALVES = LOO.replace("SELECT vec_id, label, list_transform", "SELECT vec_id, label || '/' || (vec_id % 2) AS label, list_transform")


@query("WITH " + HALVES + """, m AS (SELECT label, median(loo) AS med FROM loo GROUP BY ALL), a AS (SELECT label, 1.4826 * median(abs(loo - med)) AS mad FROM loo JOIN m USING (label) GROUP BY ALL),
  o AS (SELECT vec_id, label, ((med - loo > 3 * greatest(mad, 0.02)) AND med - loo >= 0.1) OR loo < 0.3 AS outlier FROM loo JOIN m USING (label) JOIN a USING (label)), clean AS (SELECT DISTINCT label FROM o WHERE NOT outlier),
  used AS (SELECT vec_id, label FROM o WHERE NOT outlier UNION ALL SELECT vec_id, label FROM e WHERE label NOT IN (SELECT label FROM clean)), t AS (SELECT label, i, sum(x) AS t FROM parts JOIN used USING (vec_id, label) GROUP BY ALL),
  c AS (SELECT label, i, t / sqrt(sum(t * t) OVER (PARTITION BY label)) AS c FROM t) SELECT p.label AS a, q.label AS b, round(sum(p.c * q.c), 7) AS cosine FROM c p JOIN c q ON p.i = q.i AND p.label < q.label GROUP BY ALL HAVING sum(p.c * q.c) >= 0.1""")
def doubled_labels(spark, d):
    rows = unit_vectors(spark, d)
    halves = rows.withColumn("label", F.concat("label", F.lit("/"), F.col("vec_id") % 2))
    return purity.doubled_labels(halves, DIM, least=0.1).select("a", "b", F.round("cosine", 7).alias("cosine"))


@query()
def refined_labels(spark, d):
    return purity.refined_labels(saved(voices(spark, d), spark), DIM, "vec_id")


@query()
def linked_labels(spark, d):
    rows = unit_vectors(spark, d)
    parts = saved(rows.withColumn("label", F.concat("label", F.lit("/"), F.col("vec_id") % 5)), spark)
    return complete_linkage(parts.select("label"), similarity.near_labels(parts, DIM, 0.3), "label")
