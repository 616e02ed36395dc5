"""Registered queries on who speaks: best references, clusterings, clip statuses, purity runs; and on names, profiles and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import profiles, signals, spoken
from corpusloom.functions.vectors import unit
from corpusloom.operators import asof, clustering, containment, identity, partners, purity, scoring
from corpusloom.plans.catalog import DIM, clips, query, unit_vectors
from corpusloom.session import dealt, saved, table

UNITS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"""


@query("WITH " + UNITS + """, p AS (SELECT a.label, a.vec_id, b.vec_id AS ref_id, list_inner_product(a.e, b.e) AS c FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id)
  SELECT label, vec_id, ref_id, round(c, 6) AS cosine FROM p WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, ref_id) = 1""")
def best_references(spark, d):
    rows = unit_vectors(spark, d).select(F.col("label").alias("grp"), F.col("vec_id").alias("key"), F.col("e").alias("v"))
    found = partners.best_matches(rows, rows, 0.3, apart=True)
    return found.select(F.col("grp").alias("label"), F.col("key").alias("vec_id"), F.col("partner").alias("ref_id"), F.round("cosine", 6).alias("cosine"))


@query()
def episode_clusters(spark, d):
    rows = unit_vectors(spark, d).select(F.col("label").alias("grp"), F.col("vec_id").alias("key"), F.col("e").alias("v"))
    named = clustering.named_clusters(clustering.average_linkage(rows, 0.25, clustering.MOST))
    return named.select(F.col("grp").alias("show"), F.col("key").alias("vec_id"), "speaker")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as spans of speech: labels as episodes, lengths of 0.5 to 10.4 seconds."""
    seconds = (F.col("vec_id") * 37 % 100 + 5) / F.lit(10.0)
    return unit_vectors(spark, d).select(F.col("label").alias("grp"), F.col("vec_id").alias("key"), F.col("e").alias("v"), seconds.alias("seconds"))


@query()
def span_speakers(spark, d):
    return clustering.two_pass(saved(spans(spark, d), spark), DIM, link=0.2, keep=0.2, least_speech=15.0).select(F.col("grp").alias("episode"), F.col("key").alias("vec_id"), "speaker")


@query("WITH " + UNITS + """, s AS (SELECT *, vec_id % 3 AS ep, (vec_id * 37 % 100 + 5) / 10.0::DOUBLE AS seconds FROM u), parts AS (SELECT ep, label, i, sum(e[i]) AS t FROM s, generate_series(1, 64) AS g(i) WHERE seconds >= 2 GROUP BY ALL),
  c AS (SELECT ep, label, list(t / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(t * t) OVER (PARTITION BY ep, label)) AS n FROM parts) GROUP BY ALL), p AS (SELECT s.ep, vec_id, c.label AS cluster, list_inner_product(e, c) AS x FROM s JOIN c USING (ep) WHERE seconds < 2)
  SELECT ep AS episode, vec_id, cluster, round(x, 6) AS cosine FROM p WHERE x >= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, cluster) = 1""")
def assigned_spans(spark, d):
    seconds = (F.col("vec_id") * 37 % 100 + 5) / F.lit(10.0)
    own = saved(unit_vectors(spark, d).select((F.col("vec_id") % 3).alias("grp"), F.col("vec_id").alias("key"), F.col("label").alias("cluster"), F.col("e").alias("v"), seconds.alias("seconds")), spark)
    found = clustering.nearest_centroid(own.filter("seconds < 2"), clustering.centroids(own.filter("seconds >= 2"), DIM), 0.1)
    return found.select(F.col("grp").alias("episode"), F.col("key").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"), F.round("cosine", 6).alias("cosine"))


def voiced(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose vectors are those of the table, moved towards an axis of their label, so that labels hold together."""
    rows = table(spark, d, "embeddings").filter(F.size("embedding") == DIM).withColumnRenamed("label", "k")
    axis = lambda k, w: F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == k, w).otherwise(0.0))
    v = F.col("vec_id")
    e = unit(axis(F.col("k") + F.when(v % 11 == 5, 20).otherwise(0), F.when(v % 17 == 3, 0.4).otherwise(2.5)))
    return rows.select(
        v.alias("idx"), F.concat(F.lit("e"), (F.col("k") % 4).cast("string")).alias("tag"), F.concat(F.lit("e"), (F.col("k") % 4).cast("string"), F.lit(":"), "k").alias("label"),
        (F.lit(2.0) + v % 9).alias("seconds"), F.when(v % 29 != 7, e).alias("e"), F.when(v % 29 != 7, e).alias("h1"), unit(axis(F.col("k") + F.when(v % 13 == 1, 30).otherwise(0), F.lit(3.0))).alias("h2"), (v % 31 == 4).alias("bleeds"),
    )


@query()
def clip_identity(spark, d):
    found = identity.clip_identities(saved(voiced(spark, d), spark), DIM, link=0.75, half=0.45)
    return found.select("idx", "tag", "label", "sub", "speaker", "grp", "status", F.round("half_sim", 4).alias("half_sim"))


@query()
def purity_verdicts(spark, d):
    rows = voiced(spark, d).filter("e IS NOT NULL").select("idx", "e", F.concat("label", F.lit("/"), F.col("idx") % 2).alias("label"), F.when(F.col("idx") % 2 == 0, "train").otherwise("val").alias("split"))
    verdicts, _ = purity.purity_run(rows, DIM, "idx", split="split")
    return verdicts.select("label", "n", "status", "reasons", "nearest", F.round("nearest_cosine", 6).alias("nearest_cosine"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 5, 1 + p_partkey % 7) AS part FROM part) SELECT part, min(p_name) AS p_name FROM q JOIN n ON contains(p_name, part) GROUP BY part""")
def first_containing(spark, d):
    part = table(spark, d, "part")
    parts = part.select(F.substring("p_name", (1 + F.col("p_partkey") % 5).cast("int"), (1 + F.col("p_partkey") % 7).cast("int")).alias("part"))
    return containment.first_containing(parts, part, "part", "p_name")


#: The graphs of a sound profile, with a part's size in its lengths.
PROFILE = (
    '{"schema_version": %s, "name": "%s", "service": {"concurrency": %s, "cfg_scales": [1.0, %s]}, "stages": {"text_encoder": {"graphs": [{"batch_size": 1, "token_length": %s}]}, '
    '"backbone_prefill": {"graphs": [{"branch_batch_size": 1, "sequence_length": 32}, {"branch_batch_size": 2, "sequence_length": 64}]}, "backbone_decode": {"graphs": [{"branch_batch_size": 1}, {"branch_batch_size": 2}]}, '
    '"depth_decoder": {"graphs": [{"batch_size": %s}, {"batch_size": 2}]}, "codec": {"graphs": [{"num_lanes": %s, "chunk_frames": 4}]}}, "warmup_request": {"template": "tts", "text": "%s"}}'
)


@query("""WITH f AS (SELECT p_partkey, unnest([
    CASE WHEN p_partkey % 5 = 0 THEN {'path': '$.schema_version', 'reason': 'must be 1'} END, CASE WHEN p_partkey % 7 = 0 THEN {'path': '$.name', 'reason': 'must not be empty'} END,
    CASE WHEN p_partkey % 3 = 0 THEN {'path': '$.service.concurrency', 'reason': 'must be > 0'} END, CASE WHEN p_partkey % 3 = 2 THEN {'path': '$.service.concurrency', 'reason': 'must be 1'} END,
    CASE WHEN p_partkey % 11 = 0 THEN {'path': '$.service.cfg_scales', 'reason': 'must be >= 1'} END, CASE WHEN p_partkey % 13 = 0 THEN {'path': '$.warmup_request.text', 'reason': 'must not be empty'} END,
    CASE WHEN p_size % 32 <> 0 THEN {'path': '$.stages.text_encoder.graphs[0].token_length', 'reason': 'must be a multiple of 32'} END,
    CASE WHEN p_partkey % 4 = 0 THEN {'path': '$.stages.codec.graphs[0].num_lanes', 'reason': 'must be > 0'} END, CASE WHEN p_partkey % 4 > 1 THEN {'path': '$.stages.codec.graphs[0].num_lanes', 'reason': 'must be 1'} END,
    CASE WHEN p_partkey % 6 > 2 THEN {'path': '$.stages.depth_decoder.graphs', 'reason': 'must match cfg_scales'} END]) AS f FROM part)
  SELECT p_partkey, f.path AS path, f.reason AS reason FROM f WHERE f IS NOT NULL""")
def profile_faults(spark, d):
    k = F.col("p_partkey")
    doc = F.format_string(
        PROFILE, F.when(k % 5 == 0, 2).otherwise(1).cast("string"), F.when(k % 7 == 0, " ").otherwise("fast"), (k % 3).cast("string"), F.when(k % 11 == 0, "0.5, 2.0").otherwise("2.0"), F.col("p_size").cast("string"),
        F.when(k % 6 > 2, k % 6).otherwise(1).cast("string"), (k % 4).cast("string"), F.when(k % 13 == 0, "").otherwise(F.col("p_name")),
    )
    parts = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), spark)
    return parts.select("p_partkey", F.explode(profiles.profile_faults(doc)).alias("f")).select("p_partkey", "f.path", "f.reason")


@query("""WITH v AS (SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'user' ELSE 'val' END AS grp, c_custkey FROM customer), j AS (SELECT name || '__p' || r_regionkey AS key, name, grp, r_regionkey AS k, r_name AS phrase, c_custkey FROM v, region WHERE grp = 'user' OR r_regionkey IN (1, 3))
  SELECT key, name, grp, k, phrase FROM j WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = k)""")
def scoring_plan(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat("c_name", F.lit(".wav")).alias("audio"), F.col("c_mktsegment").alias("text"), F.array(F.lit("h.wav")).alias("heldout"))
    voices = scoring.plan_voices(customer.filter("c_custkey % 5 != 0"), customer.filter("c_custkey % 5 = 0"))
    phrases = scoring.phrase_plan(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("phrase")), [1, 3])
    done = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat("name", F.lit("__p"), F.col("o_orderkey") % 5).alias("key"))
    return scoring.jobs(voices, phrases, done).select("key", "name", "grp", "k", "phrase")


@query()
def truncated_pairs(spark, d):
    """A vector as a sound of 64 samples at 8 a second, and the text of the document of its number."""
    both = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    return both.select("vec_id", signals.truncated_pair(F.col("embedding"), F.col("text"), 8.0, 6.0, 8, 2, 6.0).alias("p")).select("vec_id", "p.kept", F.round("p.share", 6).alias("share"), F.md5("p.text").alias("digest"))


@query("""WITH b AS (SELECT DISTINCT p_size % 4 AS batch, p_size * 1000 AS size FROM part), k AS (SELECT doc_id, doc_id % 5 AS batch, n_chars FROM documents)
  SELECT doc_id, k.n_chars, b.size::BIGINT AS size FROM k ASOF LEFT JOIN b ON k.batch = b.batch AND k.n_chars <= b.size""")
def fitting_sizes(spark, d):
    sizes = table(spark, d, "part").select((F.col("p_size") % 4).cast("long").alias("batch"), (F.col("p_size") * 1000).cast("long").alias("size")).distinct()
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).alias("batch"), "n_chars")
    return asof.next_at_or_above(rows, sizes, ["batch"], "n_chars", "size", ["size"]).select("doc_id", "n_chars", F.col("fit.size").alias("size"))


@query(r"""WITH c AS (SELECT doc_id, n_chars / 15.0::DOUBLE AS dur, trim(regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), '–—', '--'), '…', '...'), '[^A-Za-zÀ-ÿ0-9 .,!?''’\-:;()"]+', ' ', 'g'), ' +', ' ', 'g'), ' -') AS t FROM documents), k AS (SELECT doc_id, t FROM c WHERE t <> '' AND length(t) / greatest(dur, 0.000001) BETWEEN 4 AND 30)
  SELECT doc_id, md5(upper(t[1]) || t[2:] || CASE WHEN t[-1] IN ('.', '!', '?') THEN '' ELSE '.' END) AS digest FROM k""")
def corpus_texts(spark, d):
    text = spoken.corpus_text(F.col("text"), F.col("n_chars") / F.lit(15.0), read=False)
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest")).filter("digest IS NOT NULL")


@query()
def read_corpus_texts(spark, d):
    """Cleaned texts with their numbers in words, of all clips whose length suits them."""
    return clips(spark, d).select("idx", F.md5(spoken.corpus_text(F.col("text"), F.length("text") / F.lit(15.0))).alias("digest")).filter("digest IS NOT NULL")
