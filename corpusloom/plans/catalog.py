"""The registered queries of the library's own operators, each with its SQL for DuckDB.

``clips`` stands for a table of speech clips: documents as utterances, language as corpus, source and a residue of the
id as speaker (one residue being the unassigned bucket), a duration from the text's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.keys import draw, gender, group_key, order_key, voice_key
from corpusloom.operators import decoding, evaluation, identity, intervals, purity, relational, sampling, selection, similarity, splits
from corpusloom.operators.graph import components
from corpusloom.session import prepare, saved, table

DIM = 64
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CLIPS = """WITH clips AS (
  SELECT CAST(doc_id AS VARCHAR) AS idx, lang AS corpus,
    source || ':' || CASE WHEN doc_id % 7 = 3 THEN '99' ELSE CAST(doc_id % 2 AS VARCHAR) END AS speaker,
    text, (200 + n_chars % 1000)::DOUBLE / 100::DOUBLE AS dur,
    CASE (length(source) + doc_id % 2) % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender
  FROM documents)"""
USABLE = CLIPS + """, usable AS (
  SELECT * FROM clips WHERE speaker <> '' AND NOT suffix(speaker, ':99') AND dur BETWEEN 2.5::DOUBLE AND 10.2::DOUBLE AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 8)"""
HELD = USABLE + """, grouped AS (SELECT *, corpus || '/' || speaker AS grp FROM usable), sizes AS (
  SELECT corpus, grp, count(*) AS n FROM grouped GROUP BY ALL), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sha1('42|hold|' || grp)) AS rank, count(*) OVER (PARTITION BY corpus) AS eligible FROM sizes WHERE n >= 3), cuts AS (
  SELECT *, greatest(0, least(3, eligible - 1)) AS val FROM ranked), cuts2 AS (
  SELECT *, greatest(0, least(3, eligible - val - 1)) AS tst FROM cuts), split AS (
  SELECT g.*, CASE WHEN c.rank <= val THEN 'val' WHEN c.rank <= val + tst THEN 'test' ELSE 'train' END AS split FROM grouped g LEFT JOIN cuts2 c USING (corpus, grp))"""


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL does it: scaled first, so that 3.8499999999999996 is 38.5 tenths and gives 3.9.

    Spark's own rounding goes by the decimal digits of the double and gives 3.8 there.
    """
    return F.round(x * 10.0**digits) / 10.0**digits


def clips(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    speaker = F.concat("source", F.lit(":"), F.when(F.col("doc_id") % 7 == 3, "99").otherwise((F.col("doc_id") % 2).cast("string")))
    kind = (F.length("source") + F.col("doc_id") % 2) % 3
    return docs.select(
        F.col("doc_id").cast("string").alias("idx"), F.col("lang").alias("corpus"), speaker.alias("speaker"), "text",
        ((200 + F.col("n_chars") % 1000) / F.lit(100.0)).alias("dur"), F.when(kind == 0, "F").when(kind == 1, "M").alias("gender"),
    )


def usable(spark: SparkSession, d: str) -> DataFrame:
    return selection.usable(clips(spark, d))


def held(spark: SparkSession, d: str) -> DataFrame:
    return splits.holdout_split(usable(spark, d), 3, 3, least=3)


# selection -----------------------------------------------------------------------------------------------------------


@query(USABLE + " SELECT idx, corpus, speaker, dur FROM usable")
def usable_clips(spark, d):
    return usable(spark, d).select("idx", "corpus", "speaker", "dur")


@query(CLIPS + """ SELECT idx, corpus || '/' || speaker AS grp, corpus || '|' || speaker AS voice,
  CASE WHEN gender = 'F' THEN 'F' WHEN gender = 'M' THEN 'M' END AS sex FROM clips""")
def clip_keys(spark, d):
    c = clips(spark, d)
    return c.select("idx", group_key(F.col("corpus"), F.col("speaker")).alias("grp"), voice_key(F.col("corpus"), F.col("speaker"), F.col("idx")).alias("voice"), gender(F.when(F.col("gender") == "F", "Female_x").otherwise(F.lower("gender"))).alias("sex"))


@query(USABLE + """ SELECT idx, corpus, speaker FROM (SELECT *, count(*) OVER (PARTITION BY corpus, speaker) AS n,
  row_number() OVER (PARTITION BY corpus, speaker ORDER BY sha1('42|' || idx)) AS r FROM usable) WHERE n >= 2 AND r <= 4""")
def voice_cap(spark, d):
    return selection.cap_per_speaker(usable(spark, d), 4, 2).select("idx", "corpus", "speaker")


VOICES = USABLE + """, voices AS (SELECT corpus, speaker, count(*)::BIGINT AS n_clips, min(gender) AS gender FROM usable GROUP BY ALL)"""


@query(VOICES + """ SELECT corpus, speaker, n_clips, gender, rank FROM (SELECT *, row_number() OVER (PARTITION BY gender
  ORDER BY sha1('42|v|' || corpus || '|' || speaker))::INT AS rank FROM voices WHERE gender IS NOT NULL AND n_clips >= 2) WHERE rank <= 10""")
def gender_top_voices(spark, d):
    return selection.top_voices_by_gender(usable(spark, d), 10, 2).select("corpus", "speaker", "n_clips", "gender", "rank")


@query(VOICES + """, r AS (SELECT *, row_number() OVER (PARTITION BY corpus, gender ORDER BY sha1('42|gen|' || corpus || '|' || speaker)) AS rank
  FROM voices WHERE corpus IN ('en', 'fr') AND gender IS NOT NULL), q AS (
  SELECT *, least(sum((gender = 'F')::INT) OVER (PARTITION BY corpus), sum((gender = 'M')::INT) OVER (PARTITION BY corpus)) AS most FROM r)
  SELECT idx, corpus, speaker FROM usable WHERE corpus NOT IN ('en', 'fr') OR (corpus, speaker) IN (SELECT (corpus, speaker) FROM q WHERE rank <= most)""")
def gender_balance(spark, d):
    return selection.balance_gender(usable(spark, d), ("en", "fr")).select("idx", "corpus", "speaker")


@query("""WITH items AS (SELECT o_custkey AS grp, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS item, l_quantity AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sha1(item), item, size)::INT AS turn FROM items),
  s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY turn, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT grp, item, size, turn FROM s WHERE before < 200000""")
def round_robin_budget(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select(F.col("o_custkey").alias("grp"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.col("l_quantity").alias("size"))
    return selection.round_robin_budget(items, "item", "grp", "size", 200000.0).select("grp", "item", "size", "turn")


@query(USABLE + """, n AS (SELECT corpus, count(*) AS n FROM usable GROUP BY ALL), k AS (
  SELECT corpus, n, least(n, greatest(2, round_even(60 * sqrt(n) / (SELECT sum(sqrt(n)) FROM n), 0)::INT)) AS k FROM n), p AS (
  SELECT corpus, unnest(range(k)) AS pick, n, k FROM k), r AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sha1(idx)) - 1 AS place FROM usable)
  SELECT corpus, pick::INT AS pick, idx FROM p JOIN r USING (corpus) WHERE place = (pick * n) // k""")
def systematic_sample(spark, d):
    return selection.systematic_sample(usable(spark, d), "corpus", [order_key(F.col("idx"))], 60, 2).select("corpus", F.col("pick").cast("int").alias("pick"), "idx")


@query(USABLE + """, v AS (SELECT corpus, speaker, min(idx) AS prompt FROM usable WHERE dur BETWEEN 4::DOUBLE AND 9::DOUBLE GROUP BY ALL), t AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY speaker)::INT AS turn, list_position(['fr', 'en', 'es', 'de'], corpus) AS place FROM v)
  SELECT corpus, speaker, prompt, turn FROM t ORDER BY turn, place LIMIT 18""")
def evaluation_voices(spark, d):
    return selection.evaluation_voices(usable(spark, d), ["fr", "en", "es", "de"], 18)


@query(USABLE + """ SELECT corpus, idx FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY dur, idx) AS r, count(*) OVER (PARTITION BY corpus) AS n FROM usable) WHERE r = n // 2 + 1""")
def middle_pick(spark, d):
    return selection.middle_pick(usable(spark, d), ["dur", "idx"]).select("corpus", "idx")


# splits --------------------------------------------------------------------------------------------------------------


@query(HELD + " SELECT idx, grp, split FROM split")
def holdout_split(spark, d):
    return held(spark, d).select("idx", "grp", "split")


@query(HELD + """ SELECT idx, split FROM (SELECT *, row_number() OVER (PARTITION BY split, corpus, speaker ORDER BY sha1('42|cap|' || idx)) AS r FROM split) WHERE split = 'train' OR r <= 2""")
def heldout_cap(spark, d):
    return splits.heldout_cap(held(spark, d), 2).select("idx", "split")


@query(HELD + """, per AS (SELECT split, corpus, count(*)::BIGINT AS clips, round_even(sum(dur) / 3600, 2) AS hours,
  count(DISTINCT corpus || '|' || speaker)::BIGINT AS voices, count(DISTINCT grp)::BIGINT AS groups FROM split GROUP BY ALL)
  SELECT * FROM per UNION ALL SELECT split, '_total', sum(clips)::BIGINT, round_even(sum(hours), 2), sum(voices)::BIGINT, sum(groups)::BIGINT FROM per GROUP BY split""")
def split_summary(spark, d):
    return splits.split_summary(held(spark, d)).select("split", "corpus", "clips", "hours", "voices", "groups")


@query(HELD + " SELECT split, corpus, grp, speaker, count(*)::BIGINT AS n_clips, round_even(sum(dur) / 3600, 4) AS hours FROM split GROUP BY ALL")
def voice_table(spark, d):
    return splits.voice_table(held(spark, d))


@query("""WITH s AS (SELECT source AS grp, lang AS corpus, source AS speaker, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents)
  SELECT 'group' AS kind, grp AS key, count(DISTINCT split)::BIGINT AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS which FROM s GROUP BY grp HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'speaker', corpus || '/' || speaker, count(DISTINCT split), string_agg(DISTINCT split, ',' ORDER BY split) FROM s GROUP BY corpus, speaker HAVING count(DISTINCT split) > 1""")
def leak_audit(spark, d):
    docs = table(spark, d, "documents")
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    return splits.leak_audit(docs.select(F.col("source").alias("grp"), F.col("lang").alias("corpus"), F.col("source").alias("speaker"), split.alias("split"))).select("kind", "key", "splits", "which")


def _filled(split: int, rows: str) -> str:
    """SQL: where no group of a corpus of three or more is in ``split``, its smallest train group is."""
    return f"""(SELECT * EXCLUDE (s, has, trained, k), CASE WHEN s = 0 AND k = 1 AND groups >= 3 AND trained > 1 AND NOT has THEN {split} ELSE s END AS s FROM (
    SELECT *, bool_or(s = {split}) OVER (PARTITION BY corpus) AS has, count(*) FILTER (s = 0) OVER (PARTITION BY corpus) AS trained,
      row_number() OVER (PARTITION BY corpus, s ORDER BY n, tie) AS k FROM {rows}))"""


_LACKS = ", ".join(f"CASE WHEN h{s} + n <= {share}::DOUBLE * total * 1.5::DOUBLE THEN {share}::DOUBLE * total - h{s} ELSE '-inf'::DOUBLE END AS l{s}" for s, share in enumerate((0.9, 0.05, 0.05)))
DEALT = USABLE.replace("WITH clips", "WITH RECURSIVE clips", 1) + f""", sizes AS (
  SELECT corpus, corpus || '/' || speaker AS grp, count(*) AS n FROM usable GROUP BY ALL), ordered AS (
  SELECT *, sha1('42|' || grp) AS tie, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, sha1('42|' || grp)) AS r,
    count(*) OVER (PARTITION BY corpus) AS groups, CAST(sum(n) OVER (PARTITION BY corpus) AS BIGINT) AS total FROM sizes), dealt AS (
  SELECT corpus, 0::BIGINT AS r, 0::BIGINT AS h0, 0::BIGINT AS h1, 0::BIGINT AS h2, 0 AS s FROM ordered WHERE r = 1
  UNION ALL SELECT corpus, r, h0 + n * (s = 0)::INT, h1 + n * (s = 1)::INT, h2 + n * (s = 2)::INT, s FROM (
    SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS s FROM (
      SELECT o.corpus, o.r, o.n, h0, h1, h2, {_LACKS} FROM dealt d JOIN ordered o ON o.corpus = d.corpus AND o.r = d.r + 1))), placed AS (
  SELECT o.*, d.s FROM dealt d JOIN ordered o ON o.corpus = d.corpus AND o.r = d.r)"""


@query(DEALT + f""" SELECT corpus, grp, n, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM {_filled(2, _filled(1, "placed"))}""")
def deficit_split(spark, d):
    return splits.deficit_split(usable(spark, d))


# relational ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_wins(spark, d):
    return relational.one_per_key(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_wins(spark, d):
    return relational.one_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


OVER = """ch AS (SELECT CAST(doc_id AS VARCHAR) AS idx, CASE WHEN quality = 0 THEN 'noise' END AS speaker, CASE WHEN toxic = 1 THEN 'flag' ELSE '' END AS grp FROM labels)"""


def _changes(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("idx"), F.when(F.col("quality") == 0, "noise").alias("speaker"), F.when(F.col("toxic") == 1, "flag").otherwise("").alias("grp"))


@query(CLIPS + ", " + OVER + """ SELECT idx, coalesce(ch.speaker, c.speaker) AS speaker, CASE WHEN coalesce(ch.grp, '') <> '' THEN ch.grp ELSE c.corpus || '/' || c.speaker END AS grp FROM clips c LEFT JOIN ch USING (idx)""")
def override_join(spark, d):
    rows = splits.with_groups(clips(spark, d)).select("idx", "speaker", "grp")
    return relational.override(rows, _changes(spark, d), "idx", ["speaker"], if_set=["grp"])


@query("SELECT doc_id, coalesce(quality::INT, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def default_join(spark, d):
    return relational.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", F.lit(-1))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ledger_resume(spark, d):
    return relational.not_done(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_split(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""WITH r AS (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 8000 THEN 'long' WHEN text LIKE '%|%' THEN 'table' ELSE 'kept' END AS reason FROM documents)
  SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def drop_reasons(spark, d):
    docs = table(spark, d, "documents")
    return relational.drop_reasons(docs, [("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 8000), ("table", F.col("text").contains("|"))]).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT n_name, r_name, count(*)::BIGINT AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def registry_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))


@query("""SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def keyed_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")).distinct())


# sampling ------------------------------------------------------------------------------------------------------------

U = "('0x' || substr(sha1({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(CLIPS + f" SELECT idx, {U.format(chr(39) + '42|3|' + chr(39) + ' || idx')} AS u FROM clips")
def hash_uniform(spark, d):
    return clips(spark, d).select("idx", draw(42, 3, F.col("idx")).alias("u"))


@query(CLIPS + f""", u AS (SELECT idx, {U.format("'42|1|' || idx || '|variant'")} AS u FROM clips)
  SELECT idx, CASE WHEN u < 0.5::DOUBLE / 1.0::DOUBLE THEN 'ref_clone' WHEN u < 0.5::DOUBLE + 0.2::DOUBLE THEN 'ref_edit' ELSE 'tts_plain' END AS variant FROM u""")
def variant_draw(spark, d):
    return sampling.conditions(clips(spark, d), {"ref_clone": 0.5, "ref_edit": 0.2, "tts_plain": 0.3, "none": 0.0}, 1).select("idx", "variant")


@query(CLIPS + f""", pool AS (SELECT speaker, idx, row_number() OVER (PARTITION BY speaker ORDER BY idx) - 1 AS pos FROM clips WHERE speaker <> '' AND NOT suffix(speaker, ':99') AND dur BETWEEN 2.5::DOUBLE AND 10.2::DOUBLE),
  n AS (SELECT speaker, count(*) AS n FROM pool GROUP BY ALL), t AS (
  SELECT c.idx, c.speaker, p.pos AS own, n - (p.pos IS NOT NULL)::INT AS others, {U.format("'42|5|' || c.idx || '|ref'")} AS u FROM clips c LEFT JOIN n USING (speaker) LEFT JOIN pool p ON c.idx = p.idx),
  j AS (SELECT *, CASE WHEN others > 0 THEN floor(u * others)::BIGINT % others END AS j FROM t)
  SELECT j.idx, q.idx AS ref FROM j LEFT JOIN pool q ON q.speaker = j.speaker AND q.pos = j.j + (own IS NOT NULL AND j.j >= own)::INT""")
def reference_pick(spark, d):
    return sampling.pick_reference(clips(spark, d), 5).select("idx", "ref")


@query()
def mass_weights(spark, d):
    return sampling.mass_weights(splits.with_groups(usable(spark, d)), {"en": 2.0, "fr": 1.0, "de": 1.0, "es": 0.5})


# vectors -------------------------------------------------------------------------------------------------------------

VEC = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS e FROM embeddings WHERE len(embedding) = 64),
  parts AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e),
  sums AS (SELECT label, i, sum(x) AS t FROM parts GROUP BY ALL), n AS (SELECT label, count(*)::BIGINT AS n FROM e GROUP BY ALL)"""


def unit_vectors(spark, d):
    return similarity.units(table(spark, d, "embeddings"), DIM)


@query("WITH " + VEC + """ SELECT label, n, round((sum(t * t) - n) / (n * (n - 1)), 9) AS intra FROM sums JOIN n USING (label) GROUP BY label, n""")
def label_cohesion(spark, d):
    return similarity.cohesion(unit_vectors(spark, d), DIM).select("label", "n", F.round("intra", 9).alias("intra"))


LOO = VEC + """, loo AS (SELECT vec_id, label, sum(x * (t - x)) / greatest(sqrt(sum((t - x) * (t - x))), 1e-9) AS loo FROM parts JOIN sums USING (label, i) GROUP BY ALL)"""


@query("WITH " + LOO + " SELECT vec_id, label, round(loo, 8) AS loo FROM loo")
def leave_one_out(spark, d):
    return similarity.leave_one_out(unit_vectors(spark, d), DIM).select("vec_id", "label", F.round("loo", 8).alias("loo"))


@query("WITH " + LOO + """, m AS (SELECT label, median(loo) AS med FROM loo GROUP BY ALL), a AS (SELECT label, 1.4826 * median(abs(loo - med)) AS mad FROM loo JOIN m USING (label) GROUP BY ALL)
  SELECT vec_id, label, ((med - loo > 3 * greatest(mad, 0.02)) AND med - loo >= 0.1) OR loo < 0.3 AS outlier FROM loo JOIN m USING (label) JOIN a USING (label)""")
def vector_outliers(spark, d):
    return similarity.outliers(unit_vectors(spark, d), DIM).select("vec_id", "label", "outlier")


@query("WITH " + VEC + """, s AS (SELECT vec_id, label, round(sum(x * t), 9) AS score FROM parts JOIN sums USING (label, i) GROUP BY ALL)
  SELECT label, vec_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1""")
def label_medoids(spark, d):
    return similarity.medoids(unit_vectors(spark, d), DIM, "vec_id").select("label", "medoid")


@query("WITH " + LOO + """, m AS (SELECT label, median(loo) AS med FROM loo GROUP BY ALL), a AS (SELECT label, 1.4826 * median(abs(loo - med)) AS mad FROM loo JOIN m USING (label) GROUP BY ALL),
  o AS (SELECT label, avg((((med - loo > 3 * greatest(mad, 0.02)) AND med - loo >= 0.1) OR loo < 0.3)::INT) AS share FROM loo JOIN m USING (label) JOIN a USING (label) GROUP BY ALL),
  c AS (SELECT label, n, (sum(t * t) - n) / (n * (n - 1)) AS intra FROM sums JOIN n USING (label) GROUP BY label, n)
  SELECT label, n, round(share, 9) AS outlier_share, CASE WHEN n < 4 THEN 'POUCOS' WHEN intra < 0.45 OR share >= 0.25 THEN 'RUIM' WHEN intra < 0.55 OR share >= 0.1 THEN 'SUSPEITO' ELSE 'OK' END AS status FROM c JOIN o USING (label)""")
def label_verdicts(spark, d):
    return purity.label_verdicts(unit_vectors(spark, d), DIM).select("label", "n", F.round("outlier_share", 9).alias("outlier_share"), "status")


CENTRES = VEC + """, c AS (SELECT label, i, t / sqrt(sum(t * t) OVER (PARTITION BY label)) AS c FROM sums), pairs AS (
  SELECT a.label AS a, b.label AS b, sum(a.c * b.c) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)"""


@query("WITH " + CENTRES + " SELECT a, b, round(cosine, 8) AS cosine FROM pairs WHERE a < b AND cosine >= 0.05")
def near_label_pairs(spark, d):
    return similarity.near_labels(unit_vectors(spark, d), DIM, 0.05).select("a", "b", F.round("cosine", 8).alias("cosine"))


@query("WITH " + CENTRES + " SELECT a, b AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS r FROM pairs) WHERE r = 1")
def nearest_label(spark, d):
    return similarity.nearest_label(unit_vectors(spark, d), DIM).select("a", "nearest")


# intervals -----------------------------------------------------------------------------------------------------------

SPANS = """ev AS (SELECT user_id, event_id, event_type, epoch_us(ts)::DOUBLE / 1000000::DOUBLE AS start FROM events),
  sp AS (SELECT user_id, event_id, event_type, start, start + 1800 + (event_id % 7) * 600 AS stop FROM ev)"""


def spans(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("start"))
    return e.withColumn("stop", F.col("start") + 1800 + (F.col("event_id") % 7) * 600)


def by_type(spark, d, kind):
    return spans(spark, d).filter(F.col("event_type") == kind)


@query("WITH " + SPANS + """ SELECT a.event_id, b.event_id AS other, round(greatest(a.start, b.start), 3) AS lo, round(least(a.stop, b.stop), 3) AS hi FROM sp a JOIN sp b USING (user_id)
  WHERE a.event_type = 'view' AND b.event_type = 'click' AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 60""")
def interval_overlap(spark, d):
    right = by_type(spark, d, "click").select("user_id", "start", "stop", F.col("event_id").alias("other"))
    return intervals.overlap_join(by_type(spark, d, "view"), right, "user_id", 60.0).select("event_id", "other", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("WITH " + SPANS + """, s AS (SELECT a.event_id, sum(least(a.stop, b.stop) - greatest(a.start, b.start)) / any_value(a.stop - a.start) AS share FROM sp a JOIN sp b USING (user_id)
  WHERE a.event_type = 'view' AND b.event_type = 'click' AND least(a.stop, b.stop) > greatest(a.start, b.start) GROUP BY a.event_id) SELECT event_id, round(share, 6) AS share FROM s WHERE share >= 0.2""")
def covered_share(spark, d):
    return intervals.covered_share(by_type(spark, d, "view"), by_type(spark, d, "click").select("user_id", "start", "stop"), "user_id", "event_id", 0.2).select("event_id", F.round("share", 6).alias("share"))


@query("WITH " + SPANS + """ SELECT DISTINCT a.event_id FROM sp a JOIN sp b USING (user_id) WHERE a.event_type = 'purchase' AND a.event_type <> b.event_type
  AND least(a.stop + 300, b.stop) - greatest(greatest(a.start - 300, 0), b.start) >= 5""")
def edge_bleed(spark, d):
    turns = spans(spark, d).select("user_id", "start", "stop", F.col("event_type").alias("speaker"))
    return intervals.bleeding(by_type(spark, d, "purchase"), turns, "user_id", "event_type", "speaker", 300.0, 5.0).select("event_id")


@query("""WITH a AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS act FROM events), b AS (
  SELECT *, CASE WHEN act AND NOT coalesce(lag(act) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 1 ELSE 0 END AS fresh FROM a), c AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b)
  SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*)::BIGINT AS n FROM c WHERE act GROUP BY user_id, run HAVING count(*) >= 2""")
def active_runs(spark, d):
    return intervals.runs(table(spark, d, "events"), "user_id", "event_id", F.col("event_type").isin("click", "view"), 2).select("user_id", "first", "last", "n")


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS start, epoch_us(ts) / 1000000.0::DOUBLE + 1800 + (event_id % 7) * 600 AS stop FROM events), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, stop) AS r FROM s),
  f AS (SELECT user_id, r, start AS b, stop AS e, 1 AS n, 1 AS k FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, CASE WHEN o.start - f.e < 7200 AND o.stop - f.b <= 14400 THEN f.b ELSE o.start END, o.stop,
    CASE WHEN o.start - f.e < 7200 AND o.stop - f.b <= 14400 THEN f.n + 1 ELSE 1 END, f.k + CASE WHEN o.start - f.e < 7200 AND o.stop - f.b <= 14400 THEN 0 ELSE 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
  SELECT user_id, b AS start, e AS stop, n::INT AS n FROM f QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY r DESC) = 1""")
def bounded_sessions(spark, d):
    return intervals.bounded_sessions(spans(spark, d).select("user_id", "start", "stop"), "user_id", 7200.0, 14400.0)


# text and evaluation -------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, text, n_chars::DOUBLE / 15 AS dur FROM documents), p AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty'
  WHEN length(text) / greatest(dur, 0.000001) < 6 OR length(text) / greatest(dur, 0.000001) > 25 THEN 'density'
  WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.05 THEN 'digits' END AS problem FROM t) SELECT doc_id, problem FROM p""")
def transcript_problems(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.transcript_problem(F.col("text"), F.col("n_chars") / F.lit(15.0), digits=0.05).alias("problem"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), g AS (
  SELECT doc_id, len(w) AS n, CASE WHEN len(w) > 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END AS g FROM w)
  SELECT doc_id, CASE WHEN n > 3 THEN 1 - len(list_distinct(g))::DOUBLE / len(g) ELSE 0 END::DOUBLE AS ratio FROM g""")
def ngram_repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.repetition_ratio(F.col("text")).alias("ratio"))


def turn_pairs(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    hyp = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ref"), hyp.alias("hyp")).filter("hyp IS NOT NULL")


# DuckDB's distance is one of bytes; these two are tested against brute force
@query()
def character_error_rate(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", tx.character_error_rate(F.col("ref"), F.col("hyp")).alias("cer"))


@query("""WITH t AS (SELECT doc_id, 0.3 + (doc_id % 9) / 10.0::DOUBLE AS wer, n_chars::DOUBLE / 20 AS dur, greatest(2.0::DOUBLE, len(w) / 2.6::DOUBLE) AS want, len(w) > 0 AS spoken, CASE WHEN len(w) > 3 THEN 1 - len(list_distinct(g))::DOUBLE / len(g) ELSE 0 END AS rep FROM (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) AS g FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)))
  SELECT doc_id, concat_ws(',', CASE WHEN wer > 0.5::DOUBLE THEN 'wer' END, CASE WHEN spoken AND dur < 0.4::DOUBLE * want THEN 'short' END, CASE WHEN spoken AND dur > 2.5::DOUBLE * want THEN 'long' END, CASE WHEN rep > 0.3::DOUBLE THEN 'repetition' END) AS reasons,
    dur BETWEEN 0.55::DOUBLE * want AND 2.2::DOUBLE * want AS plausible FROM t""")
def failure_reasons(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", (F.lit(0.3) + (F.col("doc_id") % 9) / F.lit(10.0)).alias("wer"), (F.col("n_chars") / F.lit(20.0)).alias("dur"), tx.repetition_ratio(F.col("text")).alias("rep"))
    return t.select("doc_id", F.array_join(tx.failure_reasons(F.col("wer"), F.col("dur"), F.col("text"), F.col("rep")), ",").alias("reasons"), tx.plausible_duration(F.col("text"), F.col("dur")).alias("plausible"))


@query("""WITH s AS (SELECT event_type, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s)
  SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, median(value) AS median, max(value) FILTER (r = least(n - 1, floor(0.9::DOUBLE * n)::BIGINT)) AS p90, round(stddev_pop(value), 6) AS sd FROM r GROUP BY event_type""")
def value_summary(spark, d):
    return evaluation.summary(table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), "median", "p90", F.round("sd", 6).alias("sd"))


@query()
def micro_error_rate(spark, d):
    p = turn_pairs(spark, d).withColumn("part", F.col("conv_id") % 10)
    return evaluation.micro_rate(p, ["part"], tx.word_distance(F.col("ref"), F.col("hyp")), F.size(tx.words(F.col("ref"))))


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(avg(m), 9) AS macro, count(*)::BIGINT AS groups FROM m GROUP BY ALL""")
def macro_over_micro(spark, d):
    return evaluation.macro_over_micro(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_discount").select("l_returnflag", F.round("macro", 9).alias("macro"), "groups")


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS wmean FROM lineitem GROUP BY ALL")
def weighted_mean(spark, d):
    return evaluation.weighted_mean(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity").select("l_suppkey", F.round("wmean", 9).alias("wmean"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, count(*)::BIGINT AS n, min(value) AS low, max(value) FILTER (r = n // 20) AS p5, max(value) FILTER (r = n // 2) AS middle, max(value) FILTER (r = n - (n + 19) // 20) AS p95, max(value) AS high FROM r GROUP BY event_type""")
def rank_percentiles(spark, d):
    return evaluation.rank_percentiles(table(spark, d, "events"), ["event_type"], "value")


# decoding ------------------------------------------------------------------------------------------------------------

TOK = """tok AS (SELECT l_orderkey AS k, l_linenumber AS token, round(l_extendedprice / 10000 - 3, 1) + 0 AS score FROM lineitem)"""


def tokens(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("token"), (rounded(F.col("l_extendedprice") / 10000 - 3, 1) + F.lit(0.0)).alias("score"))


@query("WITH " + TOK + " SELECT k, token FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY score DESC) AS r FROM tok) WHERE r <= 3")
def top_k_with_ties(spark, d):
    return decoding.top_k(tokens(spark, d), "k", 3).select("k", "token")


@query("WITH " + TOK + " SELECT k, token FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, token) AS r FROM tok) WHERE r <= 3")
def top_k_exact(spark, d):
    return decoding.top_k(tokens(spark, d), "k", 3, ties=False).select("k", "token")


@query("WITH " + TOK + """, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY k)) AS e FROM tok), p AS (SELECT *, e / sum(e) OVER (PARTITION BY k) AS prob FROM e), b AS (
  SELECT *, coalesce(sum(prob) OVER (PARTITION BY k ORDER BY score DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT k, token, round(prob, 9) AS prob FROM b WHERE before <= 0.8""")
def nucleus(spark, d):
    return decoding.nucleus(tokens(spark, d), "k", 0.8).select("k", "token", rounded(F.col("prob"), 9).alias("prob"))


@query("WITH " + TOK + """, h AS (SELECT DISTINCT l_orderkey AS k, (l_suppkey % 4)::INT + 1 AS token FROM lineitem)
  SELECT k, token, CASE WHEN h.k IS NULL THEN score WHEN score > 0 THEN score / 1.3::DOUBLE ELSE score * 1.3::DOUBLE END AS score FROM tok LEFT JOIN h USING (k, token)""")
def repetition_penalty(spark, d):
    history = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), ((F.col("l_suppkey") % 4).cast("int") + 1).alias("token"))
    return decoding.penalise(tokens(spark, d), history, "k", 1.3).select("k", "token", "score")


@query("WITH " + TOK + ", u AS (SELECT l_orderkey AS k, l_linenumber AS token, l_discount AS u FROM lineitem) SELECT k, token, u + 1.5::DOUBLE * (score - u) AS score FROM tok JOIN u USING (k, token)")
def guidance(spark, d):
    plain = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("token"), F.col("l_discount").alias("score"))
    return decoding.guided(tokens(spark, d), plain, "k", 1.5).select("k", "token", "score")


@query("""SELECT doc_id, CASE WHEN n_chars <= 64 THEN 64 WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 4096 THEN 4096 END AS bucket, (ceil(n_chars / 32.0) * 32)::BIGINT AS padded FROM documents""")
def smallest_bucket(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return decoding.smallest_fitting(docs, [64, 512, 4096]).select("doc_id", "bucket", (F.ceil(F.col("length") / 32) * 32).cast("long").alias("padded"))


@query("""WITH a AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS t FROM lineitem GROUP BY ALL), m AS (SELECT k, t, k % 50 AS batch, max(len(t)) OVER (PARTITION BY k % 50) AS n FROM a)
  SELECT k, array_to_string(list_concat(list_transform(range(n - len(t)), lambda x: -1::BIGINT), t), ' ') AS padded FROM m""")
def left_pad(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("t"))
    out = decoding.left_padded(rows.withColumn("batch", F.col("k") % 50), "batch", "t", -1)
    return out.select("k", F.array_join(F.transform("padded", lambda x: x.cast("string")), " ").alias("padded"))


@query("""WITH b AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM events)
  SELECT user_id, block, count(*) FILTER (event_type = 'view')::BIGINT AS n FROM b GROUP BY ALL HAVING bool_or(event_type = 'purchase')""")
def closed_blocks(spark, d):
    return decoding.closed_blocks(table(spark, d, "events"), "user_id", ["event_id"], "event_type", "view", "purchase")


# graph ---------------------------------------------------------------------------------------------------------------


COMPONENTS = """d AS MATERIALIZED (SELECT DISTINCT 'u' || user_id AS u, 'h' || (epoch_us(ts) // 600000000) AS v FROM events), e AS MATERIALIZED (SELECT u, v FROM d UNION ALL SELECT v, u FROM d),
  cc(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, min(cc.component) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc AS own ON own.node = e.v WHERE cc.component < own.component GROUP BY e.v)"""


@query("WITH RECURSIVE " + COMPONENTS + " SELECT node, component FROM cc")
def event_components(spark, d):
    e = table(spark, d, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600)
    edges = e.select(F.concat(F.lit("u"), "user_id").alias("u"), F.concat(F.lit("h"), hour.cast("string")).alias("v")).distinct()
    return components(spark, edges)


@query("""WITH h AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY ALL) SELECT o_custkey, 'P' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS person FROM (SELECT o_custkey, row_number() OVER (ORDER BY round(total, 2) DESC, o_custkey) AS r FROM h)""")
def person_rank(spark, d):
    total = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return identity.person_ids(total.withColumnRenamed("o_custkey", "person"), "person", "total", "P").select(F.col("person").alias("o_custkey"), F.col("id").alias("person"))


# references, requests and reports ------------------------------------------------------------------------------------


@query(USABLE + """ SELECT speaker, string_agg(idx, ',' ORDER BY idx) AS pool, count(*)::BIGINT AS n FROM usable GROUP BY speaker""")
def reference_pools(spark, d):
    pool = F.array_join(F.sort_array(F.collect_list("idx")), ",")
    return usable(spark, d).groupBy("speaker").agg(pool.alias("pool"), F.count("*").alias("n"))


@query(USABLE + f""", a AS (SELECT idx, {U.format("'aug|42|7|' || idx")} AS u, {U.format("'augk|42|7|' || idx")} AS k FROM usable)
  SELECT idx, CASE WHEN u < 0.4::DOUBLE THEN ([2, 5, 9])[(floor(k * 3)::INT % 3) + 1] END::INT AS variant FROM a""")
def augmentation_draw(spark, d):
    return usable(spark, d).select("idx", sampling.augmented(F.col("idx"), [2, 5, 9], 0.4, 7).alias("variant"))


@query(USABLE + """, r AS (SELECT DISTINCT corpus, speaker FROM usable)
  SELECT corpus, speaker, coalesce(lead(speaker) OVER (PARTITION BY corpus ORDER BY speaker), first_value(speaker) OVER (PARTITION BY corpus ORDER BY speaker)) AS floor_speaker FROM r""")
def next_speaker(spark, d):
    return sampling.cyclic_successor(usable(spark, d).select("corpus", "speaker").distinct(), "corpus", "speaker", "floor_speaker")


@query(CLIPS + """, p AS (SELECT corpus, count(*)::BIGINT AS n, round_even(sum(dur) / 3600, 3) AS hours, round(avg(dur), 6) AS mean, max(dur) AS longest FROM clips GROUP BY corpus)
  SELECT * FROM p UNION ALL SELECT '_all', count(*)::BIGINT, round_even(sum(dur) / 3600, 3), round(avg(dur), 6), max(dur) FROM clips""")
def corpus_summary(spark, d):
    c = clips(spark, d)
    agg = [F.count("*").alias("n"), F.bround(F.sum("dur") / 3600, 3).alias("hours"), F.round(F.avg("dur"), 6).alias("mean"), F.max("dur").alias("longest")]
    return c.groupBy("corpus").agg(*agg).unionByName(c.agg(*agg).withColumn("corpus", F.lit("_all")))


@query(HELD + """ SELECT split, count(DISTINCT CASE WHEN gender = 'F' THEN corpus || '|' || speaker END)::BIGINT AS f_voices, count(DISTINCT CASE WHEN gender = 'M' THEN corpus || '|' || speaker END)::BIGINT AS m_voices,
  count(CASE WHEN gender = 'F' THEN 1 END)::BIGINT AS f_clips, count(CASE WHEN gender = 'M' THEN 1 END)::BIGINT AS m_clips FROM split GROUP BY split""")
def gender_table(spark, d):
    voice = voice_key(F.col("corpus"), F.col("speaker"), F.col("idx"))
    per = [(g, F.col("gender") == g) for g in "FM"]
    return held(spark, d).groupBy("split").agg(*[F.count_distinct(F.when(t, voice)).alias(f"{g.lower()}_voices") for g, t in per], *[F.count_if(t).alias(f"{g.lower()}_clips") for g, t in per])


@query(r"""SELECT lang, count(*)::BIGINT AS n, sum(regexp_matches(text, '\b[A-Z]{2,7}\b')::INT)::BIGINT AS acronyms, sum(regexp_matches(text, '\b[a-zA-Z]\b')::INT)::BIGINT AS letters, sum(regexp_matches(text, '[0-9]')::INT)::BIGINT AS numerals FROM (
  SELECT lang, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM documents) GROUP BY lang""")
def category_profile(spark, d):
    plain = table(spark, d, "documents").select("lang", F.regexp_replace("text", "[^ -~]", "x").alias("text"))
    return plain.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in (("acronyms", r"\b[A-Z]{2,7}\b"), ("letters", r"\b[a-zA-Z]\b"), ("numerals", "[0-9]"))])


@query("""SELECT doc_id, left(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), 40) AS slug FROM documents""")
def text_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'ref_edit_tata' ELSE 'ref_clone_tata' END WHEN doc_id % 5 = 0 THEN 'tts_instruction' ELSE 'tts_plain' END AS template,
  CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '[S1]' ELSE '[' || source || ']' END AS prefix FROM documents""")
def request_templates(spark, d):
    i = F.col("doc_id")
    ref = F.when(i % 3 == 0, "r.wav")
    speaker = F.when(i % 4 == 1, "[S1]").when(i % 4 == 0, F.when(i % 8 == 0, "")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", tx.template_name(ref, ref, F.when(i % 5 == 0, "slow").otherwise("  ")).alias("template"), tx.speaker_prefix(speaker).alias("prefix"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, greatest(-1, least(1, x)) AS x FROM x), y AS (SELECT vec_id, x, round_even(sign(x) * ln(1 + 255 * abs(x)) / ln(256) * 127, 0) / 127 AS y FROM c)
  SELECT vec_id, round(sum(sign(y) * (pow(256.0::DOUBLE, abs(y)) - 1) / 255), 6) AS total FROM y GROUP BY vec_id""")
def mulaw_totals(spark, d):
    from corpusloom.functions.vectors import mulaw

    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(mulaw(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# streams, batch twins ------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events)
  SELECT user_id, r // 4 AS chunk, count(*)::BIGINT AS frames, max(r) = max(max(r)) OVER (PARTITION BY user_id) AS is_final FROM r GROUP BY user_id, r // 4""")
def tumbling_chunks(spark, d):
    from corpusloom.streaming.chunks import chunked

    return chunked(table(spark, d, "events"), "user_id", ["ts", "event_id"], 4)


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS held FROM events""")
def sliding_cache(spark, d):
    from corpusloom.streaming.chunks import sliding

    return sliding(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5, "value").select("event_id", F.round("total", 6).alias("total"), "held")


@query("""WITH f AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, ((row_number() OVER (ORDER BY f) - 1) % 4)::INT AS lane FROM f""")
def lane_assignment(spark, d):
    from corpusloom.streaming.chunks import lanes

    return lanes(table(spark, d, "events"), "user_id", "event_id", 4)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    out = table(spark, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")
