"""More registered queries: reports on splits, gates, conditions, text and signals, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusloom.functions import signals, text as tx
from corpusloom.functions.keys import draw, order_key
from corpusloom.operators import evaluation, gates, sampling, selection, similarity
from corpusloom.operators.graph import numbered
from corpusloom.plans.catalog import CLIPS, COMPONENTS, DIM, HELD, LOO, U, USABLE, VEC, clips, event_components, held, query, turn_pairs, unit_vectors, usable
from corpusloom.session import table

# splits and sampling -------------------------------------------------------------------------------------------------


@query(HELD + """ SELECT split, corpus, count(*)::BIGINT AS n, round_even(sum(dur) / 3600, 3) AS hours, count(DISTINCT grp)::BIGINT AS groups FROM split GROUP BY split, corpus
  UNION ALL SELECT split, '_total', count(*)::BIGINT, round_even(sum(dur) / 3600, 3), count(DISTINCT grp)::BIGINT FROM split GROUP BY split""")
def split_stats(spark, d):
    rows = held(spark, d)
    agg = [F.count("*").alias("n"), F.bround(F.sum("dur") / 3600, 3).alias("hours"), F.count_distinct("grp").alias("groups")]
    per = rows.groupBy("split", "corpus").agg(*agg)
    return per.unionByName(rows.groupBy("split").agg(*agg).withColumn("corpus", F.lit("_total")).select(per.columns))


@query(CLIPS + """ SELECT idx, 'base' AS part, corpus FROM clips UNION ALL SELECT idx, 'long', corpus FROM clips WHERE dur > 9 UNION ALL SELECT doc_id::VARCHAR, 'labels', NULL FROM labels""")
def union_of_sources(spark, d):
    c = clips(spark, d)
    parts = [c.select("idx", F.lit("base").alias("part"), "corpus"), c.filter("dur > 9").select("idx", F.lit("long").alias("part"), "corpus"), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("idx"), F.lit("labels").alias("part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)


@query("""WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id FROM labels), t AS (SELECT doc_id, count(*)::BIGINT AS times FROM p GROUP BY ALL)
  SELECT doc_id, coalesce(times, 0)::BIGINT AS times FROM documents FULL JOIN t USING (doc_id) WHERE coalesce(times, 0) <> 1""")
def partition_check(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return gates.incomplete(docs, docs.filter("doc_id % 3 < 2").select("doc_id").unionByName(labels.select("doc_id")), "doc_id")


@query(USABLE + f""", a AS (SELECT corpus, {U.format("'aug|42|7|' || idx")} < 0.4::DOUBLE AS a FROM usable) SELECT corpus, round(avg(a::INT), 9) AS share FROM a GROUP BY corpus""")
def augmented_share(spark, d):
    return usable(spark, d).groupBy("corpus").agg(F.round(F.avg(sampling.augmented(F.col("idx"), [2, 5, 9], 0.4, 7).isNotNull().cast("int")), 9).alias("share"))


@query(USABLE + """ SELECT idx, corpus FROM usable ORDER BY sha1('7|qc|' || idx), idx LIMIT 30""")
def audit_sample(spark, d):
    return usable(spark, d).orderBy(order_key(7, "qc", F.col("idx")), "idx").limit(30).select("idx", "corpus")


@query(CLIPS + f""", v AS (SELECT idx, speaker, {U.format("'42|1|' || idx || '|variant'")} AS u FROM clips), r AS (
  SELECT v.*, CASE WHEN u < 0.5::DOUBLE THEN 'ref_clone' WHEN u < 0.7::DOUBLE THEN 'ref_edit' ELSE 'tts_plain' END AS variant, CASE WHEN suffix(speaker, '0') THEN speaker END AS ref FROM v)
  SELECT idx, CASE WHEN variant LIKE 'ref%' AND ref IS NULL THEN 'tts_instruction' ELSE variant END AS variant, CASE WHEN variant LIKE 'ref%' THEN ref END AS ref FROM r""")
def resolved_conditions(spark, d):
    rows = sampling.conditions(clips(spark, d), {"ref_clone": 0.5, "ref_edit": 0.2, "tts_plain": 0.3}, 1)
    rows = rows.withColumn("ref", F.when(F.endswith("speaker", F.lit("0")), F.col("speaker")))
    return gates.resolved(rows, ("ref_clone", "ref_edit"), "tts_instruction").select("idx", "variant", "ref")


# fixed values: the aliases of the variants
VARIANTS = {"ref_edit": "ref_edit_tata", "ref_clone": "ref_clone_tata", "instruction": "tts_instruction", "plain": "tts_plain", "ref_edit_auto": "ref_edit_tata"}


@query("""WITH s AS (SELECT doc_id, doc_id % 3 AS a, doc_id % 2 AS b, 1 + doc_id % 5 AS c, 0.5::DOUBLE AS e FROM documents), p AS (
  SELECT doc_id, 'ref_edit_tata' AS variant, (a + e) / (a + b + c + e) AS share FROM s UNION ALL SELECT doc_id, 'ref_clone_tata', b / (a + b + c + e) FROM s UNION ALL SELECT doc_id, 'tts_plain', c / (a + b + c + e) FROM s)
  SELECT doc_id, variant, round(share, 9) AS share FROM p WHERE share > 0""")
def parsed_mixes(spark, d):
    i = F.col("doc_id")
    spec = F.concat(F.lit("ref_edit="), i % 3, F.lit(", ref_clone="), i % 2, F.lit(",plain="), 1 + i % 5, F.lit(",ref_edit_auto=0.5, instruction=0,"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(gates.parsed_mix(spec, VARIANTS)).alias("variant", "share"))
    return rows.select("doc_id", "variant", F.round("share", 9).alias("share"))


@query("""SELECT doc_id, ['calm', 'clear', 'warm', 'slow', 'quick', 'low', 'bright', 'plain', 'soft'][(7 * n_chars + list_sum(list_transform(string_split(source, ''), lambda c: ascii(c)))::BIGINT) % 10000 % 9 + 1] AS instruction FROM documents""")
def instruction_choice(spark, d):
    pool = F.array(*map(F.lit, ("calm", "clear", "warm", "slow", "quick", "low", "bright", "plain", "soft")))
    total = F.aggregate(F.split("source", ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return table(spark, d, "documents").select("doc_id", F.element_at(pool, ((F.col("n_chars") * 7 + total) % 10000 % 9 + 1).cast("int")).alias("instruction"))


@query("WITH " + VEC.split(",\n")[0] + f""", t AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS token, unnest(embedding)::DOUBLE AS score FROM embeddings), w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS w FROM t),
  c AS (SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY token) / sum(w) OVER (PARTITION BY vec_id) AS upto FROM w) SELECT vec_id, min(token) AS token FROM c WHERE upto > {U.format("'42|tok|' || vec_id::VARCHAR")} OR token = 63 GROUP BY vec_id""")
def multinomial_tokens(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "score")).withColumn("score", F.col("score").cast("double"))
    return sampling.multinomial(rows, "vec_id", draw(42, "tok", F.col("vec_id")))


@query(CLIPS + """, t AS (SELECT speaker, idx AS target, lead(idx) OVER (PARTITION BY speaker ORDER BY idx) AS prompt FROM clips), p AS (SELECT * FROM t WHERE prompt IS NOT NULL),
  c AS (SELECT p.*, c.idx AS ref, row_number() OVER (PARTITION BY p.speaker, p.target ORDER BY c.idx) - 1 AS place, count(*) OVER (PARTITION BY p.speaker, p.target) AS n FROM p JOIN clips c ON p.speaker = c.speaker AND c.idx NOT IN (p.target, p.prompt)),
  k AS (SELECT unnest([0, 1, 2]) AS pick) SELECT speaker, target, prompt, pick, ref FROM c, k WHERE place = CASE WHEN n <= 3 THEN pick ELSE floor(pick * (n / 3.0::DOUBLE))::BIGINT END""")
def heldout_refs(spark, d):
    c = clips(spark, d)
    p = c.select("speaker", F.col("idx").alias("target"), F.lead("idx").over(Window.partitionBy("speaker").orderBy("idx")).alias("prompt")).filter("prompt IS NOT NULL")
    return selection.heldout_refs(c, p, 3)


# gates and statuses --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN n_chars / 300.0::DOUBLE > 10.2::DOUBLE THEN 'long' WHEN n_chars / 300.0::DOUBLE < 2.0::DOUBLE THEN 'short' END AS notice FROM documents""")
def duration_notices(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.duration_notice(F.col("n_chars") / F.lit(300.0)).alias("notice"))


@query(r"""WITH n AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '[' || page_id || '].wav' ELSE url || '.wav' END AS name FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(name, '\[[^\]]+\]\.wav$') THEN regexp_extract(name, '\[([^\]]+)\]\.wav$', 1) ELSE left(regexp_replace(name, '\W+', '_', 'g'), 20) END AS tag FROM n""")
def episode_tags(spark, d):
    name = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("["), "page_id", F.lit("].wav"))).otherwise(F.concat("url", F.lit(".wav")))
    return table(spark, d, "pages").select("page_id", tx.episode_tag(name).alias("tag"))


@query("""SELECT CASE WHEN suffix(lang, 'n') THEN 'en' ELSE 'pt' END AS language, count(*)::BIGINT AS n FROM documents GROUP BY ALL""")
def languages_by_name(spark, d):
    return table(spark, d, "documents").groupBy(tx.language_of(F.concat(F.lit("clip-"), "lang")).alias("language")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, 'green|^a.*e$|[xz]')""")
def excluded_names(spark, d):
    return selection.without_matches(table(spark, d, "part"), "p_name", ["green", "^a.*e$", "[xz]"]).select("p_partkey", "p_name")


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN role IS NULL OR NOT regexp_matches(role, '\\S') THEN 'role' END, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'text' END, CASE WHEN turn < 1 THEN 'before' END) AS missing FROM conversations""")
def missing_fields(spark, d):
    given = {"role": F.col("role"), "text": F.col("text"), "before": F.when(F.col("turn") >= 1, F.lit("x"))}
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.missing_fields(given), ",").alias("missing"))


@query(r"""WITH c AS (SELECT doc_id, source, n_chars / 14.0::DOUBLE AS dur, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 7) / 100.0::DOUBLE END AS wer, greatest(2.0::DOUBLE, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 2.6::DOUBLE) AS want FROM documents),
  m AS (SELECT *, median(dur) OVER (PARTITION BY source) AS mid FROM c), p AS (SELECT *, coalesce(wer <= 0.05::DOUBLE, true) AND dur / greatest(mid, 0.01::DOUBLE) BETWEEN 0.75::DOUBLE AND 1.3::DOUBLE AND dur BETWEEN 0.55::DOUBLE * want AND 2.2::DOUBLE * want AS passed FROM m),
  a AS (SELECT *, bool_or(passed) OVER (PARTITION BY source) AS any_ FROM p) SELECT doc_id, source, passed FROM a WHERE passed OR NOT any_""")
def gated_candidates(spark, d):
    c = table(spark, d, "documents").select("doc_id", "source", "text", (F.col("n_chars") / F.lit(14.0)).alias("dur"), F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 7) / F.lit(100.0)).alias("wer"))
    return gates.gated(c, "source").select("doc_id", "source", "passed")


@query("WITH " + LOO + """, m AS (SELECT label, median(loo) AS med FROM loo GROUP BY ALL) SELECT vec_id, label, loo < 0.4::DOUBLE AND (loo < med - 0.15::DOUBLE OR med < 0.4::DOUBLE) AS changed FROM loo JOIN m USING (label)""")
def voice_changes(spark, d):
    loo = similarity.leave_one_out(unit_vectors(spark, d), DIM).select("vec_id", "label", "loo")
    return gates.voice_changed(loo, "label", "loo", 0.4).select("vec_id", "label", "changed")


@query(CLIPS + """, s AS (SELECT *, count(*) OVER (PARTITION BY corpus, speaker) AS n FROM clips), t AS (SELECT idx, speaker, CASE WHEN length(text) = 0 THEN 'drop_fail' WHEN dur < 2.5::DOUBLE THEN 'drop_bleed' WHEN text LIKE '%|%' THEN 'drop_mixed'
  WHEN dur > 10.2::DOUBLE THEN 'drop_split' WHEN suffix(speaker, ':99') THEN 'drop_outlier' WHEN n < 4 THEN 'drop_small' WHEN regexp_matches(text, '[$%&]') THEN 'drop_impure' ELSE 'kept' END AS status FROM s)
  SELECT idx, status, CASE WHEN status = 'kept' THEN speaker ELSE 'podcast:99' END AS voice FROM t""")
def clip_statuses(spark, d):
    c = clips(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("corpus", "speaker")))
    checks = [
        ("drop_fail", F.length("text") == 0), ("drop_bleed", F.col("dur") < 2.5), ("drop_mixed", F.contains("text", F.lit("|"))), ("drop_split", F.col("dur") > 10.2),
        ("drop_outlier", F.endswith("speaker", F.lit(":99"))), ("drop_small", F.col("n") < 4), ("drop_impure", F.col("text").rlike("[$%&]")),
    ]
    c = c.withColumn("status", gates.status_of(checks))
    return c.select("idx", "status", F.when(F.col("status") == "kept", F.col("speaker")).otherwise("podcast:99").alias("voice"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT n_chars AS x FROM documents), s AS (SELECT min(x) AS x, 0 AS b FROM l UNION ALL SELECT (SELECT min(x) FROM l WHERE l.x > 2 * s.x), b + 1 FROM s WHERE EXISTS (SELECT 1 FROM l WHERE l.x > 2 * s.x))
  SELECT doc_id, max(b)::INT AS bucket FROM documents JOIN s ON s.x <= n_chars GROUP BY doc_id""")
def length_buckets(spark, d):
    return gates.length_buckets(table(spark, d, "documents"), "n_chars").select("doc_id", "bucket")


@query("""WITH t AS (SELECT 'd' || doc_id || '.txt' AS name, lang FROM documents), w AS (SELECT 'd' || doc_id || '.wav' AS name, toxic FROM labels)
  SELECT regexp_extract(t.name, '^(.*)\\.[^.]*$', 1) AS stem, lang, toxic FROM t JOIN w ON regexp_extract(t.name, '^(.*)\\.[^.]*$', 1) = regexp_extract(w.name, '^(.*)\\.[^.]*$', 1)""")
def stem_pairs(spark, d):
    stem = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    t = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), "lang").select(stem.alias("stem"), "lang")
    w = table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id", F.lit(".wav")).alias("name"), "toxic").select(stem.alias("stem"), "toxic")
    return t.join(w, "stem")


# evaluation ----------------------------------------------------------------------------------------------------------


@query("WITH " + LOO + """, q AS (SELECT label, quantile_cont(loo, 0.999) AS p, quantile_cont(loo, 0.01) AS q FROM loo GROUP BY label) SELECT label, round(greatest(0.35::DOUBLE, p + 0.03::DOUBLE), 8) AS link, round(greatest(0.15::DOUBLE, least(0.45::DOUBLE, q)), 8) AS half FROM q""")
def calibrated_thresholds(spark, d):
    loo = similarity.leave_one_out(unit_vectors(spark, d), DIM).select("label", "loo")
    return evaluation.calibrated_thresholds(loo, "label", "loo").select("label", F.round("link", 8).alias("link"), F.round("half", 8).alias("half"))


@query("""WITH m AS (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT o_orderpriority, round(sum(m) * sum(m) / sum(m * m), 4) AS effective FROM m GROUP BY ALL""")
def effective_customers(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.sum("o_totalprice").alias("m"))
    return evaluation.effective_number(m, ["o_orderpriority"], "m").select("o_orderpriority", F.round("effective", 4).alias("effective"))


@query("WITH " + LOO + """, b AS (SELECT label, min(loo) AS low, max(loo) AS high FROM loo GROUP BY label) SELECT vec_id, label, CASE WHEN high - low > 0.000001::DOUBLE THEN round((loo - low) / (high - low), 7) END AS scaled FROM loo JOIN b USING (label)""")
def scaled_similarity(spark, d):
    loo = similarity.leave_one_out(unit_vectors(spark, d), DIM).select("vec_id", "label", "loo")
    bounds = loo.groupBy("label").agg(F.min("loo").alias("low"), F.max("loo").alias("high"))
    return loo.join(bounds, "label").select("vec_id", "label", F.round(evaluation.scaled(F.col("loo"), F.col("low"), F.col("high")), 7).alias("scaled"))


@query("""WITH r AS (SELECT l_returnflag, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS name, l_discount * 6 AS rate FROM lineitem)
  SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(rate), 8) AS mean, median(rate) AS median, max(rate) AS most, count(*) FILTER (rate > 0.5)::BIGINT AS n_fail, arg_min(name, struct_pack(r := -rate, k := name)) AS worst FROM r GROUP BY ALL""")
def failure_reports(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), (F.col("l_discount").cast("double") * 6).alias("rate"))
    return evaluation.failure_report(rows, ["l_returnflag"], "rate", "name").select("l_returnflag", "n", F.round("mean", 8).alias("mean"), "median", "most", "n_fail", "worst")


@query("""WITH s AS (SELECT source, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean, CASE WHEN avg(n_chars) > 2500 THEN 'RUIM' WHEN avg(n_chars) > 2000 THEN 'SUSPEITO' ELSE 'OK' END AS status FROM documents GROUP BY source)
  SELECT source, n, mean, status FROM s ORDER BY CASE status WHEN 'RUIM' THEN 0 WHEN 'SUSPEITO' THEN 1 ELSE 2 END, mean, source LIMIT 15""")
def worst_first(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.avg("n_chars").alias("m"))
    s = s.withColumn("status", F.when(F.col("m") > 2500, "RUIM").when(F.col("m") > 2000, "SUSPEITO").otherwise("OK"))
    return selection.worst_first(s, "status", ("RUIM", "SUSPEITO", "OK"), "mean", "source", 15).select("source", "n", "mean", "status")


STEPS = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in evaluation.POISSON)


@query(f"""WITH b AS (SELECT c_mktsegment, c_acctbal::DOUBLE AS x, b, {U.format("'42|boot|' || b || '|' || c_custkey")} AS u FROM customer, range(40) r(b)), m AS (SELECT c_mktsegment, b, sum(({STEPS}) * x) / sum({STEPS}) AS m FROM b GROUP BY ALL),
  s AS (SELECT c_mktsegment, list_sort(list(m)) AS s FROM m GROUP BY ALL) SELECT c_mktsegment, round(s[2], 6) AS low, round(s[40], 6) AS high FROM s""")
def bootstrap_intervals(spark, d):
    found = evaluation.bootstrap_interval(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", times=40)
    return found.select("c_mktsegment", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("WITH " + VEC + """, h AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY sha1('42|half|' || vec_id), vec_id::VARCHAR) - 1 < count(*) OVER (PARTITION BY label) // 2 AS side FROM e),
  t AS (SELECT label, side, i, sum(x) AS t FROM parts JOIN h USING (vec_id) GROUP BY ALL), p AS (SELECT a.label, sum(a.t * b.t) / sqrt(sum(a.t * a.t)) / sqrt(sum(b.t * b.t)) AS half FROM t a JOIN t b ON a.label = b.label AND a.i = b.i AND a.side AND NOT b.side GROUP BY a.label)
  SELECT label, n, round(half, 8) AS half FROM p JOIN n USING (label) WHERE n >= 6""")
def split_halves(spark, d):
    return similarity.split_half(unit_vectors(spark, d), DIM, "vec_id").select("label", F.col("n").cast("long").alias("n"), F.round("half", 8).alias("half"))


@query("WITH RECURSIVE " + COMPONENTS + """, g AS (SELECT component, row_number() OVER (ORDER BY component) AS k FROM (SELECT DISTINCT component FROM cc))
  SELECT node, component, 'G' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS grp FROM cc JOIN g USING (component)""")
def event_groups(spark, d):
    return numbered(event_components(spark, d))


# text ----------------------------------------------------------------------------------------------------------------

SHORT = "|".join(tx.ABBREVIATIONS)


@query(rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?;:…])\s+', '\1' || chr(1), 'g') AS c FROM documents),
  s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(c, '(^|[^\p{{L}}\p{{N}}_])((?:{SHORT}|\p{{L}})\.)' || chr(1), '\1\2 ', 'gi'), '(^|[^\p{{L}}\p{{N}}_])((?:{SHORT}|\p{{L}})\.)' || chr(1), '\1\2 ', 'gi'), chr(1)), lambda x: x <> '') AS s FROM c)
  SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def text_sentences(spark, d):
    s = tx.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query()
def spoken_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.text_blocks(F.col("text"))).alias("block", "said"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}\s]', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM t""")
def comparable_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.comparable(F.col("text"))).alias("digest"))


@query(r"""SELECT lang, count(*)::BIGINT AS n, sum(regexp_matches(text, '\p{M}')::INT)::BIGINT AS marked, sum((nfc_normalize(text) <> text)::INT)::BIGINT AS changed, sum(length(regexp_replace(text, '[^À-ÖØ-öø-ÿ]', '', 'g')))::BIGINT AS accented FROM documents GROUP BY lang""")
def unicode_profile(spark, d):
    t = table(spark, d, "documents").withColumn("composed", tx.nfc("text"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"\p{M}")).alias("marked"), F.count_if(F.col("composed") != F.col("text")).alias("changed"), F.sum(F.length(F.regexp_replace("text", "[^À-ÖØ-öø-ÿ]", ""))).alias("accented"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def unescaped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", tx.collapse(tx.html_unescaped("html")).alias("text"))


@query()
def edit_operations(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", tx.edit_operations("ref", "hyp").alias("e"))
    return p.select("conv_id", "turn", "e.*")


@query(r"""WITH b AS (SELECT item_id, lower(regexp_extract(text, '^\S+', 0)) AS word FROM benchmark), w AS (SELECT DISTINCT word FROM b WHERE word <> ''), d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents)
  SELECT word, count(*)::BIGINT AS hits FROM d JOIN w USING (word) GROUP BY word""")
def word_hits(spark, d):
    wanted = table(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", r"^\S+", 0)).alias("word")).filter("word != ''").distinct()
    said = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("word"))
    return said.join(wanted, "word").groupBy("word").agg(F.count("*").alias("hits"))


# signals -------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 8) AS rms,
  round(list_sum(list_transform(e, lambda x: CASE WHEN list_max(list_transform(e, lambda y: abs(y))) > 0 THEN x * 0.95::DOUBLE / list_max(list_transform(e, lambda y: abs(y))) ELSE x END)), 7) AS peak_total FROM e""")
def levels(spark, d):
    peak = F.aggregate(signals.peak_normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(signals.rms(F.col("embedding")), 8).alias("rms"), F.round(peak, 7).alias("peak_total"))


@query("""WITH e AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS e, len(embedding) AS n FROM embeddings), p AS (SELECT vec_id, n, e, greatest(1, n // 3) AS u, greatest(1, n // 10) AS l FROM e)
  SELECT vec_id, CASE WHEN n >= 8 THEN round(10 * log10(greatest(list_sum(e[n - u + 1:n]) / u, 1e-12) / greatest(list_sum(e[1:l]) / l, 1e-12)), 6) END AS snr FROM p""")
def snr_gate(spark, d):
    energies = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(signals.snr_db(energies), 6).alias("snr"))


@query("""SELECT vec_id, len(list_filter(list_transform(range(len(embedding)), lambda i: CASE WHEN i < 40 OR i = 50 THEN embedding[i + 1] END), lambda x: x IS NOT NULL))::INT AS allowed,
  len(list_filter(embedding, lambda x: x = embedding[1])) = len(embedding) AS padding, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x >= -4 AND x < 4)) = len(embedding) AS fits FROM embeddings""")
def frame_predicates(spark, d):
    e = F.col("embedding")
    codes = F.transform(e, lambda x: (x * 100 + 400).cast("double"))
    allowed = F.size(F.array_compact(signals.reserved_masked(e, 40, 50)))
    return table(spark, d, "embeddings").select("vec_id", allowed.alias("allowed"), signals.is_padding(e, F.get(e, F.lit(0))).alias("padding"), signals.valid_codes(F.array(codes), 64, 800).alias("fits"))


@query("""WITH s AS (SELECT doc_id, doc_id % 400 AS step FROM documents) SELECT doc_id, round(CASE WHEN step < 50 THEN step / 50.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * ((step - 50) % 175 / 175.0::DOUBLE))) END, 9) AS cycled,
  round(CASE WHEN step < 50 THEN step / 50.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * least((step - 50) / 350.0::DOUBLE, 1.0::DOUBLE))) END, 9) AS plain FROM s""")
def rate_schedule(spark, d):
    step = F.col("doc_id") % 400
    return table(spark, d, "documents").select("doc_id", F.round(signals.rate_factor(step, 400, 50, 0.1, 2), 9).alias("cycled"), F.round(signals.rate_factor(step, 400, 50), 9).alias("plain"))

