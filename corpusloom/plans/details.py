"""Registered queries of what reports, selections and requests need beside their main forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import signals, text as tx
from corpusloom.functions.keys import voice_key
from corpusloom.operators import decoding, evaluation, gates, selection, similarity, splits
from corpusloom.operators.ranks import quantiles
from corpusloom.plans.catalog import CLIPS, DIM, HELD, LOO, TOK, U, USABLE, clips, held, query, tokens, turn_pairs, unit_vectors, usable
from corpusloom.plans.curation import STEPS
from corpusloom.session import table

# gates and names -----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS e, len(embedding) AS n FROM embeddings), p AS (SELECT vec_id, n, e, greatest(1, n // 3) AS u, greatest(1, n // 10) AS l FROM e)
  SELECT vec_id, coalesce(CASE WHEN n >= 8 THEN 10 * log10(greatest(list_sum(e[n - u + 1:n]) / u, 1e-12) / greatest(list_sum(e[1:l]) / l, 1e-12)) >= 30 END, true) AS ok, true AS off FROM p""")
def quality_gate(spark, d):
    energies = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", signals.quality_ok(energies, 30.0).alias("ok"), signals.quality_ok(energies, 0.0).alias("off"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'raw/' || page_id || '/x.wav' ELSE 'raw/show_' || (page_id % 7) || '/show_x/' || page_id || '.wav' END AS path, url FROM pages)
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'show_' || (page_id % 7) END AS show, left(regexp_replace(url, '[^\\p{L}\\p{N}_.-]+', '_', 'g'), 50) AS name FROM p""")
def show_names(spark, d):
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("raw/"), i, F.lit("/x.wav"))).otherwise(F.concat(F.lit("raw/show_"), (F.col("page_id") % 7).cast("string"), F.lit("/show_x/"), i, F.lit(".wav")))
    return table(spark, d, "pages").select("page_id", tx.show_of(path).alias("show"), tx.safe_name(F.col("url")).alias("name"))


#: A place where a word begins or ends, for both engines.
EDGE = "[^\\p{L}\\p{N}_]"


@query(CLIPS + f""", k AS (SELECT corpus, dur, regexp_matches(' ' || text || ' ', '{EDGE}[A-Z]{{2,7}}{EDGE}') AS a, regexp_matches(' ' || text || ' ', '{EDGE}[a-zA-Z]{EDGE}') AS l, regexp_matches(text, '[0-9]') AS n FROM clips)
  SELECT corpus, count(*)::BIGINT AS n, round_even(sum(dur) / 3600, 2) AS hours, sum(a::INT)::BIGINT AS acronyms, round_even(coalesce(sum(dur) FILTER (a), 0) / 3600, 2) AS acronyms_hours,
    sum(l::INT)::BIGINT AS letters, round_even(coalesce(sum(dur) FILTER (l), 0) / 3600, 2) AS letters_hours, sum(n::INT)::BIGINT AS numerals, round_even(coalesce(sum(dur) FILTER (n), 0) / 3600, 2) AS numerals_hours FROM k GROUP BY corpus""")
def category_hours(spark, d):
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    kinds = {"acronyms": padded.rlike(f"{EDGE}[A-Z]{{2,7}}{EDGE}"), "letters": padded.rlike(f"{EDGE}[a-zA-Z]{EDGE}"), "numerals": F.col("text").rlike("[0-9]")}
    hours = lambda x: F.bround(F.coalesce(F.sum(x), F.lit(0.0)) / 3600, 2)
    figures = [f for name, found in kinds.items() for f in (F.count_if(found).alias(name), hours(F.when(found, F.col("dur"))).alias(f"{name}_hours"))]
    return clips(spark, d).groupBy("corpus").agg(F.count("*").alias("n"), hours(F.col("dur")).alias("hours"), *figures)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '[S1]' ELSE '[' || source || ']' END || CASE WHEN doc_id % 5 = 0 THEN '<ins_bos>slow<ins_eos>' ELSE '' END || lang AS last,
  CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END::INT AS parts, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '[S1]' ELSE '[' || source || ']' END || 'said' END AS first FROM documents""")
def prompt_parts(spark, d):
    i = F.col("doc_id")
    speaker = F.when(i % 4 == 1, "[S1]").when(i % 4 == 0, F.when(i % 8 == 0, "")).otherwise(F.col("source"))
    parts = tx.prompt_parts(F.col("lang"), speaker, F.when(i % 5 == 0, "slow").otherwise(" "), F.when(i % 3 == 0, "r.wav"), F.when(i % 3 == 0, "said"))
    rows = table(spark, d, "documents").select("doc_id", parts.alias("p"))
    return rows.select("doc_id", F.element_at("p", -1)["said"].alias("last"), F.size("p").alias("parts"), F.when(F.size("p") == 3, F.get("p", F.lit(0))["said"]).alias("first"))


PLAIN = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize({})), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH w AS (SELECT item_id, {PLAIN.format("regexp_extract(text, '^[A-Za-z]+', 0)")} AS word FROM benchmark), l AS (SELECT list_sort(list_distinct(list(word))) AS words FROM w WHERE word <> ''), c AS (SELECT conv_id, turn, {PLAIN.format("text")} AS t FROM conversations)
  SELECT conv_id, turn, unnest(list_filter(words, lambda w: contains(t, w))) AS word FROM c, l""")
def heard_words(spark, d):
    """Every turn against the first words of the benchmark's items: a list of bounded length that is sent to all."""
    plain = lambda text: tx.comparable(text)
    first = table(spark, d, "benchmark").select(plain(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("word")).filter("word != ''").distinct()
    wanted = F.broadcast(first.agg(F.sort_array(F.collect_list("word")).alias("words")))  # one row a benchmark
    turns = table(spark, d, "conversations").select("conv_id", "turn", plain(F.coalesce("text", F.lit(""))).alias("t"))
    return turns.crossJoin(wanted).select("conv_id", "turn", F.explode(tx.heard_words(F.col("words"), F.col("t"))).alias("word"))


@query(r"""WITH c AS (SELECT lang, unnest(regexp_extract_all(nfc_normalize(text), '[À-ÖØ-öø-ÿ]')) AS letter FROM documents) SELECT lang, lower(letter) AS letter, count(*)::BIGINT AS n FROM c GROUP BY ALL""")
def accented_letters(spark, d):
    found = table(spark, d, "documents").select("lang", tx.nfc(F.col("text")).alias("t")).select("lang", F.explode(F.regexp_extract_all("t", F.lit("[À-ÖØ-öø-ÿ]"), F.lit(0))).alias("letter"))
    return found.groupBy("lang", F.lower("letter").alias("letter")).agg(F.count("*").alias("n"))


# reports -------------------------------------------------------------------------------------------------------------


@query(HELD + """, l AS (SELECT split, idx FROM split UNION ALL SELECT 'train', 'gone-' || o_orderkey FROM orders WHERE o_orderkey % 9 = 0), r AS (SELECT l.split, s.corpus, s.dur, s.grp FROM l LEFT JOIN split s USING (idx))
  SELECT split, corpus, count(*)::BIGINT AS n, round_even(coalesce(sum(dur), 0) / 3600, 3) AS hours, count(DISTINCT grp)::BIGINT AS groups FROM r WHERE corpus IS NOT NULL GROUP BY ALL
  UNION ALL SELECT split, '_total', count(*)::BIGINT, round_even(coalesce(sum(dur), 0) / 3600, 3), count(DISTINCT grp)::BIGINT FROM r GROUP BY split""")
def listed_stats(spark, d):
    rows = held(spark, d)
    gone = table(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.lit("train").alias("split"), F.concat(F.lit("gone-"), "o_orderkey").alias("idx"))
    return splits.listed_stats(rows.select("split", "idx").unionByName(gone), usable(spark, d))


@query(CLIPS + """ SELECT coalesce(corpus, '_all') AS corpus, count(*)::BIGINT AS n, round(avg(ceil(dur * 12.5)), 6) AS mean_frames, max(ceil(dur * 12.5))::BIGINT AS most_frames FROM clips GROUP BY GROUPING SETS ((), (corpus))""")
def frame_summary(spark, d):
    frames = clips(spark, d).select("corpus", F.ceil(F.col("dur") * 12.5).cast("long").alias("frames"))
    out = frames.rollup("corpus").agg(F.count("*").alias("n"), F.round(F.avg("frames"), 6).alias("mean_frames"), F.max("frames").alias("most_frames"))
    return out.withColumn("corpus", F.coalesce("corpus", F.lit("_all")))


RATED = """r AS (SELECT c_mktsegment, c_name AS name, greatest(c_acctbal, 0) / 10000.0::DOUBLE AS rate, (c_custkey % 50) / 100.0::DOUBLE AS chars FROM customer)"""


@query(f"""WITH {RATED}, b AS (SELECT c_mktsegment, rate AS x, b, {U.format("'42|boot|' || b || '|' || name")} AS u FROM r, range(40) t(b)), m AS (SELECT c_mktsegment, b, sum(({STEPS}) * x) / sum({STEPS}) AS m FROM b GROUP BY ALL), s AS (SELECT c_mktsegment, list_sort(list(m)) AS s FROM m GROUP BY ALL)
  SELECT c_mktsegment, count(*)::BIGINT AS n, round(avg(rate), 8) AS mean, round(any_value(s[2]), 6) AS low, round(any_value(s[40]), 6) AS high, median(rate) AS median, max(rate) AS most, round(avg(chars), 8) AS cer,
    count(*) FILTER (rate > 0.5)::BIGINT AS n_fail, round(count(*) FILTER (rate > 0.5) / count(*), 8) AS share_fail FROM r JOIN s USING (c_mktsegment) GROUP BY c_mktsegment""")
def language_reports(spark, d):
    report, _ = evaluation.language_report(rated(spark, d), ["c_mktsegment"], "rate", "chars", "name", times=40)
    return report.select("c_mktsegment", "n", F.round("mean", 8).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "median", "most", F.round("cer", 8).alias("cer"), "n_fail", F.round("share_fail", 8).alias("share_fail"))


def rated(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", F.col("c_name").alias("name"), (F.greatest("c_acctbal", F.lit(0)) / F.lit(10000.0)).alias("rate"), (F.col("c_custkey") % 50 / F.lit(100.0)).alias("chars"))


@query(f"WITH {RATED} SELECT c_mktsegment, name, rate FROM r WHERE rate > 0.5")
def failing_names(spark, d):
    return evaluation.language_report(rated(spark, d), ["c_mktsegment"], "rate", "chars", "name", times=2)[1]


@query(CLIPS + """ SELECT speaker, NULL AS episode, round(sum(round(dur * 100)::BIGINT) / 360000.0::DOUBLE, 6) AS hours FROM clips GROUP BY speaker UNION ALL SELECT NULL, corpus, round(sum(round(dur * 100)::BIGINT) / 360000.0::DOUBLE, 6) FROM clips GROUP BY corpus""")
def spoken_hours(spark, d):
    # hundredths of seconds are summed as whole numbers, whose sum knows no order
    hours = F.round(F.sum(F.round(F.col("dur") * 100).cast("long")) / F.lit(360000.0), 6).alias("hours")
    sets = clips(spark, d).groupingSets([[F.col("speaker")], [F.col("corpus")]], F.col("speaker"), F.col("corpus"))
    return sets.agg(hours).select("speaker", F.col("corpus").alias("episode"), "hours")


@query("WITH " + LOO + " SELECT label, count(*)::BIGINT AS n, round(median(loo), 8) AS middle FROM loo GROUP BY label")
def half_medians(spark, d):
    loo = similarity.leave_one_out(unit_vectors(spark, d), DIM).select("label", "loo")
    return quantiles(loo, "label", "loo", {"m": 0.5}).join(loo.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", F.round("m", 8).alias("middle"))


@query(HELD + """, v AS (SELECT corpus, speaker, count(*) AS n FROM split GROUP BY ALL), k AS (SELECT split, gender, corpus || '|' || speaker AS voice, 1 / sqrt(n) AS mass FROM split JOIN v USING (corpus, speaker))
  SELECT split, gender, count(DISTINCT voice)::BIGINT AS voices, count(*)::BIGINT AS clips, round(sum(mass) / sum(sum(mass)) OVER (PARTITION BY split), 8) AS mass FROM k WHERE gender IS NOT NULL GROUP BY split, gender""")
def gender_mass(spark, d):
    rows = held(spark, d)
    sizes = rows.groupBy("corpus", "speaker").agg((1 / F.sqrt(F.count("*"))).alias("mass"))
    per = rows.join(sizes, ["corpus", "speaker"]).filter("gender IS NOT NULL").groupBy("split", "gender")
    out = per.agg(F.count_distinct(voice_key(F.col("corpus"), F.col("speaker"), F.col("idx"))).alias("voices"), F.count("*").alias("clips"), F.sum("mass").alias("_m"))
    whole = out.groupBy("split").agg(F.sum("_m").alias("_all"))
    return out.join(whole, "split").select("split", "gender", "voices", "clips", F.round(F.col("_m") / F.col("_all"), 8).alias("mass"))


@query("WITH " + LOO + """, b AS (SELECT label, min(loo) AS low, max(loo) AS high FROM loo GROUP BY label) SELECT vec_id, label, round((loo - low) / greatest(CASE WHEN label % 2 = 0 THEN high ELSE low END - low, 0.000001::DOUBLE), 4) AS scaled FROM loo JOIN b USING (label)""")
def clamped_similarity(spark, d):
    loo = similarity.leave_one_out(unit_vectors(spark, d), DIM).select("vec_id", "label", "loo")
    bounds = loo.groupBy("label").agg(F.min("loo").alias("low"), F.max("loo").alias("high"))
    top = F.when(F.col("label") % 2 == 0, F.col("high")).otherwise(F.col("low"))
    return loo.join(bounds, "label").select("vec_id", "label", F.round(evaluation.scaled_within(F.col("loo"), F.col("low"), top), 4).alias("scaled"))


# selection -----------------------------------------------------------------------------------------------------------


@query(HELD.replace("row_number() OVER (PARTITION BY corpus ORDER BY sha1('42|hold|' || grp)) AS rank", """row_number() OVER (PARTITION BY corpus ORDER BY turn NULLS LAST, CASE WHEN turn IS NOT NULL THEN g END, sha1('42|hold|' || grp)) AS rank""")
    .replace("FROM sizes WHERE n >= 3)", "FROM turns)")
    .replace("SELECT corpus, grp, count(*) AS n FROM grouped GROUP BY ALL)", """SELECT corpus, grp, count(*) AS n, arg_min_null(gender, idx) AS g FROM grouped GROUP BY corpus, grp), owned AS (SELECT *, row_number() OVER (PARTITION BY corpus, g ORDER BY sha1('42|hold|' || grp)) AS own,
      least(sum(coalesce(g = 'F', false)::INT) OVER (PARTITION BY corpus), sum(coalesce(g = 'M', false)::INT) OVER (PARTITION BY corpus)) AS pairs FROM sizes WHERE n >= 3), turns AS (SELECT *, CASE WHEN corpus IN ('en', 'fr') AND g IS NOT NULL AND own <= pairs THEN own END AS turn FROM owned)""")
    + " SELECT idx, corpus, grp, split FROM split")
def paired_holdout(spark, d):
    return splits.paired_holdout(usable(spark, d), 3, 3, ("en", "fr"), least=3).select("idx", "corpus", "grp", "split")


@query(USABLE + """, v AS (SELECT corpus, speaker, count(*) AS n, arg_min(gender, idx) AS g FROM usable WHERE gender IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sha1('42|v|' || corpus || '|' || speaker)) AS rank FROM v)
  SELECT idx, corpus, speaker FROM usable JOIN r USING (corpus, speaker) WHERE rank <= 6 AND usable.gender IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corpus, speaker ORDER BY sha1('42|' || idx)) <= 3""")
def gender_candidates(spark, d):
    return selection.candidates_by_gender(usable(spark, d), 6, 3, 2, "idx").select("idx", "corpus", "speaker")


@query(USABLE + """, p AS (SELECT corpus, speaker, min(idx) AS prompt FROM usable WHERE dur BETWEEN 4 AND 9 AND corpus IN ('en', 'fr', 'de') GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY speaker) AS turn, CASE corpus WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS place FROM p),
  c AS (SELECT * FROM v ORDER BY turn, place LIMIT 6), o AS (SELECT corpus, speaker, u.idx, row_number() OVER (PARTITION BY corpus, speaker ORDER BY u.idx) - 1 AS pos, count(*) OVER (PARTITION BY corpus, speaker) AS n FROM usable u JOIN c USING (corpus, speaker) WHERE u.idx <> prompt AND dur >= 3)
  SELECT corpus, speaker, idx, (pos // greatest(1, n // 5))::INT AS place FROM o WHERE pos % greatest(1, n // 5) = 0 AND pos < greatest(1, n // 5) * 5""")
def heldout_clips(spark, d):
    own = usable(spark, d)
    return selection.heldout_clips(own, selection.evaluation_voices(own, ["en", "fr", "de"], 6)).withColumnRenamed("at", "place")


# windows of tokens and sounds ----------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(m, lambda x: x * x)) / len(m)), 6) AS level, round(list_sum(m), 6) AS total FROM (
  SELECT vec_id, list_transform(e, lambda x: greatest(-1::DOUBLE, least(1::DOUBLE, x * greatest(0.25::DOUBLE, least(4::DOUBLE, target / level))))) AS m FROM (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) AS level, 0.05::DOUBLE * (1 + vec_id % 20) AS target FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)))""")
def matched_levels(spark, d):
    matched = signals.level_matched(F.col("embedding"), 0.05 * (1 + F.col("vec_id") % 20))
    rows = table(spark, d, "embeddings").select("vec_id", matched.alias("m"))
    return rows.select("vec_id", F.round(signals.rms(F.col("m")), 6).alias("level"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("WITH " + TOK + """, u AS (SELECT l_orderkey AS k, l_linenumber AS token, l_discount AS u FROM lineitem), i AS (SELECT l_orderkey AS k, l_linenumber AS token, l_tax AS i FROM lineitem) SELECT k, token, u + 1.5::DOUBLE * (score - u) + 2::DOUBLE * (i - u) AS score FROM tok JOIN u USING (k, token) JOIN i USING (k, token)""")
def dual_guidance(spark, d):
    side = lambda c: table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("token"), F.col(c).alias("score"))
    return decoding.dual_guided(side("l_discount"), tokens(spark, d), side("l_tax"), "k", 1.5, 2.0).select("k", "token", "score")


@query("""WITH a AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS t FROM lineitem GROUP BY ALL), m AS (SELECT k, t, max(len(t)) OVER (PARTITION BY k % 50) - len(t) AS gap FROM a)
  SELECT k, array_to_string(list_concat(list_transform(range(gap), lambda x: 0::BIGINT), t), ' ') AS ids, array_to_string(list_concat(list_transform(range(gap), lambda x: 0), list_transform(t, lambda x: 1)), ' ') AS mask,
    array_to_string(list_concat(list_transform(range(gap), lambda x: -100::BIGINT), list_transform(t, lambda x: x + 1)), ' ') AS labels FROM m""")
def collated_batches(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("t"))
    rows = rows.withColumn("batch", F.col("k") % 50).withColumn("l", F.transform("t", lambda x: x + 1))
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return decoding.collated(rows, "batch", "t", "l").select("k", said("input_ids").alias("ids"), said("attention_mask").alias("mask"), said("labels").alias("labels"))


@query()
def catastrophic_turns(spark, d):
    """Turns held against the turn before: word error rate, and repetition, of the texts as they are compared."""
    p = turn_pairs(spark, d).select("conv_id", "turn", tx.comparable(F.col("ref")).alias("ref"), tx.comparable(F.col("hyp")).alias("hyp"))
    rate = tx.word_distance(F.col("ref"), F.col("hyp")) / F.greatest(F.lit(1), F.size(tx.words(F.col("ref"))))
    p = p.withColumn("wer", rate).withColumn("dur", F.length("hyp") / F.lit(15.0))
    why = tx.failure_reasons(F.col("wer"), F.col("dur"), F.col("ref"), tx.repetition_ratio(F.col("hyp")))
    return p.select("conv_id", "turn", F.round("wer", 8).alias("wer"), F.array_join(why, ",").alias("reasons"))


@query("""WITH c AS (SELECT conv_id, turn, text, length(text) / 15.0::DOUBLE AS dur FROM conversations WHERE text IS NOT NULL), m AS (SELECT conv_id, median(dur) AS mid FROM c GROUP BY ALL), k AS (SELECT conv_id, turn, (turn % 7) / 50.0::DOUBLE <= 0.05 AND dur / greatest(mid, 0.01) BETWEEN 0.75 AND 1.3 AS near, dur, text FROM c JOIN m USING (conv_id)),
  w AS (SELECT *, greatest(2.0::DOUBLE, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) / 2.6::DOUBLE) AS e FROM k), p AS (SELECT conv_id, turn, near AND dur BETWEEN 0.55::DOUBLE * e AND 2.2::DOUBLE * e AS passed FROM w)
  SELECT conv_id, turn, passed FROM p QUALIFY passed OR NOT bool_or(passed) OVER (PARTITION BY conv_id)""")
def gated_turns(spark, d):
    rows = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text", (F.length("text") / F.lit(15.0)).alias("dur"), (F.col("turn") % 7 / F.lit(50.0)).alias("wer"))
    return gates.gated(rows, "conv_id").select("conv_id", "turn", "passed")
