"""Secret scans: candidate strings, and a random forest that removes false positives; DataFrame expressions only.

Candidates come line by line from one pattern of secret-like shapes: prefixed provider keys, key blocks, values that are
assigned or passed to a name, and long runs of hex, base64 or mixed characters. The forest never sees which shape found
a candidate. Its features are the candidate's length, its transitions between character classes, the share of it that
dictionary pieces cover, what its path (source and place in the text) looks like, and the words beside it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm.mixing import uniform
from corpusloom.session import saved

#: Words that name a secret when they stand before it.
NAMES = r"(?i)(?:api[ _-]?key|access[ _-]?key|secret|token|passw(?:or)?d|passwd|pwd|credential|auth|bearer|private[ _-]?key|client[ _-]?secret)"
#: Shapes of candidates, tried in this order at each place of a line: what is assigned or passed to a secret's name, quoted
#: or bare, of any length; the password of an address; keys of known providers; long runs.
SHAPES = (
    rf"(?<=[\"'])(?<={NAMES}[\"']?[ \t]{{0,3}}(?:=|:|=>|\(|,)[ \t]{{0,3}}[\"'])[^\"'\n]{{3,}}(?=[\"'])",
    rf"(?<=[=:>(][ \t]{{0,3}})(?<={NAMES}[\"']?[ \t]{{0,3}}(?:=|:|=>|\()[ \t]{{0,3}})[^\s\"'`,;()<>]{{4,}}",
    r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s@/]{3,}(?=@)",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{20,}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk-[0-9A-Za-z_-]{16,}",
    r"AIza[0-9A-Za-z_-]{30,}",
    r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"[0-9A-Fa-f]{20,}",
    r"[0-9A-Za-z+/_-]{16,}={0,2}",
)
CANDIDATE = "|".join(f"(?:{s})" for s in SHAPES)
#: Words that stand beside long strings that are none.
HARMLESS = r"(?i)(?:sha-?\d*|md5|commit|revision|checksum|digest|uuid|guid|etag|build|version|isbn|card|phone|order|invoice|example|dummy|sample|placeholder|test)"
#: Pieces of ordinary words and of placeholders, lower case.
PIECES = "the|and|ing|tion|ent|ion|her|for|that|ere|con|ver|ment|able|ous|ter|ist|est|ich|ein|sch|und|der|die|ung|keit|heit|que|les|des|ont|eau|aire|ado|ente|los|las|cion|example|dummy|sample|test|null|none|change|your|placeholder|xxxx|0000|1234"

MOST_FINDINGS = 20_000
CHECKED_MOD = 5
TREES, DEPTH = 24, 7
#: Findings of either label that are made by rule and always learned from.
SEEDS = 64
FEATURES = ["f_len", "f_log_len", "f_upper", "f_lower", "f_digit", "f_other", "f_turns", "f_entropy", "f_distinct", "f_dictionary", "f_vowels", "f_before_name", "f_before_harmless", "f_assigned", "f_quoted", "f_after_quote", "f_words_before", "f_line_share", "f_path_depth", "f_path_test", "f_place"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, path, line, start (in the line, from 0), value, before, after, n_lines, line_chars.

    The texts between the matches of the pattern give their places and their surroundings. Rows of the table keep to
    themselves: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(text.rlike(CANDIDATE)).select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.split(text, "\n").alias("lines"))
    rows = rows.select("id", "path", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "said")).filter(F.col("said").rlike(CANDIDATE))
    rows = rows.select("id", "path", "n_lines", "line", F.length("said").alias("line_chars"), F.regexp_extract_all("said", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("said", CANDIDATE).alias("gaps"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, both: Column) -> Column:
        start = s["at"] + F.length(both["gap"])
        return F.struct((start + F.length(both["hit"])).alias("at"), F.concat(s["found"], F.array(start)).alias("found"))

    pairs = F.zip_with("hits", F.slice("gaps", 1, F.size("hits")), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    rows = rows.withColumn("starts", F.aggregate(pairs, state, step, lambda s: s["found"]))
    rows = rows.select("*", F.posexplode("hits").alias("i", "value"))
    before, after = F.element_at("gaps", F.col("i") + 1), F.element_at("gaps", F.col("i") + 2)
    return rows.select("id", "path", "line", F.element_at("starts", F.col("i") + 1).alias("start"), "value", F.right(before, F.lit(60)).alias("before"), F.left(after, F.lit(30)).alias("after"), "n_lines", "line_chars")


def _share(kind: str) -> Column:
    return F.length(F.regexp_replace("value", f"[^{kind}]", "")) / F.length("value")


def featured(found: DataFrame) -> DataFrame:
    """``found`` with the feature columns; every feature is a number for any candidate."""
    size = F.length("value")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    characters = F.split("value", "")
    counts = F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, n: s - n / size * F.log2(n / size))
    letters = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    covered = size - F.length(F.regexp_replace(F.lower("value"), PIECES, ""))
    last = F.right("before", F.lit(24))
    return found.select(
        "*",
        F.least(size, F.lit(200)).cast("double").alias("f_len"), F.log(size.cast("double")).alias("f_log_len"),
        _share("A-Z").alias("f_upper"), _share("a-z").alias("f_lower"), _share("0-9").alias("f_digit"), _share("^0-9A-Za-z").alias("f_other"),
        (F.length(shape) / size).alias("f_turns"), entropy.alias("f_entropy"), (F.size(counts) / size).alias("f_distinct"),
        (covered / size).alias("f_dictionary"),
        (F.length(F.regexp_replace(letters, "[^aeiou]", "")) / F.greatest(F.length(letters), F.lit(1))).alias("f_vowels"),
        last.rlike(NAMES).cast("double").alias("f_before_name"), F.col("before").rlike(HARMLESS).cast("double").alias("f_before_harmless"),
        last.rlike(r"(?:=|:|=>|\()\s*[\"']?$").cast("double").alias("f_assigned"), last.rlike("[\"'`]$").cast("double").alias("f_quoted"),
        F.col("after").rlike("^[\"'`]").cast("double").alias("f_after_quote"),
        F.regexp_count("before", F.lit(r"\S+")).cast("double").alias("f_words_before"), (size / F.greatest("line_chars", F.lit(1))).alias("f_line_share"),
        F.regexp_count("path", F.lit("[/.]")).cast("double").alias("f_path_depth"), F.col("path").rlike("(?i)test|example|sample|fixture|mock|doc").cast("double").alias("f_path_test"),
        (F.col("line") / F.col("n_lines")).alias("f_place"),
    )


def evident_label(value: Column, before: Column, after: Column) -> Column:
    """The label of a finding whose nature is plain: 1, 0, or null where it is not.

    A random-looking quoted string of 16 characters or more that is assigned to a secret's name is one; plain words,
    placeholders, and strings beside words for digests and numbers are not.
    """
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16) & ~value.rlike("(?i)example|dummy|sample|placeholder|x{4,}|0{6,}|1234567")
    named = before.rlike(NAMES + r"[\"']?\s*(?:=|:|=>)\s*[\"']$") & after.rlike("^[\"']")
    plain = value.rlike("^[A-Za-z_-]+$") | value.rlike("^[0-9-]+$") | value.rlike("(?i)example|dummy|sample|placeholder|x{4,}") | before.rlike(HARMLESS + r"\s*[:=#]?\s*[\"']?$")
    return F.when(random & named & ~before.rlike(HARMLESS + r"\s*[:=#]?\s*[\"']?$"), 1).when(plain, 0)


def labelled_findings(found: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """Findings (candidate columns and ``label``) of known nature, at most about ``most`` of either label.

    Only rows whose crc32 of the id is not 0 modulo 5 are used, so the rest can check the forest. Copies of a finding
    count once.
    """
    known = found.withColumn("label", evident_label(F.col("value"), F.col("before"), F.col("after"))).filter("label IS NOT NULL")
    known = known.filter(F.coalesce(F.crc32(F.col("id").cast("string")), F.lit(1)) % CHECKED_MOD != 0)
    known = known.withColumn("_by", uniform(F.col("value"), F.col("before"), seed="findings"))
    # of copies the least row, so that the same findings are taken in every run
    known = known.groupBy("value", "before").agg(F.min(F.struct(*[c for c in known.columns if c not in ("value", "before")])).alias("f")).select("value", "before", "f.*").select(known.columns)
    some = [known.filter(F.col("label") == y).orderBy("_by", "value", "before").limit(most) for y in (0, 1)]
    return some[0].unionByName(some[1]).drop("_by")


def seeded_findings(spark: SparkSession, each: int = SEEDS) -> DataFrame:
    """Labelled findings made by rule: ``each`` secrets and as many harmless strings, whatever the corpus holds.

    Secrets are keys of providers and values given to a secret's name; the others are digests, numbers, words and
    placeholders in the places where they usually stand. Random characters follow from the hash of the row's number.
    """
    digest = F.sha2(F.concat(F.lit("seed|"), F.col("i").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    part = lambda n: F.substring(mixed, 1, n)
    quoted = lambda name: (F.concat(F.lit(name), F.lit(' = "')), F.lit('"'))
    # fixed values: forms of provider keys, names of secrets, and what stands beside harmless strings
    secret = [
        (F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))), *quoted("key")), (F.concat(F.lit("ghp_"), part(36)), F.lit("use "), F.lit(" here")),
        (part(40), *quoted("api_key")), (digest, *quoted("token")), (F.concat(part(9), F.lit("!")), *quoted("password")), (F.concat(F.lit("sk-"), part(32)), F.lit("Bearer "), F.lit("")),
        (F.concat(part(4), F.lit("#"), F.substring(mixed, 9, 5)), F.lit("pwd: '"), F.lit("'")), (part(24), F.lit("client_secret="), F.lit("")),
    ]
    harmless = [
        (F.substring(digest, 1, 40), F.lit("commit "), F.lit(" merged")), (digest, F.lit("sha256: "), F.lit("")), (F.translate(F.substring(digest, 1, 20), "abcdef", "123456"), F.lit("order "), F.lit(" sent")),
        (F.lit("placeholder-value-here"), *quoted("token")), (F.lit("averyverylongordinaryword"), F.lit("the "), F.lit(" is")), (F.lit("your-password-example"), *quoted("password")),
        (F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 12)), F.lit("uuid "), F.lit("")), (F.lit("some/path/to/ordinary_file_name"), F.lit("see "), F.lit(" for")),
    ]
    made = None
    for label, forms in ((1, secret), (0, harmless)):
        for k, (value, before, after) in enumerate(forms):
            some = spark.range(-(-each // len(forms))).select((F.col("id") * 16 + label * 8 + k).alias("i")).select(F.lit(label).alias("label"), value.alias("value"), before.alias("before"), after.alias("after"))
            made = some if made is None else made.unionByName(some)
    line = F.length("before") + F.length("value") + F.length("after")
    return made.select(F.lit(None).cast("string").alias("id"), F.lit("").alias("path"), F.lit(0).alias("line"), F.length("before").alias("start"), "value", "before", "after", F.lit(1).alias("n_lines"), line.alias("line_chars"), "label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """The forest of labelled findings (candidate columns and ``label`` 0 or 1)."""
    # a bounded sample: a few partitions hold it, and either label weighs the same in total
    rows = featured(findings).select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(4)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 1 / max(1, sizes.get(1.0, 0))).otherwise(1 / max(1, sizes.get(0.0, 0))) * (sum(sizes.values()) / 2)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("weight", weight)).select("features", "label", "weight")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=7, weightCol="weight", minInstancesPerNode=2).fit(rows)


def scan_secrets(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate of every text: ``id_col``, path, line, start, stop, value, probability, is_secret.

    ``findings`` are labelled findings (candidate columns and label); without them the candidates of evident nature
    are taken. The forest also learns from :func:`seeded_findings`, so there is always one, even where the corpus shows one
    label or none. Null texts and ids, empty and very long texts, repeated rows (each its own findings) and empty
    tables are fine; other columns are not looked at.
    """
    found = saved(candidates(docs, id_col, text_col, path_col), spark)
    known = labelled_findings(found) if findings is None else findings
    seeds = seeded_findings(spark)
    learned = [c for c in seeds.columns if c != "id"]
    findings = saved(known.select(learned).unionByName(seeds.select(learned)), spark)
    columns = [F.col("id").alias(id_col), "path", "line", "start", (F.col("start") + F.length("value")).alias("stop"), "value"]
    model = train(findings)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found)))
    probability = F.element_at(vector_to_array("probability"), 2)
    return scored.select(*columns, probability.alias("probability"), (probability >= threshold).alias("is_secret"))
