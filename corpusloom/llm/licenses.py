"""License scans with ordered signature rules, with DataFrame expressions only.

A text is brought to words (A-Z lower-cased; runs outside ``[0-9a-z]`` and non-ASCII separate them). A keyword prefilter
lets few texts through to the rules, and each rule's own keyword few rules to a text. A rule is a hand-written regex over
the words with a tier (3: full notice, 2: statement, 1: mention) and an order. A match is an interval of words; it is
suppressed where an interval of a higher tier, or of the same tier and longer or equal and earlier in the rule order,
contains it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Marks of a match's first and last word; no word holds them.
OPENS, CLOSES = "\x01", "\x02"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Matches of a text that are compared at a time.
PART = 256

#: Phrases whose every place counts, with their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Families: label; how the name is written (over words); words of which every such name holds one; the short identifier.
FAMILIES = (
    ("mit", "(?:mit|expat)", "mit|expat", "mit"),
    ("x11", "x11", "x11", "x11"),
    ("isc", "isc", "isc", "isc"),
    ("apache-1", "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", "apache", "apache 1 [01]"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache", "apache 2 0"),
    ("bsd-2", "(?:bsd 2 clause|simplified bsd|freebsd)", "bsd", "bsd 2 clause"),
    ("bsd-3", "(?:bsd 3 clause|(?:new|modified|revised) bsd)", "bsd", "bsd 3 clause"),
    ("bsd-4", "(?:bsd 4 clause|(?:original|old) bsd)", "bsd", "bsd 4 clause"),
    ("bsd-0", "(?:bsd 0 clause|0bsd|zero clause bsd)", "bsd", "0bsd"),
    ("gpl-1", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?", "gpl|general public", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", "gpl|general public", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", "gpl|general public", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "(?:gnu )?(?:(?:library|lesser) general public license|lgpl)(?: version| v)? ?2(?: [01])?", "gpl|general public", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", "gpl|general public", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", "gpl|general public", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "(?:gnu )?(?:free documentation license|gfdl|fdl)", "fdl|free documentation", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "(?:mozilla public license|mpl)(?: version| v)? ?1(?: [01])?", "mpl|mozilla", "mpl 1 [01]"),
    ("mpl-2", "(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", "mpl|mozilla", "mpl 2 0"),
    ("epl-1", "(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", "epl|eclipse", "epl 1 0"),
    ("epl-2", "(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", "epl|eclipse", "epl 2 0"),
    ("cddl-1", "(?:common development and distribution license|cddl)(?: version| v)? ?1(?: [01])?", "cddl|common development", "cddl 1 [01]"),
    ("cpl-1", "(?:common public license|cpl)(?: version| v)? ?1(?: 0)?", "cpl|common public", "cpl 1 0"),
    ("eupl-1", "(?:european union public license|eupl)(?: version| v)? ?1(?: [012])?", "eupl|european union", "eupl 1 [012]"),
    ("artistic-1", "(?:the )?artistic license(?: version)? 1(?: 0)?", "artistic", "artistic 1 0"),
    ("artistic-2", "(?:the )?artistic license(?: version)? 2(?: 0)?", "artistic", "artistic 2 0"),
    ("zlib", "zlib(?: libpng)?", "zlib", "zlib"),
    ("boost-1", "boost software license(?: version)? 1(?: 0)?", "boost", "bsl 1 0"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "wtfpl|what the fuck", "wtfpl"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "cc0|cc zero|creative commons", "cc0 1 0"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1234](?: [05])?)?(?: international| unported)?", "cc by|creative commons", "cc by [1234] [05]"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1234](?: [05])?)?", "cc by|creative commons", "cc by sa [1234] [05]"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: [1234](?: [05])?)?", "cc by|creative commons", "cc by nd [1234] [05]"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1234](?: [05])?)?", "cc by|creative commons", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234](?: [05])?)?", "cc by|creative commons", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [1234](?: [05])?)?", "cc by|creative commons", "cc by nc nd [1234] [05]"),
    ("python-2", "(?:python software foundation license|psf license|psfl)(?: version)?(?: 2)?", "python software|psf", "python 2 0"),
    ("php-3", "php license(?: version)? ?3(?: 01?)?", "php", "php 3 01"),
    ("ruby", "ruby(?: s)? license", "ruby", "ruby"),
    ("perl", "(?:same terms as )?perl(?: 5)?(?: itself)?", "perl", "perl"),
    ("openssl", "openssl(?: license)?", "openssl", "openssl"),
    ("postgresql", "postgresql license", "postgresql", "postgresql"),
    ("ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa", "ncsa"),
    ("ofl-1", "(?:sil )?(?:open font license|ofl)(?: version| v)?(?: 1)?(?: [01])?", "ofl|open font", "ofl 1 [01]"),
    ("odbl-1", "(?:open database license|odbl)(?: v)?(?: 1)?(?: 0)?", "odbl|open database", "odbl 1 0"),
    ("odc-by", "(?:open data commons attribution(?: license)?|odc by)", "odc by|open data commons", "odc by 1 0"),
    ("pddl", "(?:public domain dedication and license|pddl)", "pddl|public domain dedication", "pddl 1 0"),
    ("cdla-permissive", "(?:community data license agreement permissive|cdla permissive)", "cdla|community data", "cdla permissive [12] 0"),
    ("cdla-sharing", "(?:community data license agreement sharing|cdla sharing)", "cdla|community data", "cdla sharing 1 0"),
    ("sspl-1", "(?:server side public license|sspl)(?: v)? ?(?:1)?", "sspl|server side", "sspl 1 0"),
    ("busl-1", "(?:business source license|busl|bsl)(?: 1 1)?", "busl|bsl|business source", "busl 1 1"),
    ("elastic-2", "elastic license(?: 2(?: 0)?)?", "elastic", "elastic 2 0"),
    ("ms-pl", "(?:microsoft public license|ms pl)", "ms pl|microsoft public", "ms pl"),
    ("ms-rl", "(?:microsoft reciprocal license|ms rl)", "ms rl|microsoft reciprocal", "ms rl"),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", "rail", "openrail"),
    ("llama", "llama [23](?: [123])? community license", "llama", "llama [23]"),
    ("mulan-2", "mulan (?:psl|permissive software license)(?: v)? ?2", "mulan", "mulanpsl 2 0"),
    ("oracle-upl", "universal permissive license", "universal", "upl 1 0"),
    ("afl-3", "(?:academic free license|afl)(?: version| v)? ?3(?: 0)?", "afl|academic free", "afl 3 0"),
    ("osl-3", "(?:open software license|osl)(?: version| v)? ?3(?: 0)?", "osl|open software", "osl 3 0"),
    ("vim", "vim license", "vim", "vim"),
    ("tcl", "tcl(?: tk)? license", "tcl", "tcl"),
    ("json", "json license", "json", "json"),
    ("beerware", "beer ?ware(?: license)?", "beer", "beerware"),
)

#: Statements that hold a family's name: pattern, tier.
STATEMENTS = (
    ("(?:re)?(?:licensed|released|distributed|published|provided|available) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name}(?: (?:public )?licen[cs]e)?", 3),
    ("(?:governed by|subject to|covered by|in accordance with) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", 3),
    ("spdx license identifier {short}", 3),
    ("(?:under|by) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", 2),
    ("licen[cs]e {name}", 2),
    ("{name} licen[cs]e[ds]?", 1),
)

#: Rules without a family: label, pattern, tier, keyword.
LOOSE = (
    ("gpl", "(?:under|by) the (?:terms of the )?(?:gnu )?(?:general public license|gpl)", 2, "gpl|general public"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 3, "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 3, "redistribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 3, "permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", 3, "warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 3, "unencumbered"),
    ("gpl", "free software foundation either version", 3, "foundation"),
    ("public-domain", "(?:in|into|to) the public domain", 2, "domain"),
    ("proprietary", "all rights reserved", 1, "reserved"),
    ("proprietary", "(?:proprietary and confidential|unauthorized copying of this)", 2, "proprietary|unauthorized"),
    ("warranty-disclaimer", "without warrant(?:y|ies) of any kind", 1, "warrant"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 1, "copyright"),
)

def rules() -> list[tuple[int, str, str, int, str]]:
    """(order, label, regex, tier, keyword) of all rules, base phrases first."""
    found = [(label, phrase, 2, phrase.split()[0]) for label, phrase in BASE]
    for pattern, tier in STATEMENTS:
        for label, name, keyword, short in FAMILIES:
            found.append((label, pattern.format(name=name, short=short), tier, keyword if "{name}" in pattern else "spdx"))
    found += LOOSE
    return [(i, label, regex, tier, keyword) for i, (label, regex, tier, keyword) in enumerate(found)]


def prefilter() -> str:
    """A cheap test on the raw text, made of the rules: every text that a rule matches passes it.

    A statement with a word for license in it needs that word, every other one its lead and a family's name, base phrases
    and loose rules themselves. Blanks stand for any run that separates words.
    """
    leads = [pattern.split("{name}")[0] for pattern, _ in STATEMENTS if not pattern.startswith(("licen", "spdx license", "{name} licen"))]
    names = "|".join(name for _, name, _, _ in FAMILIES)
    parts = ["licen[cs]e", *[phrase for _, phrase in BASE], *[pattern for _, pattern, _, _ in LOOSE], f"(?:{'|'.join(leads)})(?:{names})"]
    return "(?i)" + "|".join(parts).replace(" ", f"(?:{NOT_WORD})")


#: A text that does not hold this goes to no rule.
PREFILTER = prefilter()


def normal(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, with a blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " ")), F.lit(" "))


def _starts(words: Column, regex: Column) -> Column:
    """array<struct<first,last>>: first and last word of each match of ``regex`` between blanks.

    As there is no function for the places of matches, each match is marked at its first and last word; a word's own
    characters hold no such mark, and the words keep their numbers. A match takes the blank before it and leaves the
    one after it, so that a next match may begin there.
    """
    marked = F.regexp_replace(words, F.concat(F.lit(" ("), regex, F.lit(")(?= )")), F.lit(f" {OPENS}$1{CLOSES}"))
    places = lambda words, edge: F.array_compact(F.transform(words, lambda w, i: F.when(edge(w), i)))
    both = lambda words: F.zip_with(places(words, lambda w: w.startswith(OPENS)), places(words, lambda w: w.endswith(CLOSES)), lambda a, z: F.struct(a.alias("first"), z.alias("last")))
    # the marked words are made once for both edges
    return let(F.split(F.ltrim(marked), " "), both)


def detections(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words and ``raw``: array of all matches of all rules (first, last, tier, rule, label)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(text.rlike(PREFILTER), normal(text)).alias("_words"))
    listed = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(tier).alias("tier"), F.array(*map(F.lit, keyword.split("|"))).alias("keywords")) for i, label, regex, tier, keyword in rules()])
    gated = F.filter(listed, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("_words"), k)))
    matched = F.transform(
        F.filter(gated, lambda r: F.regexp_like(F.col("_words"), F.concat(F.lit(" (?:"), r["regex"], F.lit(")(?= )")))),
        lambda r: F.transform(_starts(F.col("_words"), r["regex"]), lambda m: F.struct(m["first"].alias("first"), (-m["last"]).alias("neg_last"), (-r["tier"]).alias("neg_tier"), r["rule"].alias("rule"), m["last"].alias("last"), r["tier"].alias("tier"), r["label"].alias("label"))),
    )
    empty = "array<struct<first:int,neg_last:int,neg_tier:int,rule:int,last:int,tier:int,label:string>>"
    return rows.select(*keep, "n_words", F.when(F.col("_words").isNotNull(), F.sort_array(F.flatten(matched))).otherwise(F.array().cast(empty)).alias("raw"))


def kept_detections(raw: Column) -> Column:
    """The matches that no interval of a higher tier, or of an equal one that is longer or earlier in order, contains.

    The matches come sorted by first word, longest first, highest tier first, rule order; so what contains a match
    stands before it, or has its very interval, and the furthest end seen so far in each tier decides.
    """
    tiers = (1, 2, 3)
    kind = "array<struct<first:int,last:int,tier:int,rule:int,label:string>>"

    def step(s: Column, m: Column) -> Column:
        reach = F.greatest(*[F.when(m["tier"] <= t, s[f"end{t}"]).otherwise(-1) for t in tiers])
        one = F.struct(m["first"].alias("first"), m["last"].alias("last"), m["tier"].alias("tier"), m["rule"].alias("rule"), m["label"].alias("label"))
        ends = [F.when((m["tier"] == t) & (m["last"] > s[f"end{t}"]), m["last"]).otherwise(s[f"end{t}"]).alias(f"end{t}") for t in tiers]
        return F.struct(*ends, F.when(reach >= m["last"], s["found"]).otherwise(F.concat(s["found"], F.array(one))).alias("found"))

    # some matches at a time, so that an array which grows match by match stays short
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(raw) - 1) / PART).cast("int")), lambda b: F.slice(raw, b * PART + 1, PART))
    start = F.struct(*[F.lit(-1).alias(f"end{t}") for t in tiers], F.array().cast(kind).alias("found"))

    def over(done: Column, part: Column) -> Column:
        before = F.element_at(done, -1)
        return F.concat(done, F.array(F.aggregate(part, F.struct(*[before[f"end{t}"].alias(f"end{t}") for t in tiers], F.array().cast(kind).alias("found")), step)))

    return F.when(F.size(raw) > 0, F.aggregate(parts, F.array(start), over, lambda done: F.flatten(F.transform(done, lambda s: s["found"])))).otherwise(F.array().cast(kind))


def scan_licenses(spark: SparkSession, docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, detections, base (all places of the base phrases), labels and score.

    ``score`` is 0 without a detection, else 1 - 0.5^tiers over the kept detections' tiers, up to their sum of 10. A null
    or empty text has no words and no detections; repeated rows and null ids are rows like others; an empty table gives
    an empty result; columns outside ``keep`` are not looked at. Nothing is shuffled: a text is scanned where it is.
    """
    found = detections(docs, text_col, list(keep))
    base = F.filter("raw", lambda m: m["rule"] < len(BASE))
    out = found.withColumn("detections", kept_detections(F.col("raw"))).withColumn("base", base).drop("raw")
    total = F.least(F.aggregate("detections", F.lit(0), lambda n, m: n + m["tier"]), F.lit(10))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    base_labels = labels(F.col("base"))
    every = labels(F.concat(F.transform("base", lambda m: F.struct(m["label"].alias("label"))), F.transform("detections", lambda m: F.struct(m["label"].alias("label")))))
    return out.select(*keep, "n_words", "detections", "base", base_labels.alias("base_labels"), every.alias("labels"), F.when(F.size("detections") > 0, 1 - F.pow(F.lit(0.5), total)).otherwise(0.0).alias("score"))
