"""Quality rules: repetition and length rules, and perplexity bands of a character n-gram model.

The model is an interpolated modified Kneser-Ney model of character n-grams inside words (with a mark at either end),
one per language, counted by Spark over the plain words of all documents. Its tables are joined level by level in Spark, hashed, and
stored as sorted arrays of 64-bit hashes with log probabilities and back-off weights, which tasks search by bisection.
Where the tables are more than a task should hold, it holds the most frequent n-grams, and Spark joins the others with the
whole tables. Both ways add the same whole steps of log probability, so the result is one and the same.
A document's perplexity is per character; each language has a lower and an upper bound, set by the median and the
median absolute deviation of all its documents, and documents outside are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.llm.shingles import grouped, mixed, words
from corpusloom.session import saved

ORDER = 4
BEGIN, END = "\x02", "\x03"
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Bound of the model that is sent to every task: 16 bytes an entry. What it leaves out is joined by Spark.
MOST_ENTRIES = 12_000_000
#: Log probabilities are added in whole steps of this size, so that a sum knows no order: 2^31 of them are 2,048 nats.
SCALE = 1 << 20
NO_MODEL = -12.0
MEMO = 200_000
SPREADS = 6.0
LEAST_BAND = 0.5
STEP = 1 / 512

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]



def natural(word: str, raw: bytes) -> bool:
    """Whether the model learns from a word: no markup sign in it and not a shout.

    What it learns is how plain words are written; were it to learn from sign and capital noise as well, that noise
    would get as likely as text wherever a corpus holds enough of it.
    """
    return len(raw.translate(None, SYMBOLS)) == len(raw) and not (len(word) > 2 and word.isupper())


def count_grams(docs: DataFrame, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each longest n-gram occurs; shorter ones only where a word begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, dict[str, int]] = {}
            texts = [(x.as_py() or "").encode() for x in batch.column(0)]
            own = [x.as_py() or "" for x in batch.column(1)]
            # some texts at a time: the words of a few megabytes are held at once
            for lo, hi in grouped(texts, 1 << 22):
                by_lang: dict[str, Counter] = {}
                for text, lang in zip(texts[lo:hi], own[lo:hi], strict=True):
                    by_lang.setdefault(lang, Counter()).update(text.split())
                for lang, found in by_lang.items():
                    total = totals.setdefault(lang, {})
                    get = total.get
                    for word, n in found.items():
                        plain = word.decode()
                        if not natural(plain, word):
                            continue
                        marked = BEGIN + plain + END
                        for i in range(2, len(marked) + 1):
                            gram = marked[max(0, i - order) : i]
                            total[gram] = get(gram, 0) + n
            langs, grams, counts = [], [], []
            for lang, total in totals.items():
                langs += [lang] * len(total)
                grams += total.keys()
                counts += total.values()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    partial = docs.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, gram string, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(spark: SparkSession, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp, backoff): modified Kneser-Ney from the counts of :func:`count_grams`.

    Below the highest order an n-gram counts the different characters before it, but for those at a word's begin.
    """
    level = {order: grams.filter(F.length("gram") == order)}
    for n in range(order - 1, 0, -1):
        begin = grams.filter((F.length("gram") == n) & F.col("gram").startswith(BEGIN))
        within = level[n + 1].select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("n"))
        # one sum over both: an n-gram within a word begins with the mark where a text holds that character
        level[n] = saved(begin.unionByName(within).groupBy("lang", "gram").agg(F.sum("n").alias("n")), spark)
    every = level[1]
    for n in range(2, order + 1):
        every = every.unionByName(level[n])
    every = every.withColumn("k", F.length("gram")).withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)"))
    # one row per language and order
    by_count = every.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("types"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        raw = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        # tables too small to estimate from get the usual constants
        good = (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0) & (raw > 0) & (raw < i)
        return F.when(good, raw).otherwise(F.lit({1: 0.5, 2: 0.75, 3: 0.9}[i]))

    # written, so that the planner knows it is small and deals no n-grams out by their language for it
    by_count = saved(by_count.select("lang", "k", "types", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]), spark)
    # whole numbers times the language's discounts, so that the sum knows no order
    held = F.first("d1") * F.count_if(F.col("n") == 1) + F.first("d2") * F.count_if(F.col("n") == 2) + F.first("d3") * F.count_if(F.col("n") > 2)
    contexts = every.join(by_count, ["lang", "k"]).groupBy("lang", "ctx").agg(F.sum("n").alias("total"), held.alias("held"), *[F.first(c).alias(c) for c in ("types", "d1", "d2", "d3")])
    # all that follows reads this one table: each context is summed once
    contexts = saved(contexts.withColumn("gamma", F.col("held") / F.col("total")).drop("held"), spark)
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = (F.col("n") - d) / F.col("total")
    none = F.lit(None).cast("long").alias("n")
    done = []
    for n in range(1, order + 1):
        some = level[n].withColumn("ctx", F.expr(f"substring(gram, 1, {n - 1})")).join(contexts.filter(F.length("ctx") == n - 1), ["lang", "ctx"])
        if n == 1:
            now = some.select("lang", "gram", "n", (own + F.col("gamma") / (F.col("types") + 1)).alias("p"))
        else:
            lower = done[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            some = some.select("lang", "gram", "n", own.alias("own"), "gamma", F.expr("substring(gram, 2)").alias("suffix"))
            now = some.join(lower, ["lang", "suffix"]).select("lang", "gram", "n", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        done.append(saved(now, spark) if n < order else now)
    out = contexts.filter("ctx = ''").select("lang", F.lit("").alias("gram"), F.log(F.col("gamma") / (F.col("types") + 1)).alias("logp"), F.lit(0.0).alias("backoff"), none)
    out = out.unionByName(done[-1].select("lang", "gram", F.log("p").alias("logp"), F.lit(0.0).alias("backoff"), "n"))
    if order > 1:
        weights = contexts.filter("ctx != ''").select("lang", F.col("ctx").alias("gram"), F.log("gamma").alias("backoff"))
        lower = done[0]
        for some in done[1:-1]:
            lower = lower.unionByName(some)
        out = out.unionByName(lower.join(weights, ["lang", "gram"], "left").select("lang", "gram", F.log("p").alias("logp"), F.coalesce("backoff", F.lit(0.0)).alias("backoff"), "n"))
        # a context that begins a word is no n-gram of its own when it is the mark alone
        mark = weights.filter(F.col("gram") == BEGIN).join(done[0].filter(F.col("gram") == BEGIN), ["lang", "gram"], "left_anti")
        out = out.unionByName(mark.select("lang", "gram", F.lit(0.0).alias("logp"), "backoff", none))
    return saved(out, spark)


def gram_hashes(chars: np.ndarray, lang: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for n = 1, 2, …, order; places near the start are not valid."""
    h = mixed(lang ^ (chars.astype(np.uint64) + np.uint64(1)))
    out = [h]
    for n in range(1, order):
        before = np.zeros(len(chars), np.uint64)
        before[n:] = chars[: len(chars) - n]
        h = mixed(h * np.uint64(0x9DDFEA08EB382D69) + before + np.uint64(1))
        out.append(h)
    return out


def lang_key(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def steps(x: Column) -> Column:
    """A log probability in whole steps of 1 / ``SCALE``."""
    return F.rint(x * SCALE).cast("int")


class Model:
    """Sorted hashes with a log probability and a back-off weight each, in steps; ``whole`` unless some n-grams are left out."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, backoff: np.ndarray, unknown: dict[str, int], order: int, whole: bool):
        self.hashes, self.logp, self.backoff, self.unknown, self.order, self.whole = hashes, logp, backoff, unknown, order, whole

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return at, self.hashes[at] == keys

    def score(self, lang: str, found: list[str]) -> np.ndarray:
        """Log probability of each word with its end, without the n-grams of :meth:`score_open`."""
        return self.score_open(lang, found)[0]

    def score_open(self, lang: str, found: list[str]) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Log probability of each word with its end, and (word, n-gram) of all that only the whole tables tell."""
        if not found:
            return np.zeros(0, np.int64), []
        joined = "".join([BEGIN + w + END for w in found])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.fromiter((len(w) + 2 for w in found), np.int64, len(found))
        starts = np.cumsum(length) - length
        hashes = gram_hashes(chars, np.full(len(chars), lang_key(lang)), self.order)
        inside = np.arange(len(chars)) - np.repeat(starts, length)
        left = np.flatnonzero(inside > 0)
        value = np.zeros(len(chars), np.int64)
        open_: list[tuple[int, str]] = []
        for n in range(self.order, 0, -1):
            ready = inside[left] + 1 >= n
            now = left[ready]
            # equal n-grams are looked up once, in order, which keeps the bisection in cache
            keys, back = np.unique(hashes[n - 1][now], return_inverse=True)
            at, hit = self.find(keys)
            hit, at = hit[back], at[back]
            value[now[hit]] += self.logp[at[hit]]
            missed = now[~hit]
            if not self.whole:
                # whether it is left out or was never seen is not known here
                word = np.searchsorted(starts, missed, "right") - 1
                open_ += [(w, joined[i - n + 1 : i + 1]) for w, i in zip(word.tolist(), missed.tolist(), strict=True)]
                missed = missed[:0]
            elif n > 1 and len(missed):
                at, known = self.find(hashes[n - 2][missed - 1])
                value[missed[known]] += self.backoff[at[known]]
            elif len(missed):
                value[missed] += self.unknown.get(lang, round(NO_MODEL * SCALE))
            left = np.concatenate([left[~ready], missed])
        return np.add.reduceat(value, starts), open_


def sorted_arrays(spark: SparkSession, table: DataFrame, order: int = ORDER, most: int = MOST_ENTRIES) -> Model:
    """The model's tables as sorted hash arrays.

    If there are more than ``most`` entries, they are those of the most frequent n-grams that end a look-up at once: the
    longest ones and those that begin a word. All others are for :func:`settled`.
    """
    entries = table.filter("gram != ''")
    whole = entries.count() <= most
    if not whole:
        entries = entries.filter((F.length("gram") == order) | (F.col("gram").startswith(BEGIN) & (F.length("gram") > 1)))
        by_count = entries.groupBy("n").count()
        cut = by_count.withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("n")))).filter(F.col("upto") > most).agg(F.max("n")).first()[0]
        entries = entries.filter(F.col("n") > F.lit(cut or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = {x: lang_key(x) for x in set(langs)}
            out = np.empty(len(grams), np.uint64)
            for n in {len(g) for g in grams}:
                rows = [i for i, g in enumerate(grams) if len(g) == n]
                chars = np.frombuffer("".join([grams[i] for i in rows]).encode("utf-32-le"), np.uint32)
                lang = np.repeat(np.array([keys[langs[i]] for i in rows], np.uint64), n)
                out[rows] = gram_hashes(chars, lang, order)[n - 1][n - 1 :: n]
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()]), pa.array([np.asarray(batch.column(2), np.int32).tobytes()]), pa.array([np.asarray(batch.column(3), np.int32).tobytes()])], names=["h", "p", "b"])

    parts = entries.select("lang", "gram", steps(F.col("logp")), steps(F.col("backoff"))).mapInArrow(run, "h binary, p binary, b binary").collect()
    join = lambda i, kind: np.frombuffer(b"".join(bytes(x[i]) for x in parts), kind)
    hashes = join(0, np.uint64)
    by_hash = np.argsort(hashes, kind="stable")
    unknown = {r["lang"]: r["v"] for r in table.filter("gram = ''").select("lang", steps(F.col("logp")).alias("v")).collect()}
    return Model(hashes[by_hash], join(1, np.int32)[by_hash], join(2, np.int32)[by_hash], unknown, order, whole)


def looked_up(spark: SparkSession, asked: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, value): the log probability in steps of the last character of each n-gram of ``asked`` (lang, gram).

    Joins with the whole tables, level by level; what :meth:`Model.score` does with a whole model.
    """
    entries = table.filter("gram != ''").select("lang", F.col("gram").alias("_g"), steps(F.col("logp")).alias("logp"), steps(F.col("backoff")).alias("backoff"))
    unknown = table.filter("gram = ''").select("lang", steps(F.col("logp")).alias("logp"))
    left = saved(asked.withColumn("value", F.lit(0).cast("long")), spark)
    done = []
    for n in range(order, 0, -1):
        now = left.filter(F.length("gram") >= n).withColumn("_g", F.expr(f"right(gram, {n})"))
        now = saved(now.join(entries.select("lang", "_g", "logp"), ["lang", "_g"], "left").drop("_g"), spark)
        done.append(now.filter("logp IS NOT NULL").select("lang", "gram", (F.col("value") + F.col("logp")).alias("value")))
        missed = now.filter("logp IS NULL").drop("logp")
        if n > 1:
            missed = missed.withColumn("_g", F.expr(f"left(right(gram, {n}), {n - 1})")).join(entries.select("lang", "_g", "backoff"), ["lang", "_g"], "left")
            missed = missed.select("lang", "gram", (F.col("value") + F.coalesce("backoff", F.lit(0))).alias("value"))
            left = missed.unionByName(left.filter(F.length("gram") < n))
        else:
            missed = missed.join(unknown, "lang", "left")
            done.append(missed.select("lang", "gram", (F.col("value") + F.coalesce("logp", F.lit(round(NO_MODEL * SCALE)))).alias("value")))
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out


def settled(spark: SparkSession, scored: DataFrame, table: DataFrame, lang_col: str, order: int = ORDER) -> DataFrame:
    """``scored`` with the n-grams in ``_open`` looked up in the whole tables and added to ``total``."""
    asked = scored.filter(F.size("_open") > 0).select("_row", F.coalesce(lang_col, F.lit("")).alias("lang"), F.explode("_open").alias("gram", "times"))
    values = saved(looked_up(spark, asked.select("lang", "gram").distinct(), table, order), spark)
    more = asked.join(values, ["lang", "gram"]).groupBy("_row").agg(F.sum(F.col("times") * F.col("value")).alias("_more"))
    out = scored.join(more, "_row", "left").withColumn("total", F.col("total") + F.coalesce("_more", F.lit(0)))
    return out.drop("_row", "_open", "_more")


def rule_counts(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    for lo, hi in grouped(texts):
        hashes, bound = words(texts[lo:hi])
        for i, text in enumerate(texts[lo:hi]):
            own = hashes[bound[i] : bound[i + 1]]
            bare = text.translate(None, SPACES)
            chars = len(bare.decode())
            symbols = len(bare) - len(bare.translate(None, SYMBOLS))
            lines = Counter(x for x in text.split(b"\n") if x.split()) if b"\n" in text else {}
            repeated = 0
            if len(own) > 3:
                window = mixed(mixed(own[:-2]) + own[1:-1] * np.uint64(3)) + mixed(own[2:])
                _, back, times = np.unique(window, return_inverse=True, return_counts=True)
                many = times[back] > 1
                if many.any():
                    covered = np.zeros(len(own), bool)
                    for k in range(3):
                        covered[k : k + len(many)] |= many
                    repeated = int(covered.sum())
            yield len(own), chars, symbols, sum(lines.values()) - len(lines), repeated


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, text_col: str, lang_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the rule counts and the total log probability in steps of every row.

    If n-grams are left out of the model, also ``_row``, a number of the row, and ``_open``, the n-grams that are not in
    the total and how often they occur. Such a result is to be saved before it is used, as the numbers hold for one run.
    """
    sent = spark.sparkContext.broadcast(model)
    whole = model.whole
    extra = [] if whole else [("_row", "long"), ("_open", "map<string, long>")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memo: dict[str, dict[bytes, int]] = {}
        memo_open: dict[str, dict[bytes, list[str]]] = {}
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(0)]
            langs = [x.as_py() or "" for x in batch.column(1)]
            # fewer texts at a time where n-grams are kept for each of them
            for lo, hi in grouped(texts, 1 << (22 if whole else 18)):
                split = [t.split() for t in texts[lo:hi]]
                fresh: dict[str, set[bytes]] = {}
                for own, lang in zip(split, langs[lo:hi], strict=True):
                    fresh.setdefault(lang, set()).update(own)
                for lang, seen in fresh.items():
                    known, known_open = memo.setdefault(lang, {}), memo_open.setdefault(lang, {})
                    new = sorted(seen - known.keys())
                    if len(known) + len(new) > MEMO:
                        known.clear()
                        known_open.clear()
                        new = sorted(seen)
                    values, open_ = model.score_open(lang, [w.decode() for w in new])
                    known.update(zip(new, values.tolist(), strict=True))
                    for w, gram in open_:
                        known_open.setdefault(new[w], []).append(gram)
                totals = [sum(map(memo[lang].__getitem__, own)) for own, lang in zip(split, langs[lo:hi], strict=True)]
                counts = zip(*rule_counts(texts[lo:hi]), strict=True)
                columns = [*batch.slice(lo, hi - lo).columns[2:], *[pa.array(c, pa.int64()) for c in counts], pa.array(totals, pa.int64())]
                if not whole:
                    left_out = []
                    for own, lang in zip(split, langs[lo:hi], strict=True):
                        known_open = memo_open[lang]
                        left_out.append(list(Counter(g for w in own if w in known_open for g in known_open[w]).items()))
                    columns += [pa.array(range(row, row + hi - lo), pa.int64()), pa.array(left_out, pa.map_(pa.string(), pa.int64()))]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS, "total", *[c for c, _ in extra]])

    source = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), *keep)
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:]]
    return source.mapInArrow(run, ", ".join([*own, *[f"{c} long" for c in COUNTS], "total long", *[f"{c} {kind}" for c, kind in extra]]))


def bands(scored: DataFrame, lang: str, spreads: float = SPREADS, least: float = LEAST_BAND) -> DataFrame:
    """(band_lang, low, high) of log perplexity per language: median ± ``spreads`` scaled median deviations.

    The medians come from counts of values in steps of 1/512, so a language is a few thousand rows here whatever
    the number of its documents.
    """
    cells = scored.filter("log_ppl IS NOT NULL").groupBy(F.coalesce(lang, F.lit("")).alias("band_lang"), F.floor(F.col("log_ppl") / STEP).alias("x")).agg(F.count("*").alias("n"))
    # both medians and the join between them read this small table
    cells = saved(cells, scored.sparkSession)

    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        whole = Window.partitionBy("band_lang")
        ranked = rows.withColumn("upto", F.sum("n").over(whole.orderBy(value))).withColumn("all", F.sum("n").over(whole))
        return ranked.filter(F.col("upto") * 2 >= F.col("all")).groupBy("band_lang").agg(F.min(value).alias(name))

    middle = median(cells, "x", "mid")
    off = cells.join(middle, "band_lang").withColumn("off", F.abs(F.col("x") - F.col("mid")))
    width = median(off, "off", "mad").join(middle, "band_lang")
    reach = F.greatest(F.lit(spreads * 1.4826) * (F.col("mad") + 1) * STEP, F.lit(least))
    return width.select("band_lang", ((F.col("mid") + 0.5) * STEP - reach).alias("low"), ((F.col("mid") + 0.5) * STEP + reach).alias("high"))


def quality(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",), spreads: float = SPREADS, most: int = MOST_ENTRIES) -> DataFrame:
    """``keep`` columns, the rule counts, log_ppl, base_failed and kept of every row.

    A null or blank text has no words, fails the base rules and has a null log_ppl; a null language and an
    empty one are one language; repeated rows are scored one by one; an empty table gives an empty result. ``keep`` may hold any of the
    table's columns, other ones are not looked at. ``most`` bounds what is sent to every task and changes no result.
    """
    keep = list(keep)
    table = kneser_ney(spark, saved(count_grams(docs, text_col, lang_col), spark))
    model = sorted_arrays(spark, table, most=most)
    scored = docs.select(*[F.col(c) for c in dict.fromkeys([text_col, lang_col, *keep])])
    inner = [f"k{i}" for i in range(len(keep))]
    scored = scored.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("band_lang"), *[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)])
    scored = saved(score_documents(spark, scored, model, "t", "band_lang", ["band_lang", *inner]), spark)
    if not model.whole:
        scored = saved(settled(spark, scored, table, "band_lang"), spark)
    # every word counts one character more, its end
    size = F.col("word_chars") + F.col("n_words")
    scored = scored.withColumn("log_ppl", F.when(F.col("n_words") > 0, -F.col("total") / F.lit(float(SCALE)) / size)).drop("total")
    limits = saved(bands(scored, "band_lang", spreads), spark)
    out = scored.withColumn("band_lang", F.coalesce("band_lang", F.lit(""))).join(limits, "band_lang", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], *COUNTS, "log_ppl", failed.alias("base_failed"), (~failed & within).alias("kept"))
